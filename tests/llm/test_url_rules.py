"""The rules of op5_url_filter, word for word as its contract lists them."""

from signalloom.llm import registry, urlfilter

CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_the_rules_are_those_of_the_contract(spark):
    assert ", ".join(" ".join(x) for x in registry.URL_RULES) == CONTRACT
    urls = ["http://a.net/de/1", "http://EXAMPLE.net/de/80?x", "http://b.example.net/de/7", "http://example.com/en/7", "http://example.com/en/6", "http://net/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.match_rules(pages, registry.URL_RULES).collect()}
    assert got == {
        0: ("net/de/", "allow"),
        1: ("example.net/de/8", "block"),
        2: ("net/de/", "allow"),
        3: ("example.com/en/7", "allow"),
        4: ("com/en/", "block"),
        5: (None, None),
    }
