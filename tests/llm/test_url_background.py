"""Mined URL rules against pages that the rule list does not decide."""

from signalloom.llm import urlfilter

RULES = [("block", "org/es/"), ("allow", "good.org/es/ok")]


def test_unlisted_clean_pages_stay_allowed(spark):
    spam = "s" * 90
    urls = [f"http://h{i % 7}.org/es/{i}" for i in range(100)] + [f"http://good.org/es/ok{i}" for i in range(10)]
    clean = [f"http://h{i % 7}.{top}/{lang}/{i}" for i in range(100) for top, lang in (("org", "en"), ("com", "es"))]
    urls += clean + [f"http://h{i}.org/es/{spam}/{i}" for i in range(40)] + [f"http://x.net/de/{spam}/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r.verdict for r in urlfilter.judge(df, RULES).collect()}
    assert {got[u] for u in clean} == {"allow"}
    assert got[f"http://x.net/de/{spam}/1"] == "block"


def test_rules_of_many_tokens_are_kept(spark):
    parts = [["a", "b", "c", "d", "e"][:i] + ["a", "b", "c", "d", "e"][i + 1 :] for i in range(5)]
    rows = [("http://h/a/b/c/d/e", "block")] * 30 + [(f"http://h/{'/'.join(p)}", "allow") for p in parts for _ in range(20)]
    rules = urlfilter.mine(spark.createDataFrame(rows, "url string, label string"), 0.01, 0.9).collect()
    assert [set(r.antecedent) for r in rules] == [{f"path:{x}" for x in "abcde"}]
