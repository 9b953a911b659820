"""URL filtering by association rules.

A URL is a set of tokens: the suffixes of its host, the parts of its path and the names of its query. Tokens that occur in
exactly the same URLs, such as most suffixes of one long host, are one item: all their combinations say the same, and there
are two to the power of their number. FP-growth mines the combinations of items that go with a label, and rules are kept by their support and by their confidence among all URLs,
those without a label included, where it must be beyond the base rate. A general rule makes its special cases with no
higher confidence superfluous. Rules are applied by an inverted index: a rule is filed under
one of its tokens, the rarest, so a URL meets only rules that share it, and fires if the URL has all others too.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import ASCII_UPPER, few, materialize, only

BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; without :// empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, ASCII_UPPER, ASCII_UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; without :// empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)


def suffixes(host: Column) -> Column:
    """A host and its parent domains, longest first."""
    parts = F.split(host, r"\.")
    at = F.sequence(F.lit(1), F.size(parts))
    return F.transform(at, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; a digest stands for one of over 80 characters."""
    path = F.filter(F.split(path_of(url), r"[/.\-_]+"), lambda x: x != "")
    names = F.filter(F.split(query_of(url), "&"), lambda x: x != "")
    found = F.concat(
        F.transform(suffixes(host_of(url)), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(path, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(names, lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1))),
    )
    digest = lambda x: F.concat(F.substring_index(x, ":", 1), F.lit(":#"), F.sha2(x, 256))
    return F.array_distinct(F.transform(found, lambda x: F.when(F.char_length(x) > 80, digest(x)).otherwise(x)))


def match_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, url, host, path, rule, verdict): the longest rule that fits each page, or nulls.

    rules are (verdict, text) with a text such as example.com/en/. A rule fits its host and all subdomains if the
    page's path starts with the rule's; equal lengths go to the smaller text. The list is part of the plan, as a map
    from hosts, so each page looks up the suffixes of its own host and is neither shuffled nor repeated.
    """
    index: dict[str, list[tuple[int, str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        index.setdefault(host, []).append((-len(rule), rule, slash + path, verdict))
    entry = lambda n, rule, start, verdict: F.struct(
        F.lit(n).alias("n"), F.lit(rule).alias("rule"), F.lit(start).alias("start"), F.lit(verdict).alias("verdict")
    )
    pages = only(pages, "page_id", "url")
    placed = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    best = F.lit(None).cast("struct<n: int, rule: string, start: string, verdict: string>")
    if index:
        held = F.create_map(
            *(x for host, found in index.items() for x in (F.lit(host), F.array(*(entry(*r) for r in sorted(found)))))
        )
        fits = F.flatten(F.filter(F.transform(suffixes(F.col("host")), lambda h: F.try_element_at(held, h)), lambda x: x.isNotNull()))
        best = F.array_min(F.filter(fits, lambda r: F.startswith(F.col("path"), r["start"])))
    placed = placed.withColumn("best", best)
    return placed.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def _filed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, has, antecedent) of the rules that fire on urls(url, has), met by their rarest token."""
    often = rules.select(F.explode("antecedent").alias("token")).distinct()
    said = urls.select(F.explode("has").alias("token")).join(often, "token").groupBy("token").count()
    filed = rules.select("antecedent", F.explode("antecedent").alias("token")).join(said, "token")
    filed = filed.groupBy("antecedent").agg(F.min(F.struct("count", "token")).alias("rarest"))
    filed = filed.select("antecedent", F.col("rarest.token").alias("token"))
    met = urls.select("url", "has", F.explode("has").alias("token")).join(filed, "token")
    return met.where(F.size(F.array_except("antecedent", "has")) == 0).select("url", "has", "antecedent")


def _items(rows: DataFrame, least_rows: float) -> DataFrame:
    """(item, tokens): the classes of tokens that occur in the same rows(id, known, has), the item their least token.

    Only tokens that occur in so many known rows count; their number is below the tokens of all known rows / least_rows.
    """
    said = rows.select("id", "known", F.explode("has").alias("token"))
    often = said.where("known").groupBy("token").count().where(F.col("count") >= least_rows).select("token")
    h = F.xxhash64("id")
    marks = said.join(few(materialize(often, "often")), "token").groupBy("token").agg(
        F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("mix")
    )
    same = marks.groupBy("rows", "sum", "mix").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("tokens"))
    return materialize(same.select("item", "tokens"), "items")


def mine(
    labelled: DataFrame,
    support: float = 0.01,
    confidence: float = 0.9,
    least_rows: int = 5,
    background: DataFrame | None = None,
    sigmas: float = 2.0,
) -> DataFrame:
    """(antecedent array, confidence, support) of rules that say block; labelled has (url, label 'block'/'allow').

    A combination must occur in a share ``support`` of the labelled rows, and in ``least_rows`` at least, and be
    blocked in a share ``confidence`` of its rows. The counts of combinations come from FP-growth over all labelled
    rows; tokens rarer than the support drop out first, which bounds their number. Tokens that no row of either table tells
    apart stand and fall together in an antecedent. The rows of ``background(url)`` have
    no label and count as not blocked: the confidence is that among both tables, and its lower bound (Wilson, with
    ``sigmas``) must lie above the share of blocked rows in both. An empty table gives no rules.
    """
    spark = labelled.sparkSession
    known = labelled.select(F.lit(True).alias("known"), tokens(F.col("url")).alias("has"), "label")
    if background is not None:
        also = background.select(F.lit(False).alias("known"), tokens(F.col("url")).alias("has"), F.lit(None).cast("string").alias("label"))
        known = known.unionByName(also)
    rows = materialize(known.withColumn("id", F.monotonically_increasing_id()), "urls")
    n = rows.where("known").count()
    if not n:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double")
    items = _items(rows, max(support * n, least_rows))
    said = rows.select("id", F.explode("has").alias("item")).join(few(items.select("item")), "item")
    said = said.groupBy("id").agg(F.collect_list("item").alias("has"))
    # sides with a row a URL compress to a fraction of what they are in memory, by which Spark would broadcast them
    rows = rows.drop("has").join(said.hint("merge"), "id", "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    rows = materialize(rows, "baskets")
    marked = rows.where("known").select(F.array_append("has", F.concat(F.lit("label:"), "label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least_rows / n)), minConfidence=confidence).fit(marked)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(f"label:{BLOCK}")))
    rules = rules.where(~F.exists("antecedent", lambda x: x.startswith("label:")))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    rules = materialize(rules, "rules")
    if background is not None:
        base = rows.where(F.col("label") == BLOCK).count() / rows.count()
        urls = rows.where("not known").select(F.col("id").alias("url"), "has")
        also = _filed(rules, urls).groupBy("antecedent").agg(F.count("*").alias("also"))
        blocked = F.round(F.col("support") * n)
        every = F.round(blocked / F.col("confidence")) + F.coalesce("also", F.lit(0))
        p, z = F.col("confidence"), sigmas
        bound = (p + z * z / (2 * F.col("every")) - z * F.sqrt(p * (1 - p) / F.col("every") + z * z / (4 * F.col("every") ** 2))) / (
            1 + z * z / F.col("every")
        )
        rules = rules.join(also, "antecedent", "left").withColumn("every", every).withColumn("confidence", blocked / F.col("every"))
        rules = rules.where((p >= confidence) & (bound > base)).select("antecedent", "confidence", "support")
        rules = materialize(rules, "rules")
    # one token fewer at a time: a rule goes if a part of it is as sure
    parts = rules.select(
        "antecedent", "confidence", F.explode("antecedent").alias("without")
    ).select(F.col("antecedent").alias("whole"), "confidence", F.array_remove("antecedent", F.col("without")).alias("part"))
    general = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("as_sure"))
    implied = parts.join(general, "part").where("as_sure >= confidence").select(F.col("whole").alias("antecedent")).distinct()
    kept = materialize(rules.join(implied, "antecedent", "left_anti").withColumn("nth", F.monotonically_increasing_id()), "rules")
    whole = kept.select("nth", F.explode("antecedent").alias("item")).join(items, "item")
    whole = whole.groupBy("nth").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("antecedent"))
    return materialize(kept.drop("antecedent").join(whole, "nth").select("antecedent", "confidence", "support"), "rules")


def apply_rules(pages: DataFrame, rules: DataFrame, confidence: float = 0.9) -> DataFrame:
    """(page_id, url) -> (url, verdict) for the distinct urls that a mined rule blocks.

    The index of rules by their rarest token meets the distinct urls' tokens; both sides are keyed by token, and a hot
    token is split by Spark.
    """
    urls = only(pages, "url").where("url is not null").distinct().select("url", tokens(F.col("url")).alias("has"))
    met = _filed(rules.where(F.col("confidence") >= confidence).select("antecedent"), urls)
    return met.select("url").distinct().select("url", F.lit(BLOCK).alias("mined"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], support: float = 0.01, confidence: float = 0.9) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url).

    The list's longest fitting rule decides. Its verdicts are also the labels from which combinations are mined, with the
    other pages as background, so a token that many of these have blocks none of them. The mined rules decide the other pages: block if a mined rule fires, else allow. A null url, and one without ://, has an
    empty host and path and is allowed unless a rule fits. Repeated rows and null page_ids are kept, an empty table
    gives an empty result, other columns are ignored.
    """
    listed = materialize(match_rules(pages, rules), "listed")
    known = listed.where("verdict is not null").select("url", F.col("verdict").alias("label"))
    open_ = listed.where("verdict is null")
    mined = mine(known, support, confidence, background=open_)
    blocked = apply_rules(open_, mined, confidence)
    rest = open_.drop("verdict").join(blocked.hint("merge"), "url", "left")
    rest = rest.withColumn("verdict", F.coalesce("mined", F.lit(ALLOW))).drop("mined")
    return listed.where("verdict is not null").unionByName(rest).drop("url")
