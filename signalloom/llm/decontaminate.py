"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item, or all words of a shorter item. For exact containment a
document must hold every word of a window, so one necessary prefix token will do: the window's rarest word, by the
number of times the words of the benchmark occur in all documents. Documents join on that word alone. A match at word
p of the document and word o of the window fixes the start p - o (positional bound), which must leave room for the
whole window (length bound); then the words are compared exactly.

The prefix tokens of all windows are broadcast while they are few (``broadcast_windows``, checked by a count). Beyond that
words and prefix tokens are joined by a shuffle without the texts, and only what matches meets its text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import ascii_lower, few, materialize, only, pack, unpack

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(window_id, words) of distinct windows and (window_id, item_id) of the items that have them."""
    items = only(benchmark, "item_id", "text").select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1))))
    every = items.select("item_id", "w", start.alias("at")).select(
        "item_id", F.slice("w", F.col("at"), F.lit(window)).alias("words")
    )
    every = every.withColumn("window_id", F.sha2(F.array_join("words", " "), 256))
    distinct = every.groupBy("window_id").agg(F.first("words").alias("words"))
    return materialize(distinct, "windows"), materialize(every.select("window_id", "item_id").distinct(), "items")


def _same_row(content: str, doc: str = "of") -> Column:
    """Rows are told by doc_id, which may be null, and the hash of their text."""
    return F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("key").eqNullSafe(F.col(content))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, broadcast_windows: int) -> DataFrame:
    """contamination with key, the hash of the row's text."""
    windows, items = _windows(benchmark, window)
    known = windows.select(F.explode("words").alias("word")).distinct()
    fits = windows.count() <= broadcast_windows
    small = F.broadcast if fits else (lambda df: df)  # of tables with a bounded number of rows a window
    docs = only(docs, "doc_id", "text").withColumn("key", F.xxhash64("text"))
    said = docs.select(F.explode(words(F.col("text"))).alias("word"))
    counts = said.join(small(known), "word").groupBy("word").count()
    rarity = materialize(known.join(counts, "word"), "rarity")  # a window with a word that no document has is out

    placed = windows.select("window_id", "words", F.posexplode("words").alias("at", "word"))
    placed = placed.join(rarity, "word", "left")
    rank = F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "at")
    prefix = placed.groupBy("window_id").agg(F.first("words").alias("words"), F.min(rank).alias("rarest"))
    prefix = prefix.where("rarest.n > 0").select(
        "window_id", "words", F.col("rarest.word").alias("word"), F.col("rarest.at").alias("at")
    )
    prefix = materialize(prefix.withColumn("n", F.size("words")), "prefixes")

    body = docs.select("doc_id", "key", words(F.col("text")).alias("body"))
    start = F.col("place") - F.col("at")
    if fits:
        each = body.select("doc_id", "key", "body", F.posexplode("body").alias("place", "word"))
        met = each.join(small(prefix), "word").where((start >= 0) & (start + F.col("n") <= F.size("body")))
        met = met.where(F.slice("body", start + 1, F.col("n")) == F.col("words"))
    else:
        each = body.select("doc_id", "key", F.posexplode("body").alias("place", "word"))
        met = each.join(prefix.select("word", "window_id", "at", "n"), "word").where(start >= 0)
        met = met.select(F.col("doc_id").alias("of"), F.col("key").alias("content"), "place", "at", "n", "window_id").distinct()
        texts = docs.dropDuplicates(["doc_id", "key"])
        met = met.join(texts, _same_row("content")).withColumn("body", words(F.col("text")))
        met = met.where(start + F.col("n") <= F.size("body"))
        met = met.select("doc_id", "key", "place", "at", "n", "window_id", F.slice("body", start + 1, F.col("n")).alias("said"))
        met = met.join(windows, "window_id").where(F.col("said") == F.col("words"))
    met = met.select("doc_id", "key", start.alias("start"), (start + F.col("n")).alias("end"), "window_id")
    met = materialize(met, "met")

    spans = met.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda acc, x: F.struct(
            (acc["hit"] + F.greatest(x["end"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("hit"),
            F.greatest(acc["end"], x["end"]).alias("end"),
        ),
        lambda acc: acc["hit"],
    )
    hits = spans.select("doc_id", "key", covered.cast("long").alias("n_hit"))
    named = met.select("doc_id", "key", "window_id").distinct().join(few(items, broadcast_windows), "window_id")
    named = named.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))

    sizes = docs.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sizes
    for part in (hits, named):
        part = part.withColumnRenamed("doc_id", "of").withColumnRenamed("key", "content")
        out = out.join(part, _same_row("content"), "left").drop("of", "content")
    return out.select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_windows: int = 100_000
) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, n_items, items (sorted item ids as strings).

    n_hit counts the words inside any occurrence of a window, n_items the items with occurring windows. Null and empty
    texts have no words and no hits; items without words have no windows; items with equal windows all count. Repeated
    rows give equal repeated results; a null doc_id is a value like any other. An empty table on either side gives
    no rows or no hits. Other columns are ignored.
    """
    return _found(docs, benchmark, window, broadcast_windows).drop("key")


def contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    """A document is contaminated if at least one word in ``one_in`` is hit."""
    return (n_hit > 0) & (one_in * n_hit >= n_words)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, broadcast_windows: int = 100_000
) -> DataFrame:
    """The rows of docs that are not contaminated, all columns kept.

    Each row is judged by its own text, whatever rows share its doc_id, null included.
    """
    found = _found(docs, benchmark, window, broadcast_windows)
    bad = found.where(contaminated(F.col("n_hit"), F.col("n_words"), one_in)).select("doc_id", "key").distinct()
    bad = materialize(bad.select(F.col("doc_id").alias("__of"), F.col("key").alias("__key")), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("__of")) & (F.xxhash64("text") == F.col("__key"))
    return unpack(pack(docs).join(few(bad), same, "left_anti"), docs.columns)
