"""Substring dedup by level-wise doubling.

A word is removed if a window of ``window`` consecutive words that covers it also starts in a document with a smaller
doc_id. Windows repeated at one length alone are extended to twice that length:

1. Seeds of half a window, rounded up. Any window holds ``window - seed + 1`` seeds and is represented by that with
   the smallest hash (the first of equals), so equal windows have equal seeds and only about two seeds in
   ``window - seed + 2`` words need to be counted. Seeds that do not come again drop out, and with them all their
   windows.
2. A surviving seed is extended to both sides, to the run of windows that it represents: between one and about two
   windows of words. Where a whole run is the same in a smaller document, it is settled.
3. What survives, the first holders of runs that differ around a common seed, is compared window by window.

Doubling ends at the window: longer repeats remove nothing that their windows do not.

Equality is told by hashes of 128 bits: seeds and runs have 64 each, of independent families, and single windows both. All
counts are partial aggregates and all joins are equi-joins whose large partitions Spark may split, so a passage that a
third of all documents share meets no single task. What is found are spans of words of a row, the row told by its doc_id
and the hash of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm import wordhash
from signalloom.llm.common import discard, materialize, only, pack, packed, small_batches, unpack

BYTES_AT_ONCE = 1 << 18
ROW = ["doc_id", "key"]


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class Windows:
    """The windows of a batch of texts, and the runs of neighbouring windows that have the same seed."""

    def __init__(self, texts: pa.Array, window: int):
        words, self.bounds = wordhash.split(texts)
        self.window, seed = window, (window + 1) // 2
        self.sums = [wordhash.Sums(h, f) for f, h in enumerate(wordhash.hashes(words))]
        none = np.empty(0, np.int64)
        self.start = self.end = self.text = none  # of runs: the first window, the place after the last, the text
        self.seed = none.view(np.uint64)
        size = len(words) - window + 1
        if size <= 0:
            return
        text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        inside = np.flatnonzero(text[:size] == text[window - 1 :])
        if not len(inside):
            return
        seeds = self.sums[0].every(seed)
        at = wordhash.sliding_first_least(seeds, window - seed + 1)[inside]
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)])
        self.start, self.end = inside[first], inside[np.r_[first[1:], len(inside)] - 1] + 1
        self.text, self.seed = text[self.start], seeds[at[first]]

    def runs(self) -> np.ndarray:
        return self.sums[1].runs(self.start, self.end + self.window - 1)

    def places(self) -> np.ndarray:
        """The first window of each run, counted from the beginning of its text."""
        return self.start - self.bounds[self.text]


def _windows(batches: Iterable[pa.RecordBatch], window: int, column: int) -> Iterator[tuple[pa.RecordBatch, Windows]]:
    for batch in batches:
        for a, b in wordhash.slices(batch.column(column), BYTES_AT_ONCE):
            part = batch.slice(a, b - a)
            yield part, Windows(part.column(column), window)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _seeds(docs: DataFrame, window: int) -> DataFrame:
    """The seed of every run."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _windows(batches, window, 0):
            yield pa.RecordBatch.from_arrays([_signed(found.seed)], ["seed"])

    return docs.select("text").mapInArrow(of, "seed long")


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """(seed, run, doc_id, key, start, n) of every run of n windows."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _windows(batches, window, 2):
            row = pa.array(found.text)
            n = pa.array((found.end - found.start).astype(np.int32))
            own = [part.column(0).take(row), part.column(1).take(row), pa.array(found.places().astype(np.int32)), n]
            yield pa.RecordBatch.from_arrays([_signed(found.seed), _signed(found.runs()), *own], ["seed", "run", *ROW, "start", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*ROW, "text").mapInArrow(of, f"seed long, run long, doc_id {kind}, key long, start int, n int")


def _single(docs: DataFrame, window: int) -> DataFrame:
    """(a, b, doc_id, key, start) of every window of the runs that ``open`` lists; a and b are its hashes."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _windows(batches, window, 2):
            lists = part.column(3)
            opened = set(zip(np.repeat(np.arange(len(part)), lists.value_lengths()).tolist(), lists.flatten().to_pylist(), strict=True))
            keep = np.array([x in opened for x in zip(found.text.tolist(), found.places().tolist(), strict=True)], bool)
            start, n = found.start[keep], (found.end - found.start)[keep]
            at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            text = np.repeat(found.text[keep], n)
            hashes = [_signed(s.runs(at, at + window)) for s in found.sums]
            own = [part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array((at - found.bounds[text]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*hashes, *own], ["a", "b", *ROW, "start"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*ROW, "text", "open").mapInArrow(of, f"a long, b long, doc_id {kind}, key long, start int")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text) of the rows that can have repeats."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text")


def spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, key, spans array<struct<start, end>>): the words of a row in windows that smaller documents have too.

    key is xxhash64 of the text; a row is in the result if it has such words.
    """
    small_batches(docs.sparkSession)
    docs = _keyed(docs)
    # what a join meets is written first, so that both its sides are plain shuffles, of which Spark splits hot keys
    often = _seeds(docs, window).groupBy("seed").agg(F.count("*").alias("k")).where("k > 1").select("seed")
    often = materialize(often, "often")
    alive = materialize(_runs(docs, window).join(often, "seed"), "seeds")
    discard(often)

    first = materialize(alive.groupBy("seed", "run").agg(F.min("doc_id").alias("low")), "runs")
    placed = alive.join(first, ["seed", "run"])
    end = (F.col("start") + F.col("n") + window - 1).alias("end")
    later = materialize(placed.where(F.col("doc_id") > F.col("low")).select(*ROW, "start", end), "settled")

    differ = first.groupBy("seed").agg(F.count("*").alias("k")).where("k > 1").select("seed")
    differ = materialize(differ, "differ")
    held = placed.where(F.col("doc_id") == F.col("low")).join(differ, "seed").groupBy(*ROW).agg(F.collect_set("start").alias("open"))
    single = materialize(_single(docs.join(held, ROW), window), "windows")
    discard(alive, first, differ)
    low = single.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    low = materialize(low.drop("high"), "again")
    again = single.join(low, ["a", "b"]).where(F.col("doc_id") > F.col("low"))
    again = again.select(*ROW, "start", (F.col("start") + window).alias("end"))

    found = later.unionByName(again).groupBy(*ROW).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    found = materialize(found, "spans")
    discard(later, single, low)
    return found


def kept_words(words: list[bytes], starts: list[int], ends: list[int]) -> list[bytes]:
    """The words that no span covers."""
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, ends, -1)
    keep = np.cumsum(covered[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    """docs with __starts and __ends of the spans of each row, null where it has none."""
    found = spans(docs, window).select(
        F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), F.col("spans.start").alias("__starts"), F.col("spans.end").alias("__ends")
    )
    same = (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(found, same, "left").drop("__doc", "__key")


def remove_repeats(docs: DataFrame, window: int = 13, with_text: bool = True) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    kept_text is the words that stay, joined by one space. Null and empty texts have no words; texts shorter than a
    window keep all words. doc_id may be of any type that orders; a null one is smaller than none and none is smaller
    than it: such rows keep all words. Rows that share a doc_id remove nothing from each other. An empty table gives an
    empty result; other columns are ignored.
    """
    docs = only(docs, "doc_id", "text")
    text_type = ", kept_text string" if with_text else ""

    @F.pandas_udf(f"struct<n_words long, n_removed long, kept_sha256 string{text_type}>")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for text, a, b in zip(texts, starts, ends, strict=True):
            words = split_words(text)
            kept = words if a is None else kept_words(words, a, b)
            joined = b" ".join(kept)
            row = (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest())
            rows.append((*row, joined.decode()) if with_text else row)
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept_text"][: 3 + with_text])

    both = _with_spans(docs, window)
    return both.select("doc_id", cut("text", "__starts", "__ends").alias("cut")).select("doc_id", "cut.*")


def cut_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with the repeated words cut from text, and n_chars brought up to date, all columns kept.

    A text that loses words is what stays, joined by one space; other texts are unchanged. The cut is told by content,
    so rows that share a doc_id are each cut on their own.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        found = zip(texts, starts, ends, strict=True)
        return pd.Series([t if a is None else b" ".join(kept_words(split_words(t), a, b)).decode() for t, a, b in found], dtype=object)

    out = _with_spans(pack(docs), window).withColumn("__cut", cut("text", "__starts", "__ends"))
    own = {"text": F.col("__cut")}
    if "n_chars" in docs.columns:
        new = F.char_length("__cut").cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(F.col("__starts").isNull(), packed("n_chars")).otherwise(new)
    return unpack(out, docs.columns, **own)


def brute_force(rows: list[tuple[int, str | None]], window: int) -> dict[int, list[bytes]]:
    """doc_id -> kept words, by a dictionary of all windows; for tests on small tables."""
    low: dict[tuple, int] = {}
    for doc, text in rows:
        words = split_words(text)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            low[key] = min(low.get(key, doc), doc)
    out = {}
    for doc, text in rows:
        words = split_words(text)
        gone = set()
        for i in range(len(words) - window + 1):
            if low[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out[doc] = [w for i, w in enumerate(words) if i not in gone]
    return out
