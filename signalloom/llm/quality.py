"""Quality classification by naive Bayes support vectors.

A text's features are indicators of hashed n-grams: words, word pairs, and the same of word shapes (letters, digits
and marks, with equal neighbours told), which generalise to words never seen. An indicator is scaled by the log-ratio
of its smoothed counts in the two classes, and a linear hinge-loss model is fitted to the scaled indicators by dual
coordinate descent. A logistic curve, fitted on margins of rows left out of the descent, turns margins into scores.

The model is fitted on at most ``sample_rows`` labelled rows, those whose doc_ids have the smallest hashes; that bound
makes their doc_ids small enough to broadcast, so only their texts are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import only, small_batches

BITS = 18
LETTERS, DIGITS = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[0-9]+")
CACHED_WORDS = 1 << 17
PAIR = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """word -> hash of the word, its last 16 bits a hash of the word's shape"""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        shape = DIGITS.sub(b"0", LETTERS.sub(b"a", word))[:16]
        value = self[word] = xxhash.xxh64_intdigest(word) & ~0xFFFF | xxhash.xxh32_intdigest(shape) & 0xFFFF
        return value


_WORDS = _Words()
_MARKED = np.zeros(1 << BITS, bool)


def _hashed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (values >> np.uint64(64 - BITS)).view(np.int64)


def features(text: str | None) -> np.ndarray:
    """The sorted distinct n-gram numbers of a text; a text without words has one of its own."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(1, np.int64)
    word = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    shape = word & np.uint64(0xFFFF)
    equal = (word[1:] == word[:-1]).astype(np.uint64)
    for grams in (word, word[:-1] * PAIR + word[1:], shape ^ PAIR, shape[:-1] * PAIR + shape[1:] + equal, equal + np.uint64(7)):
        _MARKED[_hashed(grams)] = True
    found = np.flatnonzero(_MARKED)
    _MARKED[found] = False
    return found


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


@dataclass
class Model:
    weights: np.ndarray  # of the indicators, the log-count ratios multiplied in
    bias: float
    slope: float
    offset: float

    def score(self, text: str | None) -> float:
        found = features(text)
        margin = self.weights[found].sum() / np.sqrt(len(found)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def descend(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, c: float, rounds: int, seed: int = 5):
    """Weights and bias of the linear hinge-loss model, by dual coordinate descent over rows in random order."""
    w, bias = np.zeros(len(ratios)), 0.0
    x = [(ratios[r] / np.sqrt(len(r))).astype(np.float32) for r in rows]
    square = np.array([float(v @ v) + 1 for v in x])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    limit = np.where(y > 0, c * len(y) / max(1, (y > 0).sum()) / 2, c * len(y) / max(1, (y < 0).sum()) / 2)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            slope = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def logistic(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the smoothed logistic curve of label (0 or 1) over margin, by Newton's method."""
    n1 = label.sum()
    goal = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (len(label) - n1 + 2))
    scale = max(margin.std(), 1e-9)
    x, a, b = np.c_[margin / scale, np.ones(len(margin))], 0.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (goal - p) - 1e-3 * np.array([a, b]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a / scale, b


def sample_labels(labels: DataFrame, name: str, rows: int, folds: int = 5, where: str = "true") -> DataFrame:
    """(doc_id, label) of at most so many labelled doc_ids that are not held out, by the hash of doc_id.

    A doc_id with several labels has the largest; null doc_ids and labels are left out.
    """
    known = only(labels, "doc_id", name).where(F.col(name).isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"), folds))
    known = known.groupBy("doc_id").agg(F.max(name).cast("int").alias("label")).where(where)
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, label, text): the texts of known(doc_id, label), which has a bounded number of rows.

    Of rows that share a doc_id that with the smallest hash of its text counts, so the result is bounded as well.
    """
    rows = only(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return one.select("doc_id", "label", "one.text")


def fit(docs: DataFrame, labels: DataFrame, name: str, sample_rows: int = 6000, c: float = 1.0, rounds: int = 12) -> Model:
    """Fit on docs(doc_id, text) and their labels(doc_id, name 0/1) outside the held-out fold.

    Without any labelled row every score is 0.5.
    """

    @F.pandas_udf("array<int>")
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t).astype(np.int32) for t in texts])
        _WORDS.clear()

    rows = labelled(docs, sample_labels(labels, name, sample_rows))
    sample = rows.select("doc_id", "label", grams("text").alias("grams")).toPandas()
    size = 1 << BITS
    if sample.empty:
        return Model(np.zeros(size), 0.0, 0.0, 0.0)
    sample = sample.sort_values("doc_id", kind="stable")
    label = (sample["label"].to_numpy() > 0).astype(int)
    grams_of = sample.pop("grams").tolist()
    counts = np.zeros((2, size))
    for found, y in zip(grams_of, label, strict=True):
        counts[y, found] += 1
    total = np.bincount(label, minlength=2)
    ratios = np.log((counts[1] + 1) / (counts[0] + 1) * (total[0] + 2) / (total[1] + 2))
    apart = np.arange(len(label)) % 4 == 3  # for the curve
    fitted = [g for g, out in zip(grams_of, apart, strict=True) if not out]
    w, bias = descend(fitted, 2.0 * label[~apart] - 1, ratios, c, rounds)
    weights = w * ratios
    margin = np.array([weights[g].sum() / np.sqrt(len(g)) + bias for g in grams_of])
    curve = apart if len(set(label[apart])) == 2 else np.ones(len(label), bool)
    slope, offset = logistic(margin[curve], label[curve])
    return Model(weights, bias, slope, offset)


def _scorer(spark, model: Model):
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**BITS weights

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")
        _WORDS.clear()  # a later stage of the worker has its own use for the memory

    return of


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs; score is higher where label 1 is likelier, and between 0 and 1.

    Null and empty texts have the score of a text without words. Repeated rows and null doc_ids are kept; an empty
    table gives an empty result; other columns are ignored.
    """
    return only(docs, "doc_id", "text").select("doc_id", _scorer(docs.sparkSession, model)("text").alias("score"))


def keep_likely(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least so much, all columns kept."""
    return docs.where(_scorer(docs.sparkSession, model)("text") >= least)
