"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on what is special to toxic text, its
words whose beginnings occur significantly more often in toxic than in ordinary documents. A window of a text is
compressed with the ordinary dictionary and with both together; the bytes saved by the toxic one are its distance. A
logistic curve, fitted on labelled texts left out of the training, calibrates the distances of a text's windows (the
largest, the mean, the runner-up) to a score.

The model is fitted on at most ``toxic_rows`` and ``ordinary_rows`` labelled rows, those whose doc_ids have the smallest
hashes, and the dictionaries on about ``sample_chars`` characters of them at most: no text is left out, but the longest
ones are represented by pieces spread over them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import materialize, only, small_batches
from signalloom.llm.quality import labelled, sample_labels

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
WINDOW, STRIDE = 128, 120
ORDINARY_BYTES, TOXIC_BYTES = 2048, 1024
PIECE_CHARS = 1024


def windows(text: str | None) -> Iterator[bytes]:
    """Overlapping windows of the whole lower-cased text; an empty text has one empty window."""
    data = (text or "").lower().encode()
    yield data[:WINDOW]
    for at in range(STRIDE, len(data) - (WINDOW - STRIDE), STRIDE):
        yield data[at : at + WINDOW]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        16,
        source_size=WINDOW,
        dict_size=len(dictionary),
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    ready = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    ready.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=ready, compression_params=parameters)


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes):
    return _compressor(ordinary).compress, _compressor(toxic + ordinary).compress


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def distances(self, text: str | None) -> tuple[float, float, float]:
        """Largest, mean and second largest of the bytes that the toxic dictionary saves on a window."""
        plain, both = _compressors(self.ordinary, self.toxic)
        saved = sorted(len(plain(w)) - len(both(w)) for w in windows(text))
        return float(saved[-1]), sum(saved) / len(saved), float(saved[-2] if len(saved) > 1 else 0)

    def probability(self, distances: np.ndarray) -> np.ndarray:
        z = (distances - self.center) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _stems(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] for w in words for k in STEMS if k < len(w)}


def special_stems(toxic: list[str], ordinary: list[str], sigmas: float = 6.0, ratio: float = 8.0) -> set[str]:
    """Words and beginnings of words whose documents are toxic significantly more often than by chance."""
    a, b = Counter(), Counter()
    for text in toxic:
        a.update(_stems(text))
    for text in ordinary:
        b.update(_stems(text))
    n1, n0, out = len(toxic), len(ordinary), set()
    for stem, k in a.items():
        chance = n1 * (k + b[stem]) / (n0 + n1)
        often = (k + 0.5) / (n1 + 1) > ratio * (b[stem] + 0.5) / (n0 + 1)
        if k >= 4 and often and k - chance >= sigmas * math.sqrt(chance):
            out.add(stem)
    return out


def _train(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; from too few samples to train on, the last of them as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries."""
    plain = [w for text in ordinary for w in windows(text) if len(w) > 8]
    plain = plain[:: max(1, len(plain) // 20000)]
    stems = special_stems(toxic, ordinary)
    lines = []
    for text in toxic:
        words = [w for w in WORD.findall(text.lower()) if w in stems or any(w[:k] in stems for k in STEMS)]
        if words:
            lines.append(f" {' '.join(words)} ".encode())
    return _train(ORDINARY_BYTES, plain), _train(TOXIC_BYTES, lines * 4)


def _calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.c_[(x - center) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.05] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, w[:-1], float(w[-1])


def _measure(texts: DataFrame, model: Model, *names: str) -> DataFrame:
    small_batches(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    @F.pandas_udf("struct<largest double, mean double, second double, score double>")
    def of(column: pd.Series) -> pd.DataFrame:
        x = np.array([shared.value.distances(t) for t in column]).reshape(-1, 3)
        out = pd.DataFrame(x, columns=["largest", "mean", "second"])
        return out.assign(score=shared.value.probability(x))

    return texts.select(*names, of("text").alias("found")).select(*names, "found.*")


def _within(rows: DataFrame, chars: int) -> DataFrame:
    """rows with texts of at most ``chars`` characters together; those over a common length are cut to pieces of it."""
    size = F.char_length("text").cast("long")
    sizes = rows.groupBy(size.alias("size")).count().orderBy("size").toPandas()  # a row for a length
    left, texts, most = chars, int(sizes["count"].sum()), None
    for length, count in sizes.itertuples(index=False):
        if length * texts > left:
            most = max(left // texts, WINDOW)
            break
        left, texts = left - length * count, texts - count
    if most is None:
        return rows
    piece = min(PIECE_CHARS, most)
    pieces = most // piece
    at = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.floor(i * (size - piece) / max(pieces - 1, 1)))
    cut = F.array_join(F.transform(at, lambda i: F.substring("text", i.cast("int") + 1, F.lit(piece))), "\n")
    return rows.withColumn("text", F.when(size > most, cut).otherwise(F.col("text")))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    name: str,
    toxic_rows: int = 2500,
    ordinary_rows: int = 6500,
    sample_chars: int = 24_000_000,
) -> Model:
    """Fit on docs(doc_id, text) and their labels(doc_id, name 0/1) outside the held-out fold.

    Two thirds of the rows train the dictionaries, the rest the curve. Null texts are left out. Without a toxic and an ordinary row every score is 0.5.
    """
    known = sample_labels(labels, name, toxic_rows, where="label > 0").unionByName(
        sample_labels(labels, name, ordinary_rows, where="label <= 0")
    )
    rows = labelled(docs.where("text is not null"), known)  # toxic_rows + ordinary_rows at most
    rows = materialize(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))), "labelled")
    texts: dict[bool, list[str]] = {True: [], False: []}
    shown = _within(rows.where("part < 2"), sample_chars).orderBy(F.xxhash64("doc_id"), "doc_id").select("label", "text")
    for label, text in shown.toLocalIterator():
        texts[label > 0].append(text)
    blank = np.zeros(3), np.ones(3), np.zeros(3), 0.0
    if not texts[True] or not texts[False]:
        return Model(b"-" * 8, b"-" * 8, *blank)
    plain, special = train(texts[True], texts[False])
    model = Model(plain or b"-" * 8, special or b"-" * 8, *blank)
    seen = _measure(rows.where("part = 2").select("label", "text"), model, "label").toPandas()
    if seen["label"].nunique() < 2:
        return model
    found = _calibrate(seen[["largest", "mean", "second"]].to_numpy(), (seen["label"] > 0).to_numpy(float))
    return Model(model.ordinary, model.toxic, *found)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs; score is higher where label 1 is likelier, and between 0 and 1.

    Null texts count as empty, and an empty text saves nothing. Repeated rows and null doc_ids are kept; an empty table
    gives an empty result; other columns are ignored.
    """
    return _measure(only(docs, "doc_id", "text"), model, "doc_id").select("doc_id", "score")
