"""SimHash near-duplicate groups, searched with BK-trees.

A document's fingerprint has a bit for each bit of the XXH64 hashes of its word shingles: set when more than half of
the hashes have it. Documents link when their fingerprints differ in at most ``radius`` bits, and linked documents
form a group.

Search. Equal fingerprints are one node. Two nodes within the radius agree on at least one of ``radius + 1`` blocks
of bits, so nodes are dealt to buckets by (block, its bits). The nodes of a bucket form a BK-tree: the children of a
tree node are keyed by their Hamming distance to it, and a query follows only edges within the radius of its own
distance. A bucket over ``bucket_limit`` nodes is dealt again by blocks of the bits that are still free, until it
fits; the free bits run out at a bound, so every tree is small whatever the data. A shard of trees is sent to the
queries that can match in it by a shuffle and not by a driver broadcast: all trees together hold a node for every
distinct fingerprint, which has no size bound. A bucket passes on a star of each linked set, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.llm.common import materialize, only, shuffle_partitions, small_batches
from signalloom.llm.graph import connected_components

SEED = 42
BITS = 64
HASHES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 17


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """The XXH64 hashes of a text's shingles in their order; null and texts without words have none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(shingle_words, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - size + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of shingle hashes; 0 without any."""
    ones, n = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, n, HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The signed 64-bit fingerprint; null and texts without words have 0."""
    return fingerprint_of(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """(doc_id, fp) for every row of docs."""

    small_batches(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, shingle_words) for x in texts], dtype="int64")

    return only(docs, "doc_id", "text").select("doc_id", of("text").alias("fp"))


def _blocks(free: int, parts: int) -> list[int]:
    """Masks of nearly equal runs of the bits that are set in free."""
    places = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << int(i) for i in run) for run in np.array_split(places, parts)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


class BKForest:
    """One BK-tree for each bucket, built and searched level by level on arrays.

    codes are distinct within a bucket; bucket numbers start at 0 and every one has a code.
    """

    def __init__(self, codes: np.ndarray, bucket: np.ndarray):
        self.codes, n = codes, len(codes)
        self.root = np.full(bucket.max(initial=-1) + 1, -1, np.int64)
        self.bucket = bucket
        order = np.arange(n)
        first = np.unique(bucket, return_index=True)[1]
        self.root[bucket[first]] = first
        at = self.root[bucket]  # the tree node that each code hangs below, so far
        waiting = order[at != order]
        parents, edges, children = [], [], []
        while len(waiting):
            d = np.bitwise_count(codes[waiting] ^ codes[at[waiting]]).astype(np.int64)
            key = at[waiting] * (BITS + 1) + d
            found, first, back = np.unique(key, return_index=True, return_inverse=True)
            child = waiting[first]  # the first code at a distance becomes the child there
            parents.append(found // (BITS + 1))
            edges.append(found % (BITS + 1))
            children.append(child)
            at[waiting] = child[back]
            waiting = waiting[at[waiting] != waiting]
        none = np.empty(0, np.int64)
        parent, edge = np.concatenate([none, *parents]), np.concatenate([none, *edges])
        self.key = parent * (BITS + 1) + edge
        by = np.argsort(self.key)
        self.key, self.child = self.key[by], np.concatenate([none, *children])[by]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, found) of places in codes, each query searched in the tree of its own bucket."""
        todo = [(queries, self.root[self.bucket[queries]])]
        while todo:
            q, node = todo.pop()
            if len(q) > PAIRS_AT_ONCE:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(self.codes[q] ^ self.codes[node]).astype(np.int64)
            hit = d <= radius
            yield q[hit], node[hit]
            low = np.searchsorted(self.key, node * (BITS + 1) + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            width = high - low
            q = np.repeat(q, width)
            if len(q):
                offset = np.arange(len(q)) - np.repeat(np.cumsum(width) - width, width)
                todo.append((q, self.child[np.repeat(low, width) + offset]))


def _stars(codes: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, root) edges that join the codes of each bucket which are linked within it."""
    n = len(codes)
    up = np.arange(n)  # always points straight at the root

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for q, found in BKForest(codes, bucket).within(np.arange(n), radius):
        a, b = up[q], up[found]
        pairs = np.unique((np.maximum(a, b) * n + np.minimum(a, b))[a != b])
        for x, y in zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
        while len(pairs) and (up[up] != up).any():
            up = up[up]
    moved = up != np.arange(n)
    return codes[moved], codes[up[moved]]


def links(nodes: DataFrame, radius: int, bucket_limit: int = 1024) -> DataFrame:
    """(a, b) fingerprints whose links join every linked set of the distinct fingerprints ``nodes.fp``."""
    spark = nodes.sparkSession
    free = (1 << BITS) - 1
    masks = _blocks(free, radius + 1)
    dealt = nodes.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    dealt = dealt.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    shards = max(4 * shuffle_partitions(spark), nodes.count() * (radius + 1) // 16384)
    found = []

    def search(group: pd.DataFrame) -> pd.DataFrame:
        key = group["mask"].to_numpy().astype(np.uint64), group["bits"].to_numpy().astype(np.uint64)
        bucket = pd.MultiIndex.from_arrays(key).factorize()[0].astype(np.int64)
        a, b = _stars(group["fp"].to_numpy().view(np.uint64), bucket, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    while True:
        sizes = dealt.groupBy("mask", "bits").count().where("count > 1")
        sizes = materialize(sizes, "buckets")
        small = dealt.join(sizes.where(F.col("count") <= bucket_limit).drop("count"), ["mask", "bits"])
        small = small.withColumn("shard", F.pmod(F.xxhash64("mask", "bits"), F.lit(shards)))
        found.append(small.groupBy("shard").applyInPandas(search, "a long, b long"))
        large = sizes.where(F.col("count") > bucket_limit).drop("count")
        if large.isEmpty():
            break
        finer = {m: [m | x for x in _blocks(free & ~m, radius + 1)] for m in masks}
        masks = sorted({x for xs in finer.values() for x in xs})
        deal = F.create_map(
            *(x for m, xs in finer.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(y)) for y in xs))))
        )
        dealt = dealt.join(large, ["mask", "bits"]).select("fp", F.explode(deal[F.col("mask")]).alias("mask"))
        dealt = dealt.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits")).distinct()
        dealt = materialize(dealt, "dealt")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, radius: int = 3, bucket_limit: int = 1024
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id of the row's group.

    A null text counts as empty and has fingerprint 0; such rows are linked like any others. Rows with a null doc_id
    keep their fingerprint and take part; they never name a group unless all its rows have null. Repeated rows stay
    repeated. An empty table gives an empty result. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, shingle_words), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = connected_components(links(nodes, radius, bucket_limit))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    member = materialize(member.select("fp", F.coalesce("root", "fp").alias("root"), "low"), "members")
    named = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(named, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def brute_force(rows: Iterable[tuple[int, str | None]], shingle_words: int, radius: int) -> dict[int, int]:
    """doc_id -> component_id by comparing all pairs; for tests on small tables."""
    ids, texts = zip(*rows, strict=True)
    codes = np.array([fingerprint(t, shingle_words) for t in texts], np.int64).view(np.uint64)
    label = np.array(ids)
    while True:
        new = label.copy()
        for i in range(len(ids)):
            near = np.bitwise_count(codes ^ codes[i]) <= radius
            new[i] = label[near].min()
        if (new == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = new
