"""Near duplicates by the Jaccard similarity of word shingles.

Equal shingle sets are one node. Candidates are SimHash links (see ``simhash``), which reach only a few bits, and nodes
whose sketches share a shingle: a sketch is the ``SKETCH`` smallest hashes of a set, or the whole of a smaller set. Of the
smallest hashes of two sets' union a share as large as their similarity is in both sketches, so at a similarity of 0.8
fewer than ``SHARED`` common ones have a probability below 1e-9; such pairs, and pairs of too different sizes, are no
candidates. All others are compared by their whole sets.

Hot shingles, which more than ``HOT`` sketches have, are no buckets: a node with fewer hot ones than it must share with its
partners meets them in other buckets. The other nodes, the heavy ones, meet each other by a prefix filter: in the order
from the rarest shingle among them to the most frequent, two such sets share one of their first n - ceil(least * n) + 1.

Pairs that are linked already need no comparison. A few rounds compare each node of a bucket with one pivot of the bucket
before the pairs across components are compared, until these are not more than the nodes, so a large group of near copies costs
its size and not its square.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import discard, few, materialize, pack, small_batches, unpack
from signalloom.llm.graph import connected_components
from signalloom.llm.simhash import fingerprint_of, links, shingle_hashes

SKETCH, SHARED = 32, 10
#: Texts of one template share many sketched shingles and are not alike: beyond so many, the pairs of a bucket cost more than the
#: exact filter on whole sets.
HOT = 50
#: Pairs across components are compared when there are at most so many for each row of nodes, or after so many rounds.
PIVOT_ROUNDS, CROSS_PER_ROW = 4, 1


def _said(shingle_words: int):
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle_words)).view(np.int64) for t in texts])

    return of


def _signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """docs with __row, a number of the row, and __node (a hash of the shingle set), __n (its size), __fp and __sketch."""

    small_batches(docs.sparkSession)

    def one(text: str | None) -> tuple[int, int, int, np.ndarray]:
        hashes = shingle_hashes(text, shingle_words)
        said = np.unique(hashes)
        node = xxhash.xxh3_64_intdigest(said.tobytes()) - (1 << 63)
        return fingerprint_of(hashes), node, len(said), said[:SKETCH].view(np.int64)

    @F.pandas_udf("struct<__fp long, __node long, __n int, __sketch array<long>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["__fp", "__node", "__n", "__sketch"])

    return docs.withColumns({"__row": F.monotonically_increasing_id(), "__s": of("text")}).select("*", "__s.*").drop("__s")


def _least_shared(m: Column, least: float) -> Column:
    """How many of its sketch of m hashes a node shares with each of its partners."""
    return F.least(F.lit(SHARED), F.ceil(F.lit(least) * m - 1e-9))


class _Search:
    """The tables of one search: prints has a row a document, nodes a row a distinct shingle set."""

    def __init__(self, docs: DataFrame, shingle_words: int, radius: int, least: float):
        self.said, self.radius, self.least = _said(shingle_words), radius, least
        self.prints = materialize(_signatures(docs, shingle_words), "signatures")
        one = self.prints.groupBy(F.col("__node").alias("node")).agg(
            F.min(F.struct(*(F.col(f"__{c}").alias(c) for c in ("row", "n", "fp", "sketch")))).alias("one")
        )
        self.nodes = materialize(one.select("node", "one.*"), "nodes")
        self.spare: list[DataFrame] = []  # what only the buckets are made of

    def sets(self, named: DataFrame) -> DataFrame:
        """(node, said) of the nodes in named(node): the whole shingle sets, each computed once from one row's text."""
        rows = materialize(self.nodes.join(named, "node", "left_semi").select("node", F.col("row").alias("__row")), "rows")
        out = self.prints.select("__row", "text").join(few(rows), "__row").select("node", self.said("text").alias("said"))
        out = materialize(out, "sets")
        discard(rows)
        return out

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) of nodes whose sets are as similar as ``least``."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        side = lambda e: self.nodes.select(F.col("node").alias(e), F.col("sketch").alias(f"s{e}"), F.col("n").alias(f"n{e}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").where(self.close("na", "nb"))
        shared = F.size(F.array_intersect("sa", "sb"))
        pairs = met.where(shared >= _least_shared(F.greatest(F.size("sa"), F.size("sb")), self.least)).select("a", "b")
        pairs = materialize(pairs, "pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        of = lambda e, s: sets.select(F.col("node").alias(e), F.col("said").alias(s))
        both = F.size(F.array_intersect("x", "y"))
        alike = both / (F.size("x") + F.size("y") - both) >= self.least
        empty = F.size("x") + F.size("y") == 0
        out = materialize(pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").where(alike | empty).select("a", "b"), "alike")
        discard(pairs, sets)
        return out

    def close(self, x: str, y: str) -> Column:
        return F.least(x, y) >= F.lit(self.least) * F.greatest(x, y) - 1e-9

    def simhash_pairs(self) -> DataFrame:
        lead = materialize(self.nodes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
        of = lambda end: lead.select(F.col("fp").alias(f"fp_{end}"), F.col("lead").alias(end))
        linked = links(lead.select("fp"), self.radius).toDF("fp_a", "fp_b").join(of("a"), "fp_a").join(of("b"), "fp_b")
        same = self.nodes.join(lead, "fp").select(F.col("node").alias("a"), F.col("lead").alias("b"))
        return linked.select("a", "b").unionByName(same)

    def buckets(self) -> DataFrame:
        """(h, node, n): nodes in the buckets of shingles that they share."""
        held = self.nodes.select("node", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("h"))
        sizes = held.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
        held = materialize(held.join(sizes, "h"), "held")
        self.spare.append(held)
        cool = held.where(F.col("k") <= HOT).select("h", "node", "n")
        heavy = held.where(F.col("k") > HOT).groupBy("node", "n", "m").count()
        heavy = materialize(heavy.where(F.col("count") >= _least_shared(F.col("m"), self.least)).select("node", "n"), "heavy")
        self.spare.append(heavy)
        if heavy.isEmpty():
            return cool
        self.spare.append(self.sets(heavy.select("node")))
        words = self.spare[-1].select("node", F.explode("said").alias("h"))
        often = words.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
        ranked = words.join(often, "h", "left").groupBy("node").agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("k", F.lit(1)).alias("k"), "h"))).alias("said")
        )
        n = F.size("said")
        first = F.slice("said", 1, (n - F.ceil(F.lit(self.least) * n - 1e-9) + 1).cast("int"))
        prefix = ranked.select("node", F.explode(first).alias("p")).where("p.k > 1").select(F.col("p.h").alias("h"), "node")
        return cool.unionByName(prefix.join(heavy, "node").select("h", "node", "n"))

    def edges(self) -> DataFrame:
        """(a, b): links between nodes that join every group."""
        held = materialize(self.buckets(), "buckets")
        discard(*self.spare)
        rows = self.nodes.count()

        def joined(*parts: DataFrame) -> DataFrame:
            """(a, b): every node that has an edge, and the smallest of its component; the parts, all edges so far, go."""
            roots = connected_components(reduce(DataFrame.unionByName, parts))
            out = materialize(roots.select(F.col("node").alias("a"), F.col("root").alias("b")), "stars")
            discard(*parts)
            return out

        def mixed() -> DataFrame:
            """The rows of buckets that several components share, with the components."""
            roots = edges.toDF("node", "root")
            out = held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            ends = out.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
            return materialize(out.join(ends, "h"), "mixed")

        edges = joined(self.similar(self.simhash_pairs()))  # stars from here on, to which each turn adds
        for turn in range(PIVOT_ROUNDS + 1):
            now = mixed()
            parts = now.groupBy("h", "root").count().groupBy("h")
            parts = parts.agg((F.pow(F.sum("count"), 2) - F.sum(F.col("count") * F.col("count"))).alias("twice"))
            if turn == PIVOT_ROUNDS or (parts.agg(F.sum("twice")).first()[0] or 0) / 2 <= CROSS_PER_ROW * rows:
                break
            order = F.xxhash64("node", F.lit(turn))
            pivot = now.groupBy("h").agg(F.min_by(F.struct("node", "n", "root"), order).alias("p"))
            tried = now.join(pivot, "h").where((F.col("root") != F.col("p.root")) & self.close("n", "p.n"))
            found = self.similar(tried.select(F.col("node").alias("a"), F.col("p.node").alias("b")))
            discard(now)
            edges = joined(edges, found)

        side = lambda e: now.select("h", F.col("root").alias(f"r{e}"), F.col("node").alias(e), F.col("n").alias(f"n{e}"))
        across = side("a").join(side("b"), "h").where("ra < rb").where(self.close("na", "nb"))
        out = edges.unionByName(self.similar(across.select("a", "b")))
        discard(now, held)
        return out

    def groups(self) -> DataFrame:
        """(node, root) of every node."""
        roots = connected_components(self.edges())
        return materialize(self.nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "groups")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, radius: int = 3, least: float = 0.8) -> DataFrame:
    """(doc_id, node, component_id) for every row of docs; component_id is the smallest doc_id of the row's group.

    Groups are the connected components of all pairs of rows with a Jaccard similarity of at least ``least``. Null
    texts and texts without words have the empty set and are alike. Rows with a null doc_id take part, and never name
    a group unless all its rows have null. Other columns are ignored; an empty table gives an empty result.
    """
    search = _Search(docs.select(F.col("doc_id"), F.col("text")), shingle_words, radius, least)
    rows = search.prints.select("doc_id", F.col("__node").alias("node"))
    member = materialize(rows.join(search.groups(), "node"), "members")
    named = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return member.join(named, "root").select("doc_id", "node", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, radius: int = 3, least: float = 0.8) -> DataFrame:
    """docs with one row of each group, that with the smallest doc_id (nulls last, the first of equals); all columns kept.

    Each row is judged by its own text, whatever rows share its doc_id. An empty table stays empty.
    """
    search = _Search(pack(docs), shingle_words, radius, least)
    groups = search.groups()
    rows = search.prints.select("__row", "doc_id", F.col("__node").alias("node")).join(groups, "node")
    rows = materialize(rows.select("root", "__row", F.struct(F.col("doc_id").isNull(), "doc_id", "__row").alias("order")), "members")
    first = rows.groupBy("root").agg(F.min_by("__row", "order").alias("first"))
    gone = materialize(rows.join(first, "root").where(F.col("__row") != F.col("first")).select("__row"), "gone")
    discard(search.nodes, groups, rows)
    return unpack(search.prints.join(few(gone), "__row", "left_anti"), docs.columns)


def brute_force(rows: list[tuple[int, str | None]], shingle_words: int, least: float) -> tuple[dict[int, int], int]:
    """(doc_id -> component_id, number of linked pairs) by comparing all pairs; for tests on small tables."""
    sets = [(i, set(shingle_hashes(t, shingle_words).tolist())) for i, t in rows]
    up, pairs = {i: i for i, _ in sets}, 0
    for at, (i, x) in enumerate(sets):
        for j, y in sets[:at]:
            if x == y or len(x & y) / len(x | y) >= least:
                pairs += 1
                low, high = sorted((up[i], up[j]))
                up = {k: low if v == high else v for k, v in up.items()}
    return up, pairs
