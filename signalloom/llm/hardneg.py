"""Hard negatives by a multiway hyperplane tree with distance ranges (a GNAT), exact.

Vectors of integers are lifted by one component to a common length, so that an inner product with an anchor is a distance
from it and a window of inner products is an annulus around it. A node of the tree has several split points; a vector goes to
the child of the nearest one, so children lie between hyperplanes. For each split point the node keeps the range of its
distances to each child's vectors. An anchor compares itself with the split points: the triangle inequality and the ranges
bound its distances to each child's vectors from below and above, and a child that the annulus does not meet is eliminated
with all that is below it. In the leaves that are left every vector is compared, so the result is exact whatever the tree.

The tree is fitted on a bounded sample; every vector is then placed in it and counted in its ranges. Neighbouring leaves make
a shard, which anchors are sent to once, with the leaves that they ask; crowded shards, and their anchors, are cut into
blocks by hash, so copies of one vector, however many, are shared out. A search for the positives asks the anchor's own leaf
first, whose fifth best bounds the ball that is then searched; the negatives' windows follow from the positives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.common import materialize, only, shards

BATCH = 1024
EXACT = float(1 << 53)
#: Squares of distances are differences of doubles, so a small distance is off by some 1e-7 of the length of the vectors; a
#: child is only eliminated beyond this share of it.
SLACK = 1e-6


@dataclass
class Node:
    """points[i] is the split point of children[i]: a node, or the number of a leaf; its leaves are from first to before end.

    low and high [i, j] bound the distances between points[i] and the vectors of children[j].
    """

    number: int
    points: np.ndarray
    children: list[Node | int]
    ends: np.ndarray = field(default=None)
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


class Tree:
    """A GNAT over a sample, whose leaves should hold about ``leaf_rows`` of n vectors each."""

    def __init__(self, sample: np.ndarray, n: int, leaf_rows: int, arity: int = 16, seed: int = 5):
        self.nodes: list[Node] = []
        self.leaves = 0
        self.rng, self.arity = np.random.default_rng(seed), arity
        self.root = self._split(sample, n / max(1, len(sample)), leaf_rows)

    def _split(self, part: np.ndarray, each: float, leaf_rows: int) -> Node | int:
        want = min(self.arity, int(np.ceil(len(part) * each / leaf_rows)), len(part))
        points = self._far_apart(part, want) if want > 1 else part[:1]
        if len(points) < 2:
            self.leaves += 1
            return self.leaves - 1
        node = Node(len(self.nodes), points, [])
        self.nodes.append(node)
        ends = []
        child = distances(part, points).argmin(axis=1)
        for i in range(len(points)):
            own = part[child == i]
            node.children.append(self._split(own, each, leaf_rows if len(own) < len(part) else len(own) * each + 1))
            ends.append(self.leaves)
        node.ends = np.array(ends)
        return node

    def _far_apart(self, part: np.ndarray, want: int) -> np.ndarray:
        """Of random candidates, three for each point wanted, those that are farthest from the ones before."""
        some = part[self.rng.permutation(len(part))[: 3 * want]]
        chosen, far = [0], np.full(len(some), np.inf)
        while len(chosen) < want:
            far = np.minimum(far, distances(some, some[chosen[-1:]])[:, 0])
            if far.max() <= SLACK * (1 + np.abs(some).max()):  # what is left is the same vector
                break
            chosen.append(int(far.argmax()))
        return some[chosen]

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        leaf, todo = np.zeros(len(points), np.int32), [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not isinstance(node, Node):
                leaf[rows] = node
                continue
            child = distances(points[rows], node.points).argmin(axis=1)
            todo += [(c, rows[child == i]) for i, c in enumerate(node.children) if (child == i).any()]
        return leaf

    def measure(self, points: np.ndarray, leaf: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Widen the ranges [node, i, j] by points that were placed in the leaves."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not isinstance(node, Node):
                continue
            d, m = distances(points[rows], node.points), len(node.points)
            child = np.searchsorted(node.ends, leaf[rows], "right")
            for j in np.unique(child):
                own = d[child == j]
                low[node.number, :m, j] = np.minimum(low[node.number, :m, j], own.min(axis=0))
                high[node.number, :m, j] = np.maximum(high[node.number, :m, j], own.max(axis=0))
                todo.append((node.children[j], rows[child == j]))

    def ask(self, q: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows of q, leaves) that may hold vectors at a distance between inner and outer, each row's own."""
        found, todo = [], [(self.root, np.arange(len(q)), np.zeros(len(q)), np.full(len(q), np.inf))]
        while todo:
            node, rows, least, most = todo.pop()
            if not isinstance(node, Node):
                found.append((rows, np.full(len(rows), node, np.int32)))
                continue
            d = distances(q[rows], node.points)
            for j, child in enumerate(node.children):
                below = np.maximum(d - node.high[:, j], node.low[:, j] - d).max(axis=1)
                near, far = np.maximum(least, below), np.minimum(most, (d + node.high[:, j]).min(axis=1))
                open_ = (near <= outer[rows] + slack) & (far >= inner[rows] - slack) & (node.low[0, j] <= node.high[0, j])
                if open_.any():
                    todo.append((child, rows[open_], near[open_], far[open_]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    return np.c_[v, np.sqrt(np.maximum(top - (v**2).sum(axis=1), 0))]


def _flat(q: np.ndarray) -> np.ndarray:
    return np.c_[q, np.zeros(len(q))]


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The inner products of rows of whole numbers, exactly: in double precision where all sums fit, else in integers."""
    reach = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    if reach < EXACT:
        return q @ v.T
    whole = lambda x: np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)
    found = whole(q) @ whole(v).T
    if any(abs(x) >= 1 << 63 for x in found.flat):
        raise ArithmeticError("an inner product does not fit in 64 bits")
    return found.astype(np.int64)


def usable(vec: Column) -> Column:
    """Vectors that are null or empty or hold null or non-finite components take no part."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad


def whole_numbers(vec: Column) -> Column:
    """floor(256 * x) of each component; doubles hold these exactly, whatever their size."""
    return F.transform(vec.cast("array<double>"), lambda x: _floor(x * 256))


def _floor(x: Column) -> Column:
    """The floor as a double; from 2**53 on a double is whole already."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


class Index:
    """The rows(vec_id, label, vec) of a table of whole-number vectors, placed in a tree, in shards of leaves."""

    def __init__(self, rows: DataFrame, sample_rows: int, leaf_rows: int, shard_rows: int, ask_rows: int):
        self.rows, self.ask_rows = rows, ask_rows
        norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
        count, top = rows.agg(F.count("*"), F.max(norm)).first()
        self.top = float(top or 0)
        if not np.isfinite(self.top):
            raise ArithmeticError("the square of a vector's length is beyond double precision")
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample_rows).select("vec").toPandas()["vec"]
        self.tree = Tree(_lifted(_stack(sample), self.top), count, leaf_rows)
        tree, top = self.tree, self.top
        self.slack = SLACK * (1 + 4 * np.sqrt(top))

        def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), BATCH):
                    part = batch.iloc[at : at + BATCH]
                    yield part.assign(leaf=tree.place(_lifted(_stack(part["vec"]), top)))

        schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, vec array<double>, leaf int"
        self.placed = materialize(rows.select("vec_id", "label", "vec").mapInPandas(place, schema), "placed")
        self._measure()
        sizes = dict(self.placed.groupBy("leaf").count().collect())  # a row a leaf
        self.shard, self.blocks = shards([sizes.get(leaf, 0) for leaf in range(tree.leaves)], shard_rows)

    def _measure(self) -> None:
        """Fill in the ranges: the least and greatest distance of each split point to each child's vectors."""
        tree, top, arity = self.tree, self.top, self.tree.arity

        def measure(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            low = np.full((len(tree.nodes), arity, arity), np.inf)
            high = np.full((len(tree.nodes), arity, arity), -np.inf)
            for batch in batches:
                for at in range(0, len(batch), BATCH):
                    part = batch.iloc[at : at + BATCH]
                    tree.measure(_lifted(_stack(part["vec"]), top), part["leaf"].to_numpy(), low, high)
            node, i, j = np.nonzero(low <= high)
            yield pd.DataFrame({"node": node, "i": i, "j": j, "low": low[node, i, j], "high": high[node, i, j]})

        found = self.placed.select("vec", "leaf").mapInPandas(measure, "node long, i long, j long, low double, high double")
        found = found.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        found = {tuple(x[:3]): tuple(x[3:]) for x in found.collect()}  # arity squared a node
        for node in tree.nodes:
            m = len(node.points)
            node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
            for i in range(m):
                for j in range(m):
                    node.low[i, j], node.high[i, j] = found.get((node.number, i, j), (np.inf, -np.inf))

    def search(
        self,
        asked: DataFrame,
        annulus: Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray]],
        best: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], Iterable[tuple[np.ndarray, ...]]],
        schema: str,
        k: int,
        own_leaf: bool = False,
    ) -> DataFrame:
        """What best finds in the leaves that asked(vec_id, label, vec, ...) may have to do with.

        annulus gives the inner and outer distances of a batch of asked rows; best gets asked rows, vectors, and the matrix
        of their scores, and yields columns of schema, the last two of which are vec_id and score. Of each combination of the
        others, k rows of each block are kept, the greatest scores first, of equals the smaller vec_id. With own_leaf, each row
        asks the leaf it would be placed in only.
        """
        tree, top, slack, shard = self.tree, self.top, self.slack, np.array(self.shard)
        extra = [c for c in asked.columns if c not in ("vec_id", "label", "vec")]
        kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in asked.columns)

        def route(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), BATCH):
                    part = batch.iloc[at : at + BATCH]
                    q = _stack(part["vec"])
                    if own_leaf:
                        which, leaf = np.arange(len(part)), tree.place(_lifted(q, top))
                    else:
                        which, leaf = tree.ask(_flat(q), *annulus(part, q), slack)
                    if not len(which):
                        continue
                    pairs = pd.DataFrame({"which": which, "shard": shard[leaf], "leaf": leaf})
                    pairs = pairs.groupby(["which", "shard"])["leaf"].agg(list).reset_index()
                    out = part.iloc[pairs["which"]].reset_index(drop=True)
                    yield out.assign(shard=pairs["shard"].to_numpy(), leaves=pairs["leaf"].to_numpy())

        routed = materialize(asked.mapInPandas(route, f"{kinds}, shard int, leaves array<int>"), "asked")
        asks = dict(routed.groupBy("shard").count().collect())  # a row a shard
        plan = [(s, b, -(-asks[s] // self.ask_rows)) for s, b in enumerate(self.blocks) if s in asks]
        spark = asked.sparkSession
        leaves = [(leaf, s) for leaf, s in enumerate(self.shard) if s in asks]
        plan = F.broadcast(spark.createDataFrame(plan, "shard int, blocks int, asks int"))
        leaves = F.broadcast(spark.createDataFrame(leaves, "leaf int, shard int"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        key = ["shard", "block", "ask"]
        held = self.placed.join(leaves, "leaf").join(plan, "shard")
        held = held.select("shard", deal("blocks").alias("block"), each("asks").alias("ask"), "leaf", "vec_id", "label", "vec")
        asking = routed.join(plan, "shard")
        asking = asking.select("shard", deal("asks").alias("ask"), each("blocks").alias("block"), "leaves", *asked.columns)
        names = [x.split()[0] for x in schema.split(", ")]

        def compare(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = [[] for _ in names]
            if len(asking) and len(held):
                held = held.sort_values(["leaf", "vec_id"], kind="stable").reset_index(drop=True)
                leaf, v = held["leaf"].to_numpy(), _stack(held["vec"])
                asked_leaf = np.concatenate(asking["leaves"].to_numpy())
                row = np.repeat(np.arange(len(asking)), asking["leaves"].map(len))
                q = _stack(asking["vec"])
                for one in np.unique(leaf):
                    a, b = np.searchsorted(leaf, one), np.searchsorted(leaf, one, "right")
                    rows = row[asked_leaf == one]
                    for at in range(0, len(rows), 128):
                        own = rows[at : at + 128]
                        for cut in range(a, b, 8 * BATCH):
                            end = min(cut + 8 * BATCH, b)
                            for columns in best(asking.iloc[own], held.iloc[cut:end], scores(q[own], v[cut:end])):
                                for x, c in zip(out, columns, strict=True):
                                    x.append(c)
            found = pd.DataFrame({n: np.concatenate(x) if x else np.empty(0, np.int64) for n, x in zip(names, out, strict=True)})
            found = found.sort_values([names[-1], names[-2]], ascending=[False, True], kind="stable")
            return found.groupby(names[:-2], sort=False).head(k)

        return asking.groupBy(key).cogroup(held.groupBy(key)).applyInPandas(compare, schema)


def _first(score: np.ndarray, good: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest scores of each row among the good ones; of equals the first columns."""
    row, column = np.nonzero(good)
    if not len(row):
        return row, column
    if len(row) > 4 * k * len(score):  # most will not be among the first
        worst = np.full(score.shape, np.iinfo(np.int64).min if score.dtype.kind == "i" else -np.inf, score.dtype)
        worst[row, column] = score[row, column]
        most = min(k, score.shape[1])
        floor = np.partition(worst, score.shape[1] - most, axis=1)[:, score.shape[1] - most]
        row, column = np.nonzero(good & (score >= floor[:, None]))
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    nth = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    return row[nth < k], column[nth < k]


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    sample_rows: int = 16_384,
    leaf_rows: int = 2048,
    shard_rows: int = 32_768,
    ask_rows: int = 16_384,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that anchors picks.

    rows has (vec_id long, label, vec array<double> of whole numbers); anchors is a condition on it. Scores are exact integer
    inner products with the anchor; higher ones come first, of equals the smaller vec_id. An anchor's positives are its first
    other rows of the same label; for each, the first rows of other labels with ``least * positive <= 100 * negative <= most *
    positive`` are returned, rank from 1. A positive with no such row has none in the result.

    Rows with a null vec_id, label or vector take no part, nor do those with a component that is null or not finite, and
    vectors of another length than the most frequent one (the shortest of equals). Rows that repeat count once; rows that share
    a vec_id and differ otherwise are all anchors and candidates, but not of each other. Scores beyond 64 bits raise
    ArithmeticError. An empty table gives an empty result; other columns are ignored.

    ``sample_rows`` vectors at most, those with the smallest hashes, and half of that from 512 components on, shape the tree;
    they bound the number of leaves, and the ranges are those of all rows.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    good = only(rows, "vec_id", "label", "vec").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    good = good.distinct()
    length = good.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if length is None:
        return spark.createDataFrame([], schema)
    good = materialize(good.where(F.size("vec") == length["length"]), "vectors")
    per = max(1, length["length"] // 512)
    count = good.count()
    leaf_rows = max(1, min(leaf_rows, -(-count // 8)))
    index = Index(good, max(1, sample_rows // per), leaf_rows, max(leaf_rows, min(shard_rows // per, -(-count // 64))), ask_rows)
    asked = materialize(good.where(anchors), "anchors")
    top, slack = index.top, index.slack

    def ball(score: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The distance of vectors with an inner product."""
        return np.sqrt(np.maximum(top + (q**2).sum(axis=1) - 2 * score, 0))

    def same_label(asking: pd.DataFrame, held: pd.DataFrame, score: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        label, ids = held["label"].to_numpy(), held["vec_id"].to_numpy()
        own = asking["vec_id"].to_numpy()
        i, j = _first(score, (label == asking["label"].to_numpy()[:, None]) & (ids != own[:, None]), positives)
        yield own[i], asking["key"].to_numpy()[i], ids[j], score[i, j].astype(np.int64)

    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    asked = asked.withColumn("key", F.xxhash64("vec_id", "label", "vec"))  # of anchors that share an id
    near = "anchor_id long, key long, vec_id long, score long"

    def first(found: DataFrame) -> DataFrame:
        return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)

    rough = first(index.search(asked, None, same_label, near, positives, own_leaf=True))
    floor = rough.where(F.col("nth") == positives).select("anchor_id", F.col("key").alias("of"), F.col("score").alias("floor"))
    bounded = asked.join(floor, (F.col("vec_id") == F.col("anchor_id")) & (F.col("key") == F.col("of")), "left").drop("anchor_id", "of")
    bounded = materialize(bounded, "bounded")

    def around(part: pd.DataFrame, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = part["floor"].astype(float).to_numpy()
        return np.zeros(len(q)), np.where(np.isnan(score), np.inf, ball(np.nan_to_num(score), q))

    pairs = first(index.search(bounded, around, same_label, near, positives))
    pairs = pairs.groupBy("anchor_id", "key").agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))  # five at most
    pairs = pairs.select("anchor_id", F.col("key").alias("of"), F.col("found.vec_id").alias("positive"), F.col("found.score").alias("score"))
    pairs = asked.join(pairs, (F.col("vec_id") == F.col("anchor_id")) & (F.col("key") == F.col("of"))).drop("anchor_id", "of")
    pairs = materialize(pairs, "positives")

    def window(part: pd.DataFrame, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The annulus of all windows of an anchor, which its least and greatest positive scores above zero span."""
        high = np.array([max(s) for s in part["score"]], float)
        low = np.array([min((x for x in s if x >= 0), default=np.inf) for s in part["score"]], float)
        inner, outer = ball(high * most / 100, q), ball(np.where(np.isinf(low), 0, low) * least / 100, q)
        return inner, np.where(np.isinf(low), -np.inf, outer)

    def other_label(asking: pd.DataFrame, held: pd.DataFrame, score: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        label, ids = held["label"].to_numpy(), held["vec_id"].to_numpy()
        own, key, of = asking["vec_id"].to_numpy(), asking["key"].to_numpy(), asking["label"].to_numpy()
        other = (label != of[:, None]) & (ids != own[:, None])
        positive, bound = asking["positive"].to_numpy(), asking["score"].to_numpy()
        for nth in range(max(map(len, positive))):
            has = np.array([len(x) > nth for x in positive])
            ps = np.array([int(x[nth]) if h else 0 for x, h in zip(bound, has, strict=True)], object)
            low = np.array([-(-least * int(x) // 100) for x in ps], score.dtype)  # whole scores from low to high
            high = np.array([most * int(x) // 100 for x in ps], score.dtype)
            i, j = _first(score, other & has[:, None] & (score >= low[:, None]) & (score <= high[:, None]), negatives)
            chosen = np.array([int(x[nth]) if h else 0 for x, h in zip(positive, has, strict=True)], np.int64)
            yield own[i], key[i], chosen[i], np.array(ps[i], np.int64), ids[j], score[i, j].astype(np.int64)

    far = "anchor_id long, key long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = index.search(pairs, window, other_label, far, negatives)
    order = Window.partitionBy("anchor_id", "key", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute_force(rows: list[tuple], is_anchor: Callable[[int], bool], positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> list[tuple]:
    """The result for (vec_id, label, whole numbers), by comparing everything; for tests on small tables."""
    out = []
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), b, other == label) for b, other, w in rows if b != a)
        for ps, b, _ in [x for x in scored if x[2]][:positives]:
            fits = [(n, -ns) for ns, n, same in scored if not same and least * -ps <= 100 * -ns <= most * -ps]
            out += [(a, b, rank, n, -ps, ns) for rank, (n, ns) in enumerate(fits[:negatives], 1)]
    return sorted(out)
