"""Approximate nearest neighbours by inner product, over balanced posting lists.

Inner products become Euclidean distances by one more component that lifts all vectors to the largest norm. Lists are
fitted on a bounded sample, chosen by hash: 2-means splits at the median give leaves of equal size, whose means are the
centroids. Every row is then indexed. A vector goes to its nearest list, and a boundary vector also to the other lists that
are nearly as near. Centroids are found by a search of an in-memory neighbour graph. A query reads the lists whose distance
is within a ratio of the nearest one's, always enough of them to hold k candidates. The ratio is measured: a sample of
queries is compared with all rows, and the smallest ratio with which they find the wanted share of their true neighbours
is that of all queries. Vectors in clusters need few lists; vectors without any structure need a large part of them.

Equal vectors are searched once and expanded at the end, where only the k + 1 smallest ids of each can matter. Neighbouring
lists make a shard: a query is sent there once, with the lists that it reads, and has k + 1 rows from there. Crowded shards
and their queries are cut into blocks of bounded size, so no task holds a whole crowded list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.common import materialize, only, shards, shuffle_partitions

BATCH = 2048
DISTANCES_AT_ONCE = 1 << 22


def fit_centroids(sample: np.ndarray, leaves: int, seed: int = 7) -> np.ndarray:
    """Means of about ``leaves`` groups of equal size."""
    rng, todo, out = np.random.default_rng(seed), [(sample, leaves)], []
    while todo:
        part, n = todo.pop()
        if n < 2 or len(part) < 4:
            out.append(part.mean(axis=0))
            continue
        ends = part[rng.choice(len(part), 2, replace=False)].astype(np.float64)
        for _ in range(8):
            near = ((part - ends[0]) ** 2).sum(axis=1) < ((part - ends[1]) ** 2).sum(axis=1)
            if near.all() or not near.any():
                break
            ends = np.stack([part[near].mean(axis=0), part[~near].mean(axis=0)])
        half = n // 2
        order = np.argsort(part @ (ends[1] - ends[0]), kind="stable")
        cut = len(part) * half // n
        todo += [(part[order[:cut]], half), (part[order[cut:]], n - half)]
    return np.stack(out)


class CentroidGraph:
    """A neighbour graph over centroids and a best-first search of it for many points at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, entries: int = 16):
        self.centroids, n = centroids.astype(np.float64), len(centroids)
        self.square = (self.centroids**2).sum(axis=1)
        degree = min(degree, n)
        self.neighbours = np.empty((n, degree), np.int64)
        for at in range(0, n, BATCH):
            d = self.square - 2 * self.centroids[at : at + BATCH] @ self.centroids.T
            self.neighbours[at : at + BATCH] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        chosen, far = [0], np.full(n, np.inf)
        for _ in range(min(entries, n) - 1):  # entry points spread over all centroids
            far = np.minimum(far, ((self.centroids - self.centroids[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(far.argmax()))
        self.entries = np.unique(chosen)

    def search(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each point the ``width`` nearest centroids found, nearest first, and their distances."""
        b, n = len(points), len(self.centroids)
        width = min(width, n)
        if 8 * width >= n:  # so wide that comparing with all is less work
            d = (points**2).sum(axis=1)[:, None] + self.square - 2 * points @ self.centroids.T
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            return order, np.sqrt(np.maximum(np.take_along_axis(d, order, axis=1), 0))
        own, rows = (points**2).sum(axis=1), np.arange(b)[:, None]
        seen = np.zeros((b, n), bool)
        dist = np.full((b, n), np.inf)
        closed = np.zeros((b, n), bool)

        def visit(ids: np.ndarray) -> None:
            d = self.square[ids] - 2 * np.einsum("bd,bkd->bk", points, self.centroids[ids]) + own[:, None]
            dist[rows, ids] = np.maximum(d, 0)
            seen[rows, ids] = True

        visit(np.repeat(self.entries[None], b, axis=0))
        for _ in range(n):
            order = np.argpartition(dist, width - 1, axis=1)[:, :width]
            waiting = np.where(closed[rows, order] | ~seen[rows, order], np.inf, dist[rows, order])
            best = np.argsort(waiting, axis=1)[:, :4]
            best_ids, alive = order[rows, best], np.isfinite(waiting[rows, best])
            if not alive.any():
                break
            closed[rows, best_ids] |= alive
            visit(self.neighbours[best_ids].reshape(b, -1))
        order = np.argpartition(dist, width - 1, axis=1)[:, :width]
        order = np.take_along_axis(order, np.argsort(dist[rows, order], axis=1), axis=1)
        return order, np.sqrt(dist[rows, order])


def _lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(top - (vectors**2).sum(axis=1), 0))
    return np.c_[vectors, rest]


def _lists_of_vectors(points: np.ndarray, graph: CentroidGraph, replicas: int, ratio: float) -> np.ndarray:
    """A row for each point of its lists, nearest first: those within the ratio of the nearest one's distance, else -1."""
    ids, d = graph.search(points, replicas)
    return np.where(d <= ratio * d[:, :1], ids, -1)


def usable(vec: Column) -> Column:
    """Vectors that are null, empty or zero or hold null or non-finite components take no part."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _true_neighbours(reps: DataFrame, q: np.ndarray, k: int) -> DataFrame:
    """(query, rep): for each row of q the k rows of reps(rep, vec) with the largest inner products but its own vector."""

    def best(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, rep = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                v, ids = _stack(batch["vec"].iloc[at : at + BATCH]), batch["rep"].to_numpy()[at : at + BATCH]
                new = q @ v.T
                own = [(v == x).all(axis=1) for x in q]
                score = np.c_[score, np.where(own, -np.inf, new)]
                rep = np.c_[rep, np.repeat(ids[None], len(q), axis=0)]
                if score.shape[1] > k:
                    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, rep = np.take_along_axis(score, top, axis=1), np.take_along_axis(rep, top, axis=1)
        which, nth = np.nonzero(np.isfinite(score))
        yield pd.DataFrame({"query": which, "rep": rep[which, nth], "score": score[which, nth]})

    found = reps.select("rep", "vec").mapInPandas(best, "query long, rep long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("query", "rep")


def _ratio_needed(graph: CentroidGraph, q: np.ndarray, places: pd.DataFrame, recall: float) -> tuple[float, int]:
    """(ratio, lists): the smallest distance ratio that finds ``recall`` of the true neighbours, and the most lists in it.

    places has (query, rep, list) for every list of every true neighbour. The mean recall of the queries has to be two
    standard errors over the wanted one.
    """
    d = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + graph.square - 2 * q @ graph.centroids.T, 0))
    d /= np.maximum(d.min(axis=1), 1e-12)[:, None]
    found = places.assign(at=d[places["query"], places["list"]]).groupby(["query", "rep"])["at"].min()
    steps = np.unique(found.to_numpy())
    steps = steps[:: max(1, len(steps) // 2048)]
    steps = np.unique(np.append(steps, found.max()))
    share = np.stack([np.searchsorted(np.sort(x), steps, "right") / len(x) for _, x in found.groupby("query")])
    sure = share.mean(axis=0) - 2 * share.std(axis=0) / np.sqrt(len(share)) >= recall
    ratio = float(steps[sure.argmax()])  # with the last step everything is found
    return ratio, int((d <= ratio).sum(axis=1).max())


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    sample_rows: int = 262_144,
    list_rows: int = 256,
    replicas: int = 8,
    replica_ratio: float = 1.01,
    block_rows: int = 16_384,
    recall: float = 0.9,
    trial_queries: int = 256,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of rows for each query, by inner product in double precision.

    rows and queries have (vec_id long, embedding array<float or double>). A query's own vec_id is no candidate. Equal
    scores rank by vec_id. Unusable vectors, rows with null vec_id, and vectors of another length than the most frequent
    one of the rows (the shortest of equals) take no part. Rows that repeat count once; if one vec_id has several vectors,
    each is a candidate and each makes a query. Fewer than k candidates all come. Empty tables give an empty result; other
    columns are ignored.

    There is a list for every ``list_rows`` distinct vectors, at most one for every eight of ``sample_rows``; the sample is
    eight distinct vectors a list, those with the smallest hashes, so 32,768 lists at most, and beyond some eight million
    vectors lists grow with the table. The distance ratio has ``recall`` of the true neighbours of ``trial_queries`` distinct
    queries, those with the smallest hashes, which are compared with all rows.
    """

    kinds = {df.schema["embedding"].dataType.simpleString() for df in (rows, queries)}
    kind = "float" if kinds == {"array<float>"} else "double"  # floats are exact as they are and half as long

    def ready(df: DataFrame) -> DataFrame:
        df = only(df, "vec_id", "embedding").select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("vec"))
        return df.where(F.col("vec_id").isNotNull() & usable(F.col("vec"))).distinct()

    first = Window.partitionBy("vec").orderBy("vec_id")
    good = ready(rows)
    lengths = good.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return rows.sparkSession.createDataFrame([], empty)
    whole = F.size("vec") == lengths["length"]
    kept = good.where(whole).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    kept = kept.withColumn("rep", F.min("vec_id").over(Window.partitionBy("vec")))
    kept = materialize(kept, "vectors")
    reps = kept.where("nth = 1").select("rep", "vec")
    members = kept.select("rep", "vec_id")
    asked = ready(queries).where(whole)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, top = reps.agg(F.count("*"), F.max(norm)).first()
    leaves = max(1, min(n // list_rows, sample_rows // 8))
    sample = reps.orderBy(F.xxhash64("vec"), "rep").limit(max(8 * leaves, 2048)).select("vec").toPandas()["vec"]
    graph = CentroidGraph(fit_centroids(_lifted(_stack(sample), top), leaves))
    batch_rows = max(1, min(BATCH, DISTANCES_AT_ONCE // leaves))

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                part = batch.iloc[at : at + batch_rows]
                lists = _lists_of_vectors(_lifted(_stack(part["vec"]), top), graph, replicas, replica_ratio)
                which, nth = np.nonzero(lists >= 0)
                yield pd.DataFrame(
                    {
                        "list": lists[which, nth],
                        "home": nth == 0,
                        "rep": part["rep"].to_numpy()[which],
                        "vec": part["vec"].to_numpy()[which],
                    }
                )

    postings = reps.mapInPandas(assign, f"list int, home boolean, rep long, vec array<{kind}>")
    postings = materialize(postings, "postings")
    counts = postings.groupBy("list").agg(F.count("*"), F.sum(F.col("home").cast("int"))).collect()  # a row for a list
    size, homes = np.zeros(len(graph.centroids)), np.zeros(len(graph.centroids))
    for at, rows_in, home in counts:
        size[at], homes[at] = rows_in, home

    trial = asked.select("vec").distinct().orderBy(F.xxhash64("vec")).limit(trial_queries).toPandas()["vec"]
    ratio, width = 1.0, 1
    if len(trial) and len(homes) > 1:
        trial = _stack(trial)
        true = _true_neighbours(reps, trial, k)
        places = true.join(postings.select("rep", "list"), "rep").toPandas()  # k * replicas a trial query at most
        if len(places):
            trial *= np.sqrt(top / (trial**2).sum(axis=1))[:, None]
            ratio, width = _ratio_needed(graph, np.c_[trial, np.zeros(len(trial))], places, recall)

    shard, blocks = shards(size, block_rows)
    shard = np.array(shard)

    def lists_of(q: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of q, their lists): all lists within the ratio, and as many as hold k others than the query."""
        ids, d = graph.search(q, width)
        held = np.cumsum(homes[ids], axis=1)
        open_ = (d[:, -1] <= ratio * d[:, 0]) | (held[:, -1] < k + 1)  # perhaps more lists are wanted than were found
        if ids.shape[1] == len(homes):
            open_[:] = False
        take = ((d <= ratio * d[:, :1]) | (held - homes[ids] < k + 1)) & ~open_[:, None]
        which, nth = np.nonzero(take)
        yield which, ids[which, nth]
        rest = np.flatnonzero(open_)
        if len(rest):
            for which, lists in lists_of(q[rest], 2 * width):
                yield rest[which], lists

    def probe(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                part = batch.iloc[at : at + batch_rows]
                q = _stack(part["vec"])
                q *= np.sqrt(top / (q**2).sum(axis=1))[:, None]
                for which, lists in lists_of(np.c_[q, np.zeros(len(q))], width):
                    pairs = pd.DataFrame({"which": which, "shard": shard[lists], "list": lists})
                    pairs = pairs.groupby(["which", "shard"])["list"].agg(list).reset_index()
                    for cut in range(0, len(pairs), 1 << 14):
                        own = pairs.iloc[cut : cut + (1 << 14)]
                        rows_ = part.iloc[own["which"]]
                        yield pd.DataFrame({"shard": own["shard"].to_numpy(), "lists": own["list"].to_numpy(), "rep": rows_["rep"].to_numpy(), "vec": rows_["vec"].to_numpy()})

    # vec -> rep: the smallest id among the rows; queries that are not among the rows stand for themselves
    found = asked.join(reps.withColumnRenamed("rep", "known"), "vec", "left")
    found = found.select(F.col("vec_id").alias("query_id"), F.coalesce("known", "vec_id").alias("rep"), "vec")
    found = found.withColumn("group", F.xxhash64("vec", "rep"))
    found = materialize(found, "queries")
    distinct = found.groupBy("vec").agg(F.min("group").alias("rep"))
    spread = distinct.repartition(shuffle_partitions(rows.sparkSession), "rep")  # few bytes, but much work
    probed = materialize(spread.mapInPandas(probe, f"shard int, lists array<int>, rep long, vec array<{kind}>"), "probes")
    asks = {x[0]: -(-x[1] // block_rows) for x in probed.groupBy("shard").count().collect()}  # a row a shard
    plan = [(i, blocks[i], asks[i]) for i in range(len(blocks)) if i in asks]
    plan = F.broadcast(rows.sparkSession.createDataFrame(plan, "shard int, blocks int, asks int"))
    lists = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(shard.tolist())), "list int, shard int"))

    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = postings.join(lists, "list").join(plan, "shard")
    left = left.select("shard", deal("blocks").alias("block"), each("asks").alias("ask"), "list", "rep", "vec")
    right = probed.join(plan, "shard")
    right = right.select("shard", deal("asks").alias("ask"), each("blocks").alias("block"), "lists", "rep", "vec")
    key = ["shard", "block", "ask"]

    def compare(held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "rep": [], "score": []}
        if len(held) and len(asking):
            held = held.sort_values("list", kind="stable")
            at_list, asked_list = held["list"].to_numpy(), np.concatenate(asking["lists"].to_numpy())
            row = np.repeat(np.arange(len(asking)), asking["lists"].map(len))
            all_v, all_q = _stack(held["vec"]), _stack(asking["vec"])
            all_reps, queries_here = held["rep"].to_numpy(), asking["rep"].to_numpy()
            for one in np.unique(at_list):
                own = slice(np.searchsorted(at_list, one), np.searchsorted(at_list, one, "right"))
                add_best(out, all_v[own], all_reps[own], all_q, queries_here, row[asked_list == one])
        found = pd.DataFrame({c: np.concatenate(x) if x else np.empty(0) for c, x in out.items()})
        found = found.sort_values(["score", "rep"], ascending=[False, True], kind="stable").drop_duplicates(["query", "rep"])
        return found.groupby("query", sort=False).head(k + 1)

    def add_best(out: dict, v: np.ndarray, reps_here: np.ndarray, all_q: np.ndarray, queries_here: np.ndarray, rows_: np.ndarray) -> None:
        """The k + 1 best of one list for each of its queries."""
        most = min(k + 1, len(v))
        if most:
            for at in range(0, len(rows_), 256):
                q = all_q[rows_[at : at + 256]]
                rough = q @ v.T
                floor = -np.partition(-rough, most - 1, axis=1)[:, most - 1]
                slack = 1e-9 * (1 + np.abs(floor))
                i, j = np.nonzero(rough >= (floor - slack)[:, None])
                score = (q[i] * v[j]).sum(axis=1)  # each pair is summed in one order wherever it is met
                best = np.lexsort((reps_here[j], -score, i))
                i, j, score = i[best], j[best], score[best]
                start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                nth = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
                top_k = nth < most
                out["query"].append(queries_here[rows_[at + i[top_k]]])
                out["rep"].append(reps_here[j[top_k]])
                out["score"].append(score[top_k])

    hits = right.groupBy(key).cogroup(left.groupBy(key)).applyInPandas(
        lambda a, b: compare(b, a), "query long, rep long, score double"
    )
    hits = hits.groupBy("query", "rep").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    hits = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    hits = hits.drop("nth").join(members, "rep").withColumn("nth", F.row_number().over(order))
    hits = hits.where(F.col("nth") <= k + 1).select("query", "vec_id", "score")

    groups = distinct.select("vec", F.col("rep").alias("query"))
    asked = found.join(groups, "vec").select("query_id", "query").distinct()
    out = asked.join(hits, "query").where("query_id <> vec_id")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
