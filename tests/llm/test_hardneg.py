"""Hard negatives against a comparison of everything: clusters, copies, odd rows, big numbers, and what the tree leaves out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import hardneg, registry

SCHEMA = "vec_id long, label int, vec array<double>, score long, leaf int"


def clustered(n, dim, groups, seed=1, spread=9):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-90, 90, (groups, dim))
    own = rng.integers(0, groups, n)
    return [(i, int(rng.integers(0, 4)), [float(x) for x in centres[own[i]] + rng.integers(-spread, spread + 1, dim)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, 4) for r in rows], SCHEMA)


def found(spark, rows, each=10, **how):
    got = hardneg.mine(frame(spark, rows), F.col("vec_id") % each == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize(
    ("rows", "how"),
    [
        (clustered(400, 6, 12), {}),
        (clustered(400, 6, 12), {"leaf_rows": 8, "shard_rows": 30, "ask_rows": 7}),
        (clustered(90, 3, 1, spread=2), {"leaf_rows": 5}),  # many equal vectors and scores
        ([(i, i % 2, [1.0, 2.0]) for i in range(70)] + [(i, i % 3, [-2.0, 5.0]) for i in range(70, 90)], {"leaf_rows": 4, "shard_rows": 9}),
        ([(i, 0, [float(i), 1.0]) for i in range(30)], {}),  # one label: no negatives
        ([(i, i, [float(i), 1.0]) for i in range(30)], {}),  # no positives
        ([(0, 1, [0.0, 0.0]), (1, 1, [3.0, 4.0]), (2, 2, [1.0, 1.0])], {}),  # scores of zero are in the window of zero
    ],
)
def test_equals_brute_force(spark, rows, how):
    assert found(spark, rows, **how) == hardneg.brute_force(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    rows = clustered(60, 4, 3)
    odd = [(None, 1, [1.0] * 4), (200, None, [1.0] * 4), (210, 1, None), (220, 1, [1.0, None, 1.0, 1.0]), (230, 1, [float("nan")] * 4)]
    odd += [(240, 1, [float("inf")] * 4), (250, 1, []), (260, 1, [1.0] * 3), *rows[:7]]
    assert found(spark, rows + odd) == hardneg.brute_force(rows, lambda i: i % 10 == 0)
    assert found(spark, []) == []
    assert found(spark, odd[:5]) == []


def test_scores_beyond_doubles_are_exact_and_beyond_64_bits_refused(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [float(rng.randrange(1 << 30)) for _ in range(4)]) for i in range(40)]
    assert found(spark, rows) == hardneg.brute_force(rows, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="64 bits|double precision"):
        found(spark, [(i, i % 2, [float(1 << 40)] * 4) for i in range(20)])


def test_the_tree_leaves_out_what_the_window_does_not_meet():
    rows = np.array([r[2] for r in clustered(4000, 8, 40, spread=3)])
    top = (rows**2).sum(axis=1).max()
    points = np.c_[rows, np.sqrt(top - (rows**2).sum(axis=1))]
    tree = hardneg.Tree(points[:1000], 4000, 64)
    leaf, m = tree.place(points), tree.arity
    low, high = np.full((len(tree.nodes), m, m), np.inf), np.full((len(tree.nodes), m, m), -np.inf)
    tree.measure(points, leaf, low, high)
    for node in tree.nodes:
        k = len(node.points)
        node.low, node.high = low[node.number, :k, :k], high[node.number, :k, :k]
    q = np.c_[rows[:100], np.zeros(100)]
    d = hardneg.distances(q, points)
    inner, outer = np.quantile(d, 0.02, axis=1), np.quantile(d, 0.06, axis=1)
    which, asked = tree.ask(q, inner, outer, 1e-3)
    pairs = set(zip(which.tolist(), asked.tolist()))
    for i, j in zip(*np.nonzero((d >= inner[:, None]) & (d <= outer[:, None]))):
        assert (i, leaf[j]) in pairs
    assert len(pairs) < 0.5 * 100 * len(np.unique(leaf))


def test_whole_numbers(spark):
    df = spark.createDataFrame([([0.5, -0.001, 1e18],)], "v array<float>").select(hardneg.whole_numbers(F.col("v")).alias("v"))
    assert df.first().v == [128.0, -1.0, float(np.float32(1e18)) * 256]


def test_query_relabels(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 10)), [float(x) for x in rng.normal(size=5)]) for i in range(500)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["op11_hard_negatives"](spark, str(tmp_path)).collect()
    whole = [(i, (c + 1) % 10 if i % 7 == 0 else c, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, c, v in rows]
    assert sorted(tuple(r) for r in got) == hardneg.brute_force(whole, lambda i: i % 100 == 0)
