"""Recall on unit vectors without any structure, where lists far from the query hold neighbours too."""

import numpy as np
import pytest

from signalloom.llm import ann


@pytest.mark.parametrize("n", [2000, 5000])
def test_recall_does_not_fall_with_size(spark, n):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, 64))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), list_rows=8).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    exact, hits = v.astype(np.float64), 0
    for q in range(0, n, 20):
        score = exact @ exact[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits / (20 * len(found)) >= 0.9


def test_boundary_vectors_are_replicated_and_few_lists_are_read_in_clusters():
    rng = np.random.default_rng(8)
    flat = rng.normal(size=(4000, 64))
    flat /= np.linalg.norm(flat, axis=1)[:, None]
    centers = rng.normal(size=(100, 64))
    near = centers[rng.integers(0, 100, 4000)] + 0.3 * rng.normal(size=(4000, 64))
    shares = []
    for v in (flat, near):
        top = (v**2).sum(axis=1).max()
        points = ann._lifted(v, top)
        graph = ann.CentroidGraph(ann.fit_centroids(points[:1000], 100))
        lists = ann._lists_of_vectors(points, graph, 8, 1.02)
        assert 1.05 < (lists >= 0).sum() / len(v) < 8 and (lists[:, 0] >= 0).all()
        truth = [(q, r) for q in range(50) for r in np.argsort(-(v @ v[q]))[:20].tolist() if r != q]
        places = ann.pd.DataFrame([(q, r, x) for q, r in truth for x in lists[r] if x >= 0], columns=["query", "rep", "list"])
        q = np.c_[v[:50] * np.sqrt(top / (v[:50] ** 2).sum(axis=1))[:, None], np.zeros(50)]
        ratio, width = ann._ratio_needed(graph, q, places, 0.9)
        d = np.sqrt(((q[:, None] - graph.centroids) ** 2).sum(axis=2))
        read = d <= ratio * d.min(axis=1)[:, None]
        hits = [read[a, lists[b][lists[b] >= 0]].any() for a, b in truth]
        assert np.mean(hits) >= 0.9 and read.sum(axis=1).max() == width
        shares.append(read.mean())
    assert shares[1] < 0.3 < shares[0]


def test_ties_repeats_lengths_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 5), (2, [1.0, 0.0], 5), (2, [1.0, 0.0], 6), (3, [0.0, 1.0], 5), (4, [1.0], 5), (20, [1.0, 0.0], 5), (40, [2.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got)] == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 0.0)]
