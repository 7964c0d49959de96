"""Nearest vectors against brute force: exact, with ties, copies and hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from minespark.llm import knn


def brute(ids, x, k):
    d = np.round(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 12)
    out = {}
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (d[i, j], ids[j]))
        out[a] = [ids[j] for j in order[:k]]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "id long, v array<double>").withColumn("rep", F.lit("clash")).withColumn("bin", F.lit(0))


def result(df, **kw):
    return {r.id: [n.id for n in r.neighbours] for r in knn.knn(df, "id", "v", **kw).collect()}


@pytest.mark.parametrize("small", [False, True])
def test_exact(spark, small, monkeypatch):
    rng = np.random.default_rng(1)
    n = 60 if small else 900
    ids = rng.permutation(10_000)[:n]
    x = np.concatenate([rng.integers(0, 4, (n // 2, 4)), rng.normal(0, 3, (n - n // 2, 4))]).astype(float)  # many ties and copies in the first half
    monkeypatch.setattr(knn, "BIN_ROWS", 50)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    assert result(frame(spark, ids, x), k=5) == brute(ids.tolist(), x, 5)


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.zeros((200, 3)), rng.normal(0, 1, (400, 3))])
    ids = rng.permutation(600)
    assert result(frame(spark, ids, x), k=5) == brute(ids.tolist(), x, 5)


def test_few_null_and_empty(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [0.0, 0.0]), (4, [float("nan"), 0.0]), (5, [None, 0.0])], "id long, v array<double>")
    assert result(df, k=5) == {1: [2], 2: [1]}
    assert knn.knn(df.limit(0), "id", "v").count() == 0
    assert result(df.filter("id = 1"), k=3) == {1: []}


def test_calibrated_recall(spark, monkeypatch):
    monkeypatch.setattr(knn, "BIN_ROWS", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (1500, 6))
    ids = np.arange(1500)
    want = brute(ids.tolist(), x, 5)
    got = result(frame(spark, ids, x), k=5, recall=0.95, calibration_rows=150)
    hit = np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want])
    assert hit >= 0.9


def test_boxes_bound_all_members():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 3))
    t = knn.fit_tree(x, 20)
    leaf = t.assign(x)
    assert leaf.max() + 1 <= t.leaves
    t.low, t.high = np.full((t.leaves, 3), np.inf), np.full((t.leaves, 3), -np.inf)
    np.minimum.at(t.low, leaf, x)
    np.maximum.at(t.high, leaf, x)
    t.bins = np.arange(t.leaves)
    q, b = t.next_bins(x[:20], np.full(20, 0.5), [[leaf[0]]] * 20, np.full(20, 1000))
    near = {(i, leaf[j]) for i in range(20) for j in range(500) if leaf[j] != leaf[0] and ((x[i] - x[j]) ** 2).sum() <= 0.5}
    assert near <= set(zip(q.tolist(), b.tolist()))


def test_the_queue_yields_bins_by_distance():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (3000, 4))
    t = knn.fit_tree(x, 10)
    leaf = t.assign(x)
    t.low, t.high = np.full((t.leaves, 4), np.inf), np.full((t.leaves, 4), -np.inf)
    np.minimum.at(t.low, leaf, x)
    np.maximum.at(t.high, leaf, x)
    t.bins = np.arange(t.leaves) // 3
    q, home = rng.normal(0, 2, (50, 4)), rng.integers(0, t.bins.max() + 1, 50)
    gap = np.maximum(np.maximum(t.low[None] - q[:, None], q[:, None] - t.high[None]), 0)
    box = (gap**2).sum(2)
    best = np.array([[box[i, t.bins == b].min() for b in range(t.bins.max() + 1)] for i in range(50)])
    got: dict = {i: [] for i in range(50)}
    limit = np.quantile(best, 0.7, axis=1)
    for width in (2, 5, 100_000):  # in three rounds, each going on where the last one ended
        for i, b in zip(*t.next_bins(q, limit, [[home[i], *got[i]] for i in range(50)], np.full(50, width))):
            got[int(i)].append(int(b))
    for i in range(50):
        want = [b for b in range(best.shape[1]) if b != home[i] and best[i, b] <= limit[i]]
        assert sorted(got[i]) == want and np.all(np.diff(best[i, got[i]]) >= 0)
    assert np.all(np.diff(np.take_along_axis(best, t.box_order(q), 1), axis=1) >= 0)


def test_boxes_at_equal_distance(spark, monkeypatch):
    """Bounds that tighten between rounds must not change which bins count as visited."""
    monkeypatch.setattr(knn, "BIN_ROWS", 30)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 3, (1500, 6)), rng.integers(0, 2, (500, 6)) + 0.5]).astype(float)
    ids = rng.permutation(5000)[:2000]
    assert result(frame(spark, ids, x), k=5) == brute(ids.tolist(), x, 5)


def test_large_leaves_are_fitted_again(spark, monkeypatch):
    monkeypatch.setattr(knn, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(knn, "LEAF_ROWS", 10)
    monkeypatch.setattr(knn, "BIN_ROWS", 60)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (2500, 3)), rng.normal(40, 0.01, (500, 3))])
    ids = rng.permutation(3000)
    df = frame(spark, ids, x)
    vecs = knn.distinct_vectors(df.select("id", "v"), "id", "v", 6)
    tree, placed = knn.build_tree(vecs, 3000)
    sizes = [r["count"] for r in placed.groupBy("leaf").count().collect()]
    assert tree.leaves > 3000 / 40 and max(sizes) <= 60 and sorted(v for v in tree.leaf_no if v >= 0) == list(range(tree.leaves))
    assert result(df, k=5) == brute(ids.tolist(), x, 5)
