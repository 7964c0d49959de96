"""Markov clustering and linked clusters against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from minespark.llm import mcl


def clusters(points, eps=1.0):
    ids = sorted(points)
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in ids:
        for j in ids:
            if i < j and math.dist(points[i], points[j]) <= eps * (1 + 1e-9):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    out = {}
    for i in ids:
        out.setdefault(find(i), set()).add(i)
    return {k: v for k, v in out.items() if len(v) >= 3}


def frame(spark, points):
    rows = [(i, float(x), float(y)) for i, (x, y) in points.items()]
    return spark.createDataFrame(rows, "id long, x double, y double").withColumn("cell", F.lit("clash")).withColumn("n", F.lit(1))


def got(df):
    out = {}
    for r in mcl.cluster_members(mcl.link_clusters(df, "id", "x", "y")[0]).collect():
        out.setdefault(r.cluster, set()).add(r.id)
        assert r.n >= 3
    return out


def test_random_points(spark):
    rng = random.Random(1)
    pts = {i: (round(rng.uniform(0, 25), 2), round(rng.uniform(-12, 12), 2)) for i in range(400)}
    assert got(frame(spark, pts)) == clusters(pts)


def test_chains_dense_spots_and_exact_distances(spark):
    rng = random.Random(2)
    pts = {i: (i * 1.0, 0.0) for i in range(30)}  # exactly 1 apart
    pts |= {100 + i: (50 + 0.3 * math.cos(i), 0.3 * math.sin(i * 7)) for i in range(150)}  # one dense spot
    pts |= {300 + i: (60 + 0.6 * i, 0.8 * i) for i in range(5)}  # 0.6, 0.8: distance 1
    pts |= {400: (70, 0), 401: (71.000001, 0), 402: (72.000002, 0)}  # just beyond
    pts |= {500 + i: (80 + rng.gauss(0, 0.05) + (i % 2) * 1.02, rng.gauss(0, 0.05)) for i in range(60)}  # two spots about 1 apart
    assert got(frame(spark, pts)) == clusters(pts)


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.5, 0.0), (3, None, 0.0), (4, float("nan"), 0.0), (None, 0.0, 0.0), (5, float("inf"), 0.0), (6, 0.0, 0.0), (7, 9.0, 9.0)], "id long, x double, y double")
    assert got(df) == {1: {1, 2, 6}}
    assert got(df.limit(0)) == {}
    assert got(df.filter("id in (1, 7)")) == {}


def test_typical_members_are_of_the_densest_part(spark):
    rng = random.Random(3)
    pts = {i: (rng.gauss(0, 0.6), rng.gauss(0, 0.6)) for i in range(200)}
    points, of_cell = mcl.link_clusters(frame(spark, pts), "id", "x", "y")
    t = mcl.typical_members(mcl.cluster_members(points), of_cell).collect()
    big = max(t, key=lambda r: r.n)
    assert len(big.typical) == 3 and all(math.hypot(*pts[i]) < 1.5 for i in big.typical)


def numpy_mcl(edges, n, inflation=2.0, keep=16, prune=0.01):
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[a, b] += w
        m[b, a] += w
    m[np.arange(n), np.arange(n)] = m.max(0)

    def cut(x):
        x = x.copy()
        for j in range(n):
            col = x[:, j]
            top = sorted(np.flatnonzero(col), key=lambda i: (-col[i], i))[:keep]
            on = np.zeros(n, bool)
            on[[i for i in top if col[i] >= col.max() * prune]] = True
            x[~on, j] = 0
        return x / x.sum(0)

    m = cut(m)
    for _ in range(30):
        m = cut((m @ m) ** inflation)
        if (m.max(0) - (m**2).sum(0)).max() < 1e-3:
            break
    r = np.round(m, 9)
    return {j: int(np.flatnonzero(r[:, j] == r[:, j].max())[0]) for j in range(n)}


def test_markov_against_dense_matrices(spark):
    rng = random.Random(4)
    edges = [(a, b, rng.choice([0.5, 1.0, 2.0])) for g in range(4) for a in range(g * 6, g * 6 + 6) for b in range(a + 1, g * 6 + 6) if rng.random() < 0.8] + [(5, 6, 0.1), (11, 12, 0.1), (17, 18, 0.1)]
    n = 24
    df = spark.createDataFrame(edges + [(3, 3, 5.0), (None, 1, 1.0)], "a long, b long, w double")
    parts, flow = mcl.markov_clusters(df, inflation=2.0, step=0.0, keep=16, jitter=0.0, settled=0.999)
    assert {r.node: r.attractor for r in parts.collect()} == numpy_mcl(edges, n)
    sums = flow.groupBy("j").agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.n <= 16 for r in sums)
    assert mcl.markov_clusters(df.limit(0))[0].count() == 0


def test_a_hub_joined_to_a_third_of_all_nodes(spark):
    edges = [(0, i, 1.0) for i in range(1, 300)] + [(i, i + 1, 1.0) for i in range(400, 900, 2)]
    parts, _ = mcl.markov_clusters(spark.createDataFrame(edges, "a long, b long, w double"))
    assert parts.count() == len({x for a, b, _ in edges for x in (a, b)})


def test_rows_come_from_the_flow(spark, monkeypatch):
    """Without flow nothing is merged, and that is told."""
    pts = frame(spark, {i: (i * 0.9, 0.0) for i in range(12)})
    assert got(pts) == {0: set(range(12))}

    def alone(edges, *a, **k):
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        return nodes.withColumn("attractor", F.col("node")), nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("w"))

    monkeypatch.setattr(mcl, "markov_clusters", alone)
    with pytest.raises(RuntimeError, match="without a merger"):
        got(pts)


def test_far_points_and_names_of_cells(spark):
    pts = {1: (6e8, 0.0), 2: (6e8 + 0.5, 0.0), 3: (6e8 + 1, 0.5), 4: (-6e12, 3.0), 5: (-6e12, 3.5), 6: (-6e12, 4.25), 7: (0.0, 0.0)}
    assert got(frame(spark, pts)) == {1: {1, 2, 3}, 4: {4, 5, 6}}
    with pytest.raises(Exception, match="too large"):
        got(frame(spark, {1: (1e30, 0.0)}))


def test_even_rings_chains_and_stars_end_whole(spark):
    ring = [(i, (i + 1) % 64, 1.0, 1.0) for i in range(64)]
    chain = [(i, i + 1, 1.0, 1.0) for i in range(100, 250)]
    star = [(300, i, 1.0, 1.0) for i in range(301, 400)]
    full = [(i, j, 1.0, 1.0) for i in range(500, 530) for j in range(i)  if j >= 500]
    names, _ = mcl.nested_clusters(spark.createDataFrame(ring + chain + star + full, "a long, b long, w double, v double"))
    groups = {}
    for r in names.collect():
        groups.setdefault(r.cluster, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(64)), list(range(100, 251)), list(range(300, 400)), list(range(500, 530))]


def test_flow_that_does_not_settle_is_told(spark):
    with pytest.raises(RuntimeError, match="not settled"):
        mcl.markov_clusters(spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)], "a long, b long, w double"), max_rounds=1)
