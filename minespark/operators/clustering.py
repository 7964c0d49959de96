"""k-means with farthest-first start, DBSCAN and agglomerative clustering."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minespark.functions import linalg as L
from minespark.operators.components import connected_components
from minespark.operators.prep import lot, moments, standardize, with_rid
from minespark.scratch import materialize


def points(df: DataFrame, rid: str, cols: Sequence[str], scale: bool = True) -> DataFrame:
    """(rid, v): the columns as a vector, standardized; a constant column or NULL counts 0."""
    z = standardize(df.select(rid, *cols), cols) if scale else df
    return z.select(F.col(rid).alias("rid"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias("v"))


def _vec(x: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def farthest_first(p: DataFrame, k: int) -> list[list[float]]:
    """Start centroids: the point farthest from the mean, then always the one with the greatest sum of distances to those chosen; ties go to the smaller rid."""
    dim = len(p.first()["v"])
    mean = p.agg(*[F.avg(p["v"][i]) for i in range(dim)]).first()
    chosen: list = []
    ids: list = []
    score: Column | None = L.dist(F.col("v"), _vec(mean))
    for i in range(k):
        row = p.filter(~F.col("rid").isin(ids) if ids else F.lit(True)).select("rid", "v", F.round(score, 10).alias("s")).orderBy(F.desc("s"), "rid").limit(1).collect()
        if not row:
            break
        ids.append(row[0]["rid"])
        chosen.append(list(row[0]["v"]))
        d = L.dist(F.col("v"), _vec(chosen[-1]))
        score = d if i == 0 else score + d
    return chosen


def random_start(p: DataFrame, k: int, seed: int = 0) -> list[list[float]]:
    """``k`` rows picked by hash."""
    return [list(r["v"]) for r in p.orderBy(lot(seed, "rid"), "rid").limit(k).collect()]


def assign(p: DataFrame, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """``p`` with cluster (smallest on ties) and err, the distance: centroids are literals, so there is no join."""
    ds = F.array(*[L.dist(F.col("v"), _vec(c)) for c in centroids])
    q = p.withColumn("_d", ds).withColumn("err", F.array_min("_d"))
    return q.withColumn("cluster", (F.array_position("_d", F.col("err")) - 1).cast("int")).drop("_d")


@dataclass
class KMeans:
    centroids: list[list[float]]
    assigned: DataFrame
    iterations: int


def kmeans(p: DataFrame, k: int, start: Sequence[Sequence[float]] | None = None, max_iterations: int = 100) -> KMeans:
    """Lloyd's rounds over (rid, v) until memberships repeat or centroids move no more than a relative 1e-5.

    Every round is one aggregate; only k centroids come to the driver.  An empty
    cluster's centroid is the origin.  ``err`` is measured against the centroids
    before their last move.
    """
    p = materialize(p.select("rid", "v"))
    if p.limit(1).count() == 0:
        return KMeans([], p.withColumn("err", F.lit(0.0)).withColumn("cluster", F.lit(0)), 0)
    c = [list(x) for x in start] if start is not None else farthest_first(p, k)
    dim, state, used = len(c[0]), None, c
    for it in range(1, max_iterations + 1):
        used = c
        a = assign(p, c)
        got = a.groupBy("cluster").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("h"), *[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)]).collect()
        members = {r["cluster"]: (r["n"], r["h"]) for r in got}
        c = [[0.0] * dim for _ in used]
        for r in got:
            c[r["cluster"]] = [r[f"m{i}"] for i in range(dim)]
        if members == state or np.allclose(c, used):
            break
        state = members
    return KMeans(c, assign(p, used), it)


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """(cluster, n, min_err, max_err, avg_err, sse)."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.min("err").alias("min_err"), F.max("err").alias("max_err"), F.avg("err").alias("avg_err"), F.sum(F.col("err") * F.col("err")).alias("sse"))


def centroid_distances(centroids: Sequence[Sequence[float]]) -> list[tuple[int, int, float]]:
    return [(i, j, float(math.dist(a, b))) for (i, a), (j, b) in itertools.permutations(enumerate(centroids), 2)]


def original_scale(df: DataFrame, cols: Sequence[str], centroids: Sequence[Sequence[float]]) -> list[list[float]]:
    """Standardized centroids in the columns' own units."""
    m = moments(df, cols).first()
    return [[x * (m[f"_std_{c}"] or 0.0) + m[f"_mean_{c}"] for x, c in zip(v, cols)] for v in centroids]


# -- DBSCAN ------------------------------------------------------------------


def neighbour_pairs(p: DataFrame, eps: float, grid_dims: int = 3) -> DataFrame:
    """(a, b): ordered pairs of points with a distance above 0 and at most ``eps``.

    Points meet only in neighbouring cells of a grid of side ``eps`` over the
    first ``grid_dims`` dimensions: an equi-join on the cell, no nested loop.
    """
    first = p.first()
    if first is None:
        return p.select(F.col("rid").alias("a"), F.col("rid").alias("b")).limit(0)
    dims = min(grid_dims, len(first["v"]))
    cell = [F.floor(F.col("v")[i] / eps) for i in range(dims)]
    right = p.select(F.col("rid").alias("b"), F.col("v").alias("w"), *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    steps = F.array(*[F.array(*[F.lit(x) for x in s]) for s in itertools.product((-1, 0, 1), repeat=dims)])
    left = p.select(F.col("rid").alias("a"), "v", *[c.alias(f"g{i}") for i, c in enumerate(cell)], F.explode(steps).alias("_s"))
    left = left.select("a", "v", *[(F.col(f"g{i}") + F.col("_s")[i]).alias(f"c{i}") for i in range(dims)])
    d = L.dist(F.col("v"), F.col("w"))
    return left.join(right, [f"c{i}" for i in range(dims)]).filter((F.col("a") != F.col("b")) & (d > 0) & (d <= eps)).select("a", "b")


def dbscan(p: DataFrame, eps: float, min_points: int) -> DataFrame:
    """(rid, cluster, kind) over (rid BIGINT, v): kind is core, border or noise; noise has cluster -1.

    A core point has at least ``min_points`` neighbours, itself and exact copies
    not counted.  Clusters are numbered by their smallest core point; a border
    point belongs to the lowest-numbered cluster near it.
    """
    p = materialize(p.select(F.col("rid").cast("bigint").alias("rid"), "v"))
    pairs = materialize(neighbour_pairs(p, eps))
    core = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= min_points).select("a"))
    links = pairs.join(core, "a", "left_semi").join(core.select(F.col("a").alias("b")), "b", "left_semi")
    comp = connected_components(links.filter("a < b").unionByName(core.select("a", F.col("a").alias("b"))), "a", "b")
    comp = materialize(comp)
    roots = comp.select("component").distinct()
    number = with_rid(roots, ["component"], "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    cores = comp.join(number, "component").select(F.col("node").alias("rid"), "cluster")
    cores = materialize(cores)
    border = pairs.join(cores.select(F.col("rid").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("rid")).agg(F.min("cluster").alias("cluster")).join(cores, "rid", "left_anti")
    known = cores.withColumn("kind", F.lit("core")).unionByName(border.select("rid", "cluster").withColumn("kind", F.lit("border")))
    return p.select("rid").join(known, "rid", "left").select("rid", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("kind", F.lit("noise")).alias("kind"))


def noise_share(labels: DataFrame) -> DataFrame:
    """One row: outliers in percent, to one digit."""
    return labels.agg(F.round(100 * F.avg((F.col("cluster") == -1).cast("double")), 1).alias("outlier_percent"))


# -- agglomerative -----------------------------------------------------------


@dataclass
class Dendrogram:
    """Merges in order: (left, right, new, height, size); leaves are 0 .. n-1, new nodes follow."""

    n: int
    merges: list[tuple[int, int, int, float, int]]

    def children(self, node: int) -> tuple[int, int] | None:
        return None if node < self.n else self.merges[node - self.n][:2]

    def height(self, node: int) -> float:
        return 0.0 if node < self.n else self.merges[node - self.n][3]

    @property
    def root(self) -> int:
        return self.n - 1 + len(self.merges) if self.merges else 0

    def leaves(self, node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            kids = self.children(x)
            if kids is None:
                out.append(x)
            else:
                todo += [kids[1], kids[0]]
        return out

    def heights(self) -> list[float]:
        return sorted((m[3] for m in self.merges), reverse=True)

    def cut(self, threshold: float, by: str = "height") -> list[list[int]]:
        """Clusters of leaves: the tallest node is opened while it is above the height, or while there are fewer clusters than wanted."""
        q = [self.root] if self.n else []
        while q:
            q.sort(key=self.height, reverse=True)
            top = q[0]
            if self.children(top) is None or (self.height(top) <= threshold if by == "height" else len(q) >= threshold):
                break
            q = [*q[1:], *self.children(top)]
        return [self.leaves(x) for x in q]

    def cut_without_outliers(self, n_clusters: int) -> tuple[list[list[int]], list[int]]:
        """Clusters, and the single points that were split off and removed on the way."""
        q, out = ([self.root] if self.n else []), []
        while len(q) < n_clusters:
            q.sort(key=self.height, reverse=True)
            if not q or self.children(q[0]) is None:
                break
            kids = self.children(q.pop(0))
            for x in kids:
                (out if self.children(x) is None else q).append(x)
        return [self.leaves(x) for x in q], out

    def to_json(self, rows: Sequence[Sequence[float]]) -> str:
        def build(i: int, top: bool) -> dict:
            kids = self.children(i)
            if kids is None:
                return {"type": "leaf", "height": 0, "data": ", ".join(map(str, rows[i]))}
            return {"type": "root" if top else "node", "height": self.height(i), "nodes": [build(x, False) for x in kids]}

        return json.dumps(build(self.root, True), indent=1)


def linkage(x: np.ndarray, link: str = "average", metric=None) -> Dendrogram:
    """The merges of the nearest two clusters, the first pair in row-major order on ties.

    ``link``: average, single, complete, or centroid (of all member points).
    Quadratic in the number of points, which is why ``hclust`` bounds it.
    """
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2)) if metric is None else np.array([[metric(a, b) for b in x] for a in x])
    d = d.astype(float)
    np.fill_diagonal(d, np.inf)
    ids, size, mean = list(range(n)), np.ones(n), x.astype(float).copy()
    live = np.ones(n, dtype=bool)
    merges = []
    for step in range(n - 1):
        flat = np.where(np.triu(live[:, None] & live[None, :], 1), d, np.inf)
        i, j = np.unravel_index(int(np.round(flat, 12).argmin()), flat.shape)
        h = float(d[i, j])
        merges.append((ids[i], ids[j], n + step, h, int(size[i] + size[j])))
        if link == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        elif link == "single":
            new = np.minimum(d[i], d[j])
        elif link == "complete":
            new = np.maximum(d[i], d[j])
        else:
            mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
            new = np.sqrt(((mean - mean[i]) ** 2).sum(1))
        new[i] = np.inf
        d[i], d[:, i] = new, new
        live[j] = False
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        ids[i] = n + step
    return Dendrogram(n, merges)


def hclust(df: DataFrame, cols: Sequence[str], scale: bool = True, link: str = "average", max_points: int = 2000) -> tuple[list, Dendrogram]:
    """The points in the order of all columns, and their dendrogram.

    Merging is sequential and needs all distances, so tables of more than
    ``max_points`` rows are refused (ValueError) rather than collected.
    """
    rows = df.select(*cols).dropna()
    if rows.limit(max_points + 1).count() > max_points:
        raise ValueError(f"more than {max_points} points")
    z = standardize(rows.select(*[F.col(c).cast("double").alias(c) for c in cols])) if scale else rows
    both = rows.orderBy(*cols).collect()
    x = np.array([[float(v or 0.0) for v in r] for r in z.orderBy(*cols).collect()]) if both else np.zeros((0, len(cols)))
    return both, linkage(np.nan_to_num(x), link) if len(both) else Dendrogram(0, [])


def radius(assigned: DataFrame) -> DataFrame:
    """(cluster, radius): the greatest distance of a member from its centroid."""
    return assigned.groupBy("cluster").agg(F.max("err").alias("radius"))
