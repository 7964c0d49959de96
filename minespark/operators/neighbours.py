"""k-nearest-neighbour classification of a query set.

Queries are set against all training rows in blocks: a block of queries meets
a block of training rows in one matrix product, and only the k nearest of each
query leave it.  No pair of rows is ever a row of a table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minespark.operators.prep import is_numeric, one_hot, standardize

BLOCK = 4096


def features(df: DataFrame, key: str, label: str | None, vector: str = "v") -> DataFrame:
    """(key, label, v): numeric columns standardized, then string columns one-hot (0/1, not scaled); constant columns and NULLs count 0."""
    keep = [c for c in (key, label) if c]
    x = [c for c in df.columns if c not in keep]
    z = standardize(df, [c for c in x if is_numeric(df, c)])
    h = one_hot(z, [c for c in x if not is_numeric(df, c)])
    return h.select(*keep, F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in h.columns if c not in keep]).alias(vector))


def nearest(queries: DataFrame, train: DataFrame, key: str, vector: str, k: int, payload: str | None = None, exclude_self: bool = True, n_queries: int | None = None, n_train: int | None = None) -> DataFrame:
    """(query, neighbour, dist, payload, rank): the k nearest training rows of each query; ties go to the smaller key.

    Fewer than k candidates give fewer rows.  Rows with a NULL key or vector take no part.
    """
    q = queries.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).dropna()
    t = train.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), (F.col(payload) if payload else F.lit(None)).cast("string").alias("payload")).filter("id IS NOT NULL AND v IS NOT NULL")
    nq = -(-(q.count() if n_queries is None else n_queries) // BLOCK) or 1
    nt = -(-(t.count() if n_train is None else n_train) // (4 * BLOCK)) or 1
    q = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq))).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))))
    t = t.withColumn("tb", F.pmod(F.xxhash64("id"), F.lit(nt)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["query", "neighbour", "dist", "payload"], dtype=object)
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        qi, ti = a["id"].to_numpy(), b["id"].to_numpy()
        out = []
        for i in range(0, len(x), 512):
            p = x[i : i + 512]
            d = np.clip((p**2).sum(1)[:, None] - 2 * p @ y.T + (y**2).sum(1), 0, None)
            if exclude_self:
                d[qi[i : i + 512, None] == ti[None, :]] = np.inf
            lim = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
            r, c = np.nonzero((d <= lim[:, None] + 1e-9) & np.isfinite(d))
            e = np.sqrt(((p[r] - y[c]) ** 2).sum(1))
            order = np.lexsort((ti[c], np.round(e, 12), r))
            r, c, e = r[order], c[order], e[order]
            on = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
            out.append(pd.DataFrame({"query": qi[i + r[on]], "neighbour": ti[c[on]], "dist": e[on], "payload": b["payload"].to_numpy()[c[on]]}))
        return pd.concat(out)

    part = q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInPandas(meet, "query bigint, neighbour bigint, dist double, payload string")
    w = Window.partitionBy("query").orderBy(F.round("dist", 12), "neighbour")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def classify(near: DataFrame, k: int, ties: str = "smallest") -> DataFrame:
    """(query, pred): the most frequent payload of the first k; ties go to the smallest label, or to the nearest neighbour's."""
    near = near.filter(F.col("rank") <= k)
    if ties == "nearest":
        n = near.groupBy("query", "payload").agg(F.count("*").alias("n"), F.min("rank").alias("r"))
        return n.groupBy("query").agg(F.min_by("payload", F.struct((-F.col("n")).alias("n"), "r")).alias("pred"))
    return near.groupBy("query").agg(F.mode("payload", True).alias("pred"))


def best_k(near: DataFrame, labels: DataFrame, key: str, label: str, ks: Sequence[int]) -> DataFrame:
    """(k, accuracy) of leaving one out, for every k, from one distance pass with the greatest k."""
    votes = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("rank") <= F.col("k"))
    pred = votes.groupBy("k", "query").agg(F.mode("payload", True).alias("pred"))
    j = pred.join(labels.select(F.col(key).alias("query"), F.col(label).cast("string").alias("obs")), "query")
    return j.groupBy("k").agg(F.avg(F.coalesce((F.col("obs") == F.col("pred")).cast("double"), F.lit(0.0))).alias("accuracy"))
