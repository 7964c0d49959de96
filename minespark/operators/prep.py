"""Preparing tables: restriction vectors, one-hot, z-scores, imputation, sampling."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minespark.scratch import materialize


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def restrict(df: DataFrame, flags: Sequence[int], always: Sequence[str] = ()) -> DataFrame:
    """Keep the columns flagged 1, in order, and those of ``always``; one flag for each other column."""
    cols = [c for c in df.columns if c not in always]
    if len(flags) != len(cols):
        raise ValueError(f"{len(flags)} flags for {len(cols)} columns")
    return df.select(*always, *[c for c, f in zip(cols, flags) if f])


def sentinel_to_null(c: Column, sentinel: float = 99) -> Column:
    return F.when(c != sentinel, c)


def clip(c: Column, low: float, high: float) -> Column:
    """NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def at_least(c: Column, threshold: float) -> Column:
    """NULL counts as below."""
    return F.coalesce(c >= threshold, F.lit(False))


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and sample deviation of each column (NULLs are skipped)."""
    return df.agg(*[f(c).alias(f"{p}_{c}") for c in cols for p, f in (("_mean", F.avg), ("_std", F.stddev_samp))])


def standardize(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """z-scores (sample deviation) of the numeric columns; a constant column becomes NULL, which counts for nothing in distances.

    One aggregate, whose single row is broadcast.
    """
    cols = [c for c in df.columns if is_numeric(df, c)] if cols is None else list(cols)
    if not cols:
        return df
    z = {c: F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.nullif(F.col(f"_std_{c}"), F.lit(0.0))) for c in cols}
    return df.join(F.broadcast(moments(df, cols)), how="left").select(*[z[c].alias(c) if c in z else F.col(c) for c in df.columns])


def levels(df: DataFrame, cols: Sequence[str], most: int = 1000) -> dict[str, list]:
    """The sorted non-NULL values of each column; ValueError beyond ``most``, as such a column is no category."""
    out = {}
    if cols:
        n = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
        for c in cols:  # before any set of values is built
            if n[c] > 2 * most:
                raise ValueError(f"{c} has about {n[c]} values")
        got = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols]).first()
        out = {c: list(got[c]) for c in cols}
    for c, v in out.items():
        if len(v) > most:
            raise ValueError(f"{c} has {len(v)} values")
    return out


def one_hot(df: DataFrame, cols: Sequence[str] | None = None, values: dict[str, list] | None = None) -> DataFrame:
    """Replace each string column by 0/1 columns <column>_<value>, one for every value, in one projection."""
    cols = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType)] if cols is None else list(cols)
    values = levels(df, cols) if values is None else values
    out = []
    for c in df.columns:
        out += [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in values[c]] if c in cols else [F.col(c)]
    return df.select(*out)


def impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULLs become the exact median of numeric columns and the most frequent value (smallest on ties) of others."""
    best = df.agg(*[(F.percentile(c, 0.5) if is_numeric(df, c) else F.mode(c, True)).alias(f"_fill_{c}") for c in cols])
    j = df.join(F.broadcast(best), how="left")  # one row
    return j.select(*[F.coalesce(F.col(c), F.col(f"_fill_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def lot(seed: int, *keys: str) -> Column:
    """A BIGINT below 2^60 drawn for a key: the first 15 digits of the MD5 of ``seed:key``, which any other engine can draw too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), 1, 15), 16, 10).cast("bigint")


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same ones however the rows are partitioned (a top-n by hash; the limit is the operator)."""
    return df.orderBy(lot(seed, key), key).limit(n)


def sample_share(df: DataFrame, share: float, key: str, seed: int = 0) -> DataFrame:
    """About ``share`` of the rows, by hash of the key: one filter."""
    return df.filter(F.pmod(lot(seed, key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(lot(seed, key), key)


def with_rid(df: DataFrame, order: Sequence[str], name: str = "_rid") -> DataFrame:
    """Row numbers from 0 in a total order, by range partitions: counts per partition are added up, no single-task window."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = materialize(parts.withColumn("_mono", F.monotonically_increasing_id()))
    first = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_mono").alias("_mono0"))
    before = first.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return parts.join(F.broadcast(before.select("_part", "_mono0", "_before")), "_part").select((F.col("_before") + F.col("_mono") - F.col("_mono0")).alias(name), *df.columns)


def bootstrap(df: DataFrame, rid: str, n_rows: int, draws: int, seed: int = 0, copies: int = 1) -> DataFrame:
    """``draws`` rows drawn with replacement (exactly), for each of ``copies`` samples: column ``sample``; ``rid`` runs from 0 to n_rows - 1."""
    spark = df.sparkSession
    picks = spark.range(copies * draws).select((F.col("id") / draws).cast("int").alias("sample"), F.pmod(lot(seed, "id"), F.lit(n_rows)).alias(rid))
    return picks.join(df, rid)


def sample_columns(cols: Sequence[str], k: int, seed: int = 0) -> list[str]:
    return random.Random(seed).sample(list(cols), k)


def k_folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``fold`` from 1 to k; sizes differ by at most one.  Numbered in hash order by range partitions."""
    n = df.count()
    rows = with_rid(df.withColumn("_s", lot(seed, key)), ["_s", key], "_no")
    big, size = n % k, n // k
    cut = big * (size + 1)
    fold = F.when(F.col("_no") < cut, F.floor(F.col("_no") / (size + 1))).otherwise(big + F.floor((F.col("_no") - cut) / max(size, 1)))
    return rows.select(*df.columns, (fold + 1).cast("int").alias("fold"))


def holdout(df: DataFrame, key: str, share: float = 2 / 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A training and a test table without a common key, by hash."""
    train = F.pmod(lot(seed, key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    return df.filter(train), df.filter(~train)
