"""Row-level building blocks: last version of each key, skew-safe joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``order`` columns; ``keep`` are the other columns returned.

    An aggregate, so rows are reduced before the shuffle and a key with a third
    of all rows is no burden.  NULL order values count as earliest; of equal
    ones the row with the greatest ``keep`` values (in that order) holds, so the
    result does not depend on the row order.  NULL keys form a key of their own.
    """
    picked = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("_last")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in keep])


HEAVY_ROWS = 50_000  # a key with more rows is hot


BROADCAST_ROWS = 100_000  # most rows that are broadcast
SALTS = 32


def heavy_keys(df: DataFrame, key: str, limit: int = 1000, min_rows: int = HEAVY_ROWS) -> list:
    """The at most ``limit`` keys with the most rows, of those with more than ``min_rows`` rows.  Only counts are shuffled."""
    n = df.select(key).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return [r[0] for r in n.filter(F.col("_n") > min_rows).orderBy(F.desc("_n"), key).limit(limit).collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", limit: int = 1000, hot: list | None = None) -> DataFrame:
    """Equi-join on ``key`` of a side with hot keys (``left``) to one with few rows per key (``right``).

    The ``hot`` keys (default: found by :func:`heavy_keys`, at most ``limit``) are
    joined by broadcasting only their rows of ``right`` (if these are at most
    BROADCAST_ROWS, else by salting), so their left rows stay where they are; all
    other keys are joined by shuffle.  The result is that of
    ``left.join(right, key, how)`` for ``inner``, ``left`` and ``left_semi``.
    """
    hot = heavy_keys(left, key, limit) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.filter(~is_hot).join(right.filter(~is_hot), key, how)
    few = right.filter(is_hot)
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return cold.unionByName(left.filter(is_hot).join(F.broadcast(few), key, how))
    # too many rows to broadcast: the left rows of a hot key are dealt out to SALTS groups, each of which gets its right rows
    dealt = left.filter(is_hot).withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS)))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return cold.unionByName(dealt.join(copies, [key, "_salt"], how).drop("_salt"))


def struct_of(names: Sequence[str]) -> Column:
    return F.struct(*[F.col(n) for n in names])
