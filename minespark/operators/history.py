"""History of changing attributes from periodic full snapshots.

Consecutive snapshots are compared by one null-safe full outer join (each
snapshot against the one a period before); inserted, changed and deleted keys
become change events, and ``lead`` over a key's events closes its versions.
A key has at most one row per period after the last delivery of each period is
picked, so no key is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fill_within_runs(snap: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Replace NULL by the last known value of the same run of consecutive periods; periods before the first known value are dropped."""
    w = Window.partitionBy(key).orderBy(period)
    run = snap.withColumn("_run", F.col(period) - F.row_number().over(w))
    fill = Window.partitionBy(key).orderBy("_run", period).rowsBetween(Window.unboundedPreceding, 0)
    # a value of an earlier run is told by its run number
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col("_run").alias("r"), F.col(value).alias("v"))), ignorenulls=True).over(fill)
    return run.withColumn("_f", last).filter(F.col("_f.r") == F.col("_run")).select(key, period, F.col("_f.v").alias(value))


def change_events(snap: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """(key, period, value, kind): kind is inserted, changed or deleted against the period before; unchanged keys give no event.

    ``snap`` has at most one row per key and period, no NULL key.  NULL is a
    value of its own.  A key that is in the last period gets a ``deleted`` event
    one period after it, which ends its open version.
    """
    cur = snap.select(key, period, F.col(value).alias("_cur"), F.lit(True).alias("_is"))
    prev = snap.select(F.col(key).alias("_key"), (F.col(period) + 1).alias("_period"), F.col(value).alias("_prev"), F.lit(True).alias("_was"))
    # partitioned by key alone, as the rows already are; a key has few periods, which are matched as a condition
    both = cur.join(prev, (F.col(key) == F.col("_key")) & (F.col(period) - F.col("_period") == 0), "full_outer")
    both = both.withColumns({key: F.coalesce(key, "_key"), period: F.coalesce(period, "_period")})
    kind = (
        F.when(F.col("_was").isNull(), "inserted")
        .when(F.col("_is").isNull(), "deleted")
        .when(~F.col("_cur").eqNullSafe(F.col("_prev")), "changed")
    )
    return both.select(key, period, F.col("_cur").alias(value), kind.alias("kind")).filter(F.col("kind").isNotNull())


def versions(snap: DataFrame, key: str, period: str, value: str, carry_nulls: bool = True) -> DataFrame:
    """(key, value, valid_from, valid_to, n_versions): longest runs of consecutive periods with the same value.

    ``carry_nulls``: a NULL keeps the last known value of the run of periods;
    otherwise NULL is a value of its own.  A period without a row ends the
    version.  Rows with a NULL key or period are left out.  Of several rows of a
    key and period only one may be given (see ``latest_rows``).
    """
    snap = snap.select(F.col(key).alias("_k"), F.col(period).alias("_p"), F.col(value).alias("_v")).filter(F.col("_k").isNotNull() & F.col("_p").isNotNull())
    if carry_nulls:
        snap = fill_within_runs(snap, "_k", "_p", "_v")
    ev = change_events(snap, "_k", "_p", "_v")
    w = Window.partitionBy("_k").orderBy("_p")
    out = ev.select("_k", "_v", "kind", F.col("_p").cast("bigint").alias("valid_from"), (F.lead("_p").over(w) - 1).cast("bigint").alias("valid_to"))
    out = out.filter(F.col("kind") != "deleted")
    return out.select(F.col("_k").alias(key), F.col("_v").alias(value), "valid_from", "valid_to", F.count("*").over(Window.partitionBy("_k")).alias("n_versions"))
