"""Per-entity feature table from events.

Events are folded once into a cumulative table (entity, type, day) with the
running count and total up to that day.  Every window feature is the
difference of two as-of endpoints of that table, recency is the greatest day.
The table has at most one row per entity, type and day, so neither an entity
nor a type with a third of all events makes a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative_table(events: DataFrame, entity: str, kind: str, day: str, amount: str) -> DataFrame:
    """(entity, kind, day, cum_n, cum_total): events and amount up to and including each day on which there are events.

    Events without entity or kind are left out.  A NULL day stays NULL and counts
    as the earliest (it precedes every window start); a NULL amount counts as 0.
    Amounts are summed as decimals of two places, so totals do not depend on
    the order of rows.
    """
    daily = (
        events.filter(F.col(entity).isNotNull() & F.col(kind).isNotNull())
        .groupBy(entity, kind, F.col(day).alias("day"))
        .agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(amount).cast("decimal(18,2)")), F.lit(0).cast("decimal(28,2)")).alias("total"))
    )
    w = Window.partitionBy(entity, kind).orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(entity, kind, "day", F.sum("n").over(w).alias("cum_n"), F.sum("total").over(w).alias("cum_total"))


def as_of_features(cum: DataFrame, entity: str, kind: str, as_of: str | None = None, windows: Sequence[int] = ()) -> DataFrame:
    """One row per entity and kind: n, total, last_day, recency_days, and n_<w>d, total_<w>d for each window of w days.

    ``as_of`` (yyyy-mm-dd) is the last day that counts; None takes all days, and
    windows and recency then end at the last day of the whole table.  Kinds
    without an event up to ``as_of`` have no row; events without a day count in
    n and total, but give no last_day and no recency.  An endpoint is the table's
    last row at or before a day, so a window costs two lookups, not a scan of
    its events.
    """
    if as_of is None:
        end = cum.agg(F.max("day").alias("_end"))
        cum = cum.join(F.broadcast(end), how="inner") if windows else cum.withColumn("_end", F.lit(None).cast("date"))  # one row
    else:
        cum = cum.withColumn("_end", F.lit(as_of).cast("date")).filter(F.col("day").isNull() | (F.col("day") <= F.col("_end")))
    cum = cum.withColumn("_d", F.coalesce("day", F.lit("0001-01-01").cast("date")))  # only to be compared

    def at(col: str, back: int):
        return F.max_by(col, F.when(F.col("_d") <= F.date_sub("_end", back), F.col("_d")))

    aggs = [F.max_by("cum_n", "_d").alias("n"), F.max_by("cum_total", "_d").alias("total"), F.max("day").alias("last_day"), F.max("_end").alias("_end")]
    for w in windows:
        aggs += [at("cum_n", w).alias(f"_n{w}"), at("cum_total", w).alias(f"_t{w}")]
    out = cum.groupBy(entity, kind).agg(*aggs)
    cols = [entity, kind, "n", "total", "last_day", F.date_diff("_end", "last_day").alias("recency_days")]
    for w in windows:
        cols += [(F.col("n") - F.coalesce(F.col(f"_n{w}"), F.lit(0))).alias(f"n_{w}d"), (F.col("total") - F.coalesce(F.col(f"_t{w}"), F.lit(0).cast("decimal(38,2)"))).alias(f"total_{w}d")]
    return out.select(*cols)


def feature_rows(features: DataFrame, entity: str, kind: str) -> DataFrame:
    """One row per entity: n_kinds, n, total, last_day and ``by_kind``, a map from kind to its feature struct.

    The map has at most one entry per kind, so its size is bounded by the
    number of event types, not of events.
    """
    values = [c for c in features.columns if c not in (entity, kind)]
    return features.groupBy(entity).agg(
        F.count("*").alias("n_kinds"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.max("last_day").alias("last_day"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(kind), F.struct(*values))))).alias("by_kind"),
    )


def feature_columns(features: DataFrame, entity: str, kind: str, kinds: Sequence, values: Sequence[str] = ("n", "total", "recency_days")) -> DataFrame:
    """One row per entity with columns <value>_<kind> for each given kind (one pivot; counts and totals of absent kinds are 0)."""
    cells = F.struct(*values)
    wide = features.groupBy(entity).pivot(kind, list(kinds)).agg(F.first(cells))
    cols = []
    for k in kinds:
        for v in values:
            c = F.col(f"`{k}`")[v]
            cols.append((F.coalesce(c, F.lit(0)) if v.startswith(("n", "total")) else c).alias(f"{v}_{k}"))
    return wide.select(entity, *cols)


def resolve_versions(rows: DataFrame, id_col: str, version: str, count_col: str, keep: Sequence[str]) -> DataFrame:
    """One row per event id out of its versions: the last version holds, and an id with any negative ``count_col`` is cancelled and left out.

    A NULL count is not negative; rows without an id are left out; NULL
    versions are earliest; ties are broken by the kept values.  One aggregate:
    rows are reduced before the shuffle.
    """
    agg = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(count_col).alias("_least"), F.max(F.struct(version, *keep)).alias("_last"))
    return agg.filter(F.coalesce(F.col("_least"), F.lit(0)) >= 0).select(id_col, *[F.col(f"_last.{c}").alias(c) for c in keep])
