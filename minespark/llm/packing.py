"""Filling containers of fixed capacity with items, by harmonic packing.

Item sizes fall into reciprocal-capacity classes: class j has the sizes above
C/(j+1) up to C/j, so j of its items always fit into one container.  Workers
pack their share of the items independently, class by class, with a fixed
number of items a container; nothing is sorted by size and no state is shared.
Room left in the containers of larger items is used first: a container with
room for C/t takes an item of class t, and the smallest items run through the
room that remains.

Only items larger than the capacity are cut: into full containers and a rest,
which is packed like an item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = 24  # sizes up to C/24 are the smallest class
SHARE_ROWS = 50_000  # wanted items of a worker's share


def harmonic(sizes: np.ndarray, capacity: int, classes: int = CLASSES) -> np.ndarray:
    """The container (0, 1, ...) of each item; sizes are at most ``capacity``.

    Items are taken in the order given.  Size 0 belongs to the smallest class.
    """
    n = len(sizes)
    where = np.full(n, -1, dtype=np.int64)
    cls = np.minimum(capacity // np.maximum(sizes, 1), classes)
    room = np.zeros(0, dtype=np.int64)
    for j in range(1, classes):
        items = np.flatnonzero(cls == j)
        while len(items):  # one item of class j into each container that has room for C/j
            bins = np.flatnonzero(room * j >= capacity)[: len(items)]
            if not len(bins):
                break
            now, items = items[: len(bins)], items[len(bins) :]
            where[now] = bins
            room[bins] -= sizes[now]
        if len(items):  # the others: j of them a container
            own = np.arange(len(items)) // j
            where[items] = len(room) + own
            room = np.concatenate([room, capacity - np.bincount(own, weights=sizes[items]).astype(np.int64)])
    small = np.flatnonzero(cls == classes)
    total = np.concatenate([[0], np.cumsum(sizes[small])])
    at = 0
    for b in np.flatnonzero(room > 0) if len(small) else ():
        to = int(np.searchsorted(total, total[at] + room[b], side="right")) - 1
        where[small[at:to]] = b
        at = to
        if at == len(small):
            break
    b = len(room)
    while at < len(small):
        to = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        where[small[at:to]] = b
        at, b = to, b + 1
    return where


def pack(items: DataFrame, kinds: DataFrame, item: str, size: str, kind: str, capacity: str, n_items: int | None = None) -> DataFrame:
    """(kind, bin, item, piece, token_start, n_tokens): the containers of every kind, each with all items.

    ``items``: unique ids and sizes of 0 or more; rows with a NULL id or size
    are left out.  ``kinds``: ids and capacities of at least 1, a table of at
    most 1,000 rows.  ``bin`` is unique within a kind.  No item is cut unless it
    exceeds the capacity; then all its pieces but the last fill a container
    each.  Results do not depend on the order or partitions of the rows.
    """
    got = kinds.filter(F.col(kind).isNotNull() & (F.col(capacity) > 0)).select(F.col(kind).cast("bigint"), F.col(capacity).cast("bigint")).limit(1001).collect()
    if len(got) > 1000:
        raise ValueError("more than 1,000 kinds of containers")
    every = F.array(*[F.struct(F.lit(k).cast("bigint").alias("kind_id"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(got)])
    items = items.filter(F.col(item).isNotNull() & (F.col(size) >= 0)).select(F.col(item).alias("item_id"), F.col(size).cast("bigint").alias("size"))
    n = items.count() if n_items is None else n_items
    shares = max(1, round(n / SHARE_ROWS))
    each = items.withColumn("share", F.pmod(F.xxhash64("item_id"), F.lit(shares)))
    each = each.withColumn("_k", F.explode(every if got else F.array().cast("array<struct<kind_id:bigint,capacity:bigint>>"))).select("item_id", "size", "share", "_k.kind_id", "_k.capacity")  # every kind packs every item

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("item_id", kind="stable")
        cap, share = int(b["capacity"].iloc[0]), int(b["share"].iloc[0])
        size = b["size"].to_numpy()
        cuts = np.where(size > cap, (size - 1) // cap, 0)  # full pieces before the rest
        rest = size - cuts * cap
        own = harmonic(rest, cap)
        full = int(own.max(initial=-1)) + 1
        at = np.repeat(np.arange(len(b)), cuts + 1)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(cuts + 1) - (cuts + 1), cuts + 1)
        last = piece == cuts[at]
        bins = np.where(last, own[at], full + np.cumsum(~last) - 1)
        return pd.DataFrame(
            {"kind_id": b["kind_id"].iloc[0], "bin": share * (1 << 32) + bins, "item_id": b["item_id"].to_numpy()[at], "piece": piece, "token_start": piece * cap, "n_tokens": np.where(last, rest[at], cap)}
        )

    id_type = items.schema["item_id"].dataType.simpleString()
    return each.groupBy("kind_id", "share").applyInPandas(run, f"kind_id bigint, bin bigint, item_id {id_type}, piece bigint, token_start bigint, n_tokens bigint")


def fill_report(packed: DataFrame, kinds: DataFrame, kind: str, capacity: str) -> DataFrame:
    """(kind_id, n_bins, n_tokens, least_bins, fill): containers used, the least that could hold the total, and the share of room used."""
    bins = packed.groupBy("kind_id").agg(F.count_distinct("bin").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    j = bins.join(kinds.select(F.col(kind).cast("bigint").alias("kind_id"), F.col(capacity).cast("bigint").alias("capacity")), "kind_id")
    return j.select("kind_id", "n_bins", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity")).cast("bigint").alias("least_bins"), F.try_divide(F.col("n_tokens"), F.col("n_bins") * F.col("capacity")).alias("fill"))
