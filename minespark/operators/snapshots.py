"""What changed between consecutive full snapshots, by Merkle-tree digests.

Keys are hashed into ranges (the leaves of a tree with fixed fan-out).  A
leaf's digest is the row count, an xor of each of two independent 64-bit row
hashes; an inner node's digest is that of its children.  Digests are compared
from the root down, below differing nodes only, and rows are joined only within
differing leaves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minespark.scratch import materialize


def leaf_digests(rows: DataFrame, period: str) -> DataFrame:
    """(period, leaf, n, x, s) from rows with _leaf, _h1, _h2."""
    return rows.groupBy(period, F.col("_leaf").alias("leaf")).agg(F.count("*").alias("n"), F.bit_xor("_h1").alias("x"), F.bit_xor("_h2").alias("s"))


def roll_up(digests: DataFrame, period: str, fan_bits: int) -> DataFrame:
    """Digests of the nodes one level up."""
    return digests.groupBy(period, F.shiftright("leaf", fan_bits).alias("leaf")).agg(
        F.sum("n").alias("n"), F.bit_xor(F.xxhash64("leaf", "n", "x")).alias("x"), F.bit_xor(F.xxhash64("s", "n", "leaf")).alias("s")
    )


def changed_nodes(level: DataFrame, period: str) -> DataFrame:
    """(period, leaf) of one level whose digest differs from that of the period before: each digest is set against its own and the next period."""
    both = level.unionByName(level.withColumn(period, F.col(period) + 1))
    same = (F.count("*") == 2) & (F.min("n") == F.max("n")) & (F.min("x") == F.max("x")) & (F.min("s") == F.max("s"))
    return both.groupBy(period, "leaf").agg(same.alias("_same")).filter(~F.col("_same")).drop("_same")


def differing_leaves(leaves: DataFrame, period: str, leaf_bits: int, fan_bits: int) -> DataFrame:
    """(period, leaf) whose digest differs from that of the period before, found from the root down, below differing nodes only."""
    levels, steps, bits = [leaves], [], leaf_bits
    while bits > 0:  # the top level may have fewer than 2^fan_bits nodes
        steps.append(min(fan_bits, bits))
        levels.append(roll_up(levels[-1], period, steps[-1]))
        bits -= steps[-1]
    open_nodes = changed_nodes(levels.pop(), period)
    while levels:
        up = open_nodes.withColumnRenamed("leaf", "_up")
        children = changed_nodes(levels.pop(), period).withColumn("_up", F.shiftright("leaf", steps.pop()))
        open_nodes = children.join(up, [period, "_up"], "left_semi").drop("_up")
    return open_nodes


def snapshot_diff(snap: DataFrame, key: str, period: str, values: Sequence[str], leaf_bits: int | None = None, fan_bits: int = 4, leaf_keys: float = 4.0) -> DataFrame:
    """(key, period, change_kind): added, removed or changed against the period before.

    ``snap``: at most one row per key and period, integer periods; rows with a
    NULL key or period are left out.  NULL is a value of its own.  ``removed``
    has the period from which the key is absent.  The first period has nothing
    to be compared with, nothing is reported after the last one.  A period
    without any row removes and later adds all keys.  There are 2^``leaf_bits``
    leaves; by default so many that about ``leaf_keys`` keys of a period share
    one, whatever the number of keys, so that leaves without a change exist: of
    a period in which the share c of all records changes, (1 - c)^leaf_keys of
    the leaves are passed over.
    An empty snapshot table gives no rows.
    """
    rows = snap.filter(F.col(key).isNotNull() & F.col(period).isNotNull())
    # each value is hashed with its NULL flag, as xxhash64 passes over NULLs
    parts = [x for v in values for x in (F.col(v).isNull(), F.col(v))]
    rows = rows.select(
        F.col(key).alias("_k"),
        F.col(period).cast("bigint").alias("_p"),
        F.xxhash64(F.col(key), *parts).alias("_h1"),
        F.xxhash64(F.lit(11), *parts, F.col(key)).alias("_h2"),
    )
    rows = materialize(rows)
    ends = rows.groupBy("_p").agg(F.count("*").alias("n")).agg(F.min("_p"), F.max("_p"), F.max("n")).first()
    if ends[0] is None:
        return rows.select(F.col("_k").alias(key), F.col("_p").alias(period), F.lit("").alias("change_kind")).limit(0)
    if leaf_bits is None:
        leaf_bits = min(40, max(fan_bits, math.ceil(math.log2(ends[2] / leaf_keys))))
    rows = rows.withColumn("_leaf", F.shiftrightunsigned(F.xxhash64("_k", F.lit(7)), 64 - leaf_bits))
    leaves = materialize(leaf_digests(rows, "_p"))
    diff = differing_leaves(leaves, "_p", leaf_bits, fan_bits)
    diff = materialize(diff.filter((F.col("_p") > ends[0]) & (F.col("_p") <= ends[1])).select("_p", F.col("leaf").alias("_leaf")))
    cur = rows.join(diff, ["_p", "_leaf"], "left_semi").select("_k", "_p", "_h1", "_h2")
    prev = (
        rows.withColumn("_p", F.col("_p") + 1)
        .join(diff, ["_p", "_leaf"], "left_semi")
        .select("_k", "_p", F.col("_h1").alias("_p1"), F.col("_h2").alias("_p2"))
    )
    kind = (
        F.when(F.col("_p1").isNull(), "added")
        .when(F.col("_h1").isNull(), "removed")
        .when((F.col("_h1") != F.col("_p1")) | (F.col("_h2") != F.col("_p2")), "changed")
    )
    out = cur.join(prev, ["_k", "_p"], "full_outer").select("_k", "_p", kind.alias("change_kind")).filter(F.col("change_kind").isNotNull())
    return out.select(F.col("_k").alias(key), F.col("_p").alias(period), "change_kind")
