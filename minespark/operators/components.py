"""Connected components by alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest neighbour, so hubs and chains
alike shrink to stars in a number of rounds logarithmic in the graph's size.
Smallest neighbours are aggregates, never collected groups; a hub's edges are
joined to its one-row minimum without moving them to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from minespark.operators.rows import HEAVY_ROWS, skew_join
from minespark.scratch import materialize, release


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One step over at most ``n`` edges (u, v), u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = skew_join(both, least, "u", hot=None if n > HEAVY_ROWS else [])  # no node has more edges than there are
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges; their number and two sums of their hashes, taken while they are written."""
    seen = Observation()
    h = F.xxhash64("u", "v")
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")))
    return out, (seen.get["n"], seen.get["x"], seen.get["s"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of the undirected edges (BIGINT ends) with its component's smallest node.

    Loops and repeated edges do not matter, edges with a NULL end are left out;
    a node that has only loops is a component of its own.  No edges, no rows.
    """
    raw = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).dropna()
    loops = raw.filter("u = v").select(F.col("u").alias("node")).distinct()
    cur, seen = _written(raw.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state, n = None, seen[0]
    for _ in range(max_rounds):
        big = materialize(_star(cur, True, n))
        new, row = _written(_star(big, False, n))
        release(cur, big)
        cur = new
        if row == state:
            break
        state, n = row, row[0]
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    tips = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = tips.unionByName(roots)
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
