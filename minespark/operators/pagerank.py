"""PageRank by power iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from minespark.functions.linalg import close
from minespark.operators.rows import HEAVY_ROWS, heavy_keys, skew_join
from minespark.scratch import materialize, release


def graph(rows: DataFrame, n1: str, n2: str, directed: bool = False) -> DataFrame:
    """(src, dst): in a directed list the second node points to the first; undirected edges go both ways."""
    e = rows.select(F.col(n2).alias("src"), F.col(n1).alias("dst")).dropna()
    return e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def pagerank(edges: DataFrame, d: float = 0.5, max_iterations: int | None = None, tolerance: bool = True, multi_edges: str = "once") -> tuple[DataFrame, int]:
    """((id, pr), iterations): p = d * (sum over in-links of p / out-degree) + (1 - d) / n, from 1 / n.

    Repeated edges count in the out-degree but send flow once (``multi_edges=
    "accumulate"``: as often as they occur); nodes without out-links send
    nothing.  Stops when all ranks agree within 1e-8 + 1e-5 of the new rank.
    The edge table is scaled once; each round is one join and one sum, to which
    every node adds a row of its own, and one job: whether the ranks agree is
    told while they are written.  Without a tolerance only every fifth round's
    ranks are written, so lineage stays short all the same.
    """
    n_edges = edges.groupBy("src", "dst").agg(F.count("*").alias("c"))
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    share = F.lit(1.0) if multi_edges == "once" else F.col("c")
    seen = Observation()
    flow = materialize(n_edges.join(out, "src").select("src", "dst", (share / F.col("deg")).alias("w")).observe(seen, F.count(F.lit(1)).alias("n")))
    hot = heavy_keys(flow, "src") if seen.get["n"] > HEAVY_ROWS else []  # the edges stay the same
    seen = Observation()
    ids = flow.select(F.col("src").alias("id")).union(flow.select("dst")).distinct()
    ids = materialize(ids.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    if n == 0:
        return ids.withColumn("pr", F.lit(0.0)), 0
    ranks = ids.withColumn("pr", F.lit(1.0 / n))
    it = 0
    written = ids
    while max_iterations is None or it < max_iterations:
        sent = skew_join(flow, ranks.withColumnRenamed("id", "src"), "src", hot=hot).select(F.col("dst").alias("id"), (F.col("w") * F.col("pr")).alias("s"), F.lit(None).cast("double").alias("old"))
        own = ranks.select("id", F.lit(0.0).alias("s"), F.col("pr").alias("old"))  # nodes without in-links have a row, too
        new = sent.unionByName(own).groupBy("id").agg(F.sum("s").alias("s"), F.max("old").alias("old"))
        new = new.select("id", (F.lit(d) * F.col("s") + (1 - d) / n).alias("pr"), "old")
        it += 1
        if tolerance:
            seen = Observation()
            ranks = materialize(new.observe(seen, F.count_if(~close(F.col("old"), F.col("pr"))).alias("moved")).drop("old"))
            release(written)
            written = ranks
            if not seen.get["moved"]:
                break
        elif it % 5 == 0 or it == max_iterations:
            ranks = materialize(new.drop("old"))
            release(written)
            written = ranks
        else:
            ranks = new.drop("old")
    return ranks, it


def report(ranks: DataFrame) -> DataFrame:
    """(rank, id, pr), greatest first, ties by id; a full sort is what is asked for."""
    return ranks.select(F.row_number().over(Window.orderBy(F.desc("pr"), "id")).alias("rank"), "id", "pr")
