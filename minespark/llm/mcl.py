"""Similarity clusters by Markov clustering (MCL) of a sparse graph.

Flow matrices are tables (i, j, w): the share of column j's flow that goes to
row i.  A round squares the matrix (a join on the middle index and a sum),
raises the entries to the inflation power, prunes small ones and scales the
columns again, in one job.  Rows that keep flow are attractors; a column
belongs to the attractor of its strongest flow.  Pruning keeps at most ``keep``
entries a column, so squaring makes at most keep^2 products a column and the
join stays linear in the number of nodes; a row with very many entries (a hub)
is joined without moving its entries to one task.

``nested_clusters`` goes on where links are left between clusters: each cluster
becomes one node, the links between two clusters add up to one edge, and that
graph is clustered again, until no link is left between clusters.

``link_clusters`` clusters points by distance: points are folded into grid
cells in which all are mutually near, so a dense spot is one node however many
points it has; cells are linked where two of their points are near, and the
graph of cells, weighed by their points, is clustered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from minespark.operators.rows import HEAVY_ROWS, skew_join
from minespark.scratch import materialize, release


def _scaled(entries: DataFrame, keep: int, prune: float) -> DataFrame:
    """Entries (i, j, w) cut to the ``keep`` largest of at least ``prune`` times the largest of each column and scaled to sum 1; ``share`` is the column's largest, ``chaos`` what it lacks to be one value or equal ones."""
    top = Window.partitionBy("j").orderBy(F.desc("w"), "i")
    col = Window.partitionBy("j")
    cut = entries.withColumn("_r", F.row_number().over(top)).withColumn("_m", F.max("w").over(col))
    cut = cut.filter((F.col("_r") <= keep) & (F.col("w") >= F.col("_m") * prune))
    cut = cut.withColumn("_s", F.sum("w").over(col)).withColumn("_q", F.sum(F.col("w") * F.col("w")).over(col))
    share = F.col("_m") / F.col("_s")
    return cut.select("i", "j", (F.col("w") / F.col("_s")).alias("w"), share.alias("share"), (share - F.col("_q") / (F.col("_s") * F.col("_s"))).alias("chaos"))


def _written(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """The written table, and measures taken while it is written."""
    seen = Observation()
    return materialize(df.observe(seen, *[c.alias(n) for n, c in measures.items()]).drop("share", "chaos")), seen.get


def markov_clusters(
    edges: DataFrame, a: str = "a", b: str = "b", weight: str = "w", back: str | None = None, inflation: float = 1.3, step: float = 0.2, keep: int = 25, prune: float = 0.01, max_rounds: int = 60, settled: float = 0.6, jitter: float = 0.25, salt: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(node, attractor) of every node, and the final flow (i, j, w).

    ``edges``: BIGINT ends, positive weights; repeated edges add up, NULLs are
    left out, loops are ignored.  ``weight`` draws b's flow to a, ``back``
    (default: the same) a's flow to b.  Each node gets a loop of its heaviest
    entry's weight, varied by a hash of the node within ``jitter`` so that even
    graphs have attractors.  The inflation power grows by ``step`` a round: flow
    first spreads, then gathers.  Of equally strong flows the smaller row
    holds.  Ends when every column has the share ``settled`` of its flow in one
    row, or consists of equal entries; flow that has not come to that after
    ``max_rounds`` is an error.
    """
    one, two = F.col(weight).cast("double"), F.col(back or weight).cast("double")
    e = edges.select(F.col(a).cast("bigint").alias("i"), F.col(b).cast("bigint").alias("j"), one.alias("w"), two.alias("v")).dropna().filter((F.col("i") != F.col("j")) & (F.col("w") > 0) & (F.col("v") > 0))
    both = e.select("i", "j", "w").unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))).repartition("j").groupBy("j", "i").agg(F.sum("w").alias("w"))
    spread = 1 - jitter + 2 * jitter * F.pmod(F.xxhash64("j", F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    heavy = both.withColumn("_m", F.max("w").over(Window.partitionBy("j"))).withColumn("_first", F.row_number().over(Window.partitionBy("j").orderBy("i")) == 1)
    loop = F.array(F.struct("i", "w"), F.struct(F.col("j").alias("i"), (F.col("_m") * spread).alias("w")))
    entries = heavy.select("j", F.explode(F.when(F.col("_first"), loop).otherwise(F.array(F.struct("i", "w")))).alias("x")).select("x.i", "j", "x.w")
    open_columns = F.count_if((F.col("share") < settled) & (F.col("chaos") > 1e-3))
    flow, seen = _written(_scaled(entries, keep, prune), open=open_columns, columns=F.count_if(F.col("i") == F.col("j")))
    left_open = seen["open"]
    for r in range(max_rounds):
        if not left_open:
            break
        left = flow.select("i", F.col("j").alias("k"), "w")
        right = flow.select(F.col("i").alias("k"), "j", F.col("w").alias("x"))
        products = skew_join(right, left, "k", hot=None if seen["columns"] > HEAVY_ROWS else []).select("i", "j", (F.col("w") * F.col("x")).alias("w"))  # a row has no more entries than there are columns
        squared = products.repartition("j").groupBy("j", "i").agg(F.sum("w").alias("w"))  # partitioned by column once, for the sum and the scaling
        new, now = _written(_scaled(squared.select("i", "j", F.pow("w", F.lit(inflation + step * r)).alias("w")), keep, prune), open=open_columns)
        release(flow)
        flow, left_open = new, now["open"]
    if left_open:
        raise RuntimeError(f"flow not settled after {max_rounds} rounds")
    best = flow.groupBy("j").agg(F.min(F.struct((-F.round("w", 9)).alias("w"), "i")).alias("x"))
    return best.select(F.col("j").alias("node"), F.col("x.i").alias("attractor")), flow


def nested_clusters(edges: DataFrame, max_levels: int = 40) -> tuple[DataFrame, DataFrame]:
    """(node, cluster) of every node of the edges (a, b, w, v), no link being left between clusters, and the flow of the first level.

    A cluster is named by the attractor its last level's flow gathers in.  A
    level that merges nothing is tried again with other loops; five in a row
    are an error.
    """
    cur, first, names = edges, None, None
    still = 0
    for level in range(max_levels):
        parts, flow = markov_clusters(cur, back="v", salt=level)
        parts = materialize(parts)
        if first is None:
            first = flow
        else:
            release(flow)
        up = parts.withColumnRenamed("attractor", "_up")
        if names is None:
            names = parts.withColumnRenamed("attractor", "cluster")
        else:
            new = materialize(names.join(up.withColumnRenamed("node", "cluster"), "cluster", "left").select("node", F.coalesce("_up", "cluster").alias("cluster")))
            release(names)
            names = new
        ends = cur.join(up.select(F.col("node").alias("a"), F.col("_up").alias("ca")), "a").join(up.select(F.col("node").alias("b"), F.col("_up").alias("cb")), "b").filter("ca <> cb")
        turned = F.col("ca") > F.col("cb")
        ends = ends.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), F.when(turned, F.col("v")).otherwise(F.col("w")).alias("w"), F.when(turned, F.col("w")).otherwise(F.col("v")).alias("v"))
        new, seen = _written(ends.groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum("v").alias("v")), n=F.count(F.lit(1)), merged=F.lit(0))
        if seen["n"] == 0:
            return names, first
        moved = parts.filter("node <> attractor").limit(1).count()
        still = 0 if moved else still + 1
        if still == 5:
            raise RuntimeError("five levels of Markov clustering without a merger")
        cur = new
    raise RuntimeError(f"links between clusters are left after {max_levels} levels")


# -- points in the plane ----------------------------------------------------

def _grid(c: Column, side: float) -> Column:
    """The number of a coordinate's grid line; there are no more than BIGINT can tell."""
    n = c / side
    return F.when(F.abs(n) < 9e18, F.floor(n).cast("bigint")).otherwise(F.raise_error(F.lit("coordinate too large for this distance")).cast("bigint"))


def _cell(gx: Column, gy: Column, seed: int) -> Column:
    """The name of a grid cell; ``cell_links`` picks a seed under which no two cells share one."""
    return F.xxhash64(gx, gy, F.lit(seed))


def _sub(x: Column, y: Column, side: float, bits: int) -> Column:
    """The sub-cell of a point among the 4^bits of its cell."""
    n = F.lit(1 << bits)
    return F.pmod(F.floor(x / (side / (1 << bits))), n) * n + F.pmod(F.floor(y / (side / (1 << bits))), n)


def _box() -> list[Column]:
    return [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]


def _gaps(p: str, q: str) -> tuple[Column, Column]:
    """Squared smallest and greatest distance of two boxes."""
    c = F.col
    low, high = F.lit(0.0), F.lit(0.0)
    for d in "xy":
        gap = F.greatest(c(f"{q}{d}0") - c(f"{p}{d}1"), c(f"{p}{d}0") - c(f"{q}{d}1"), F.lit(0.0))
        far = F.greatest(c(f"{q}{d}1") - c(f"{p}{d}0"), c(f"{p}{d}1") - c(f"{q}{d}0"))
        low, high = low + gap * gap, high + far * far
    return low, high


def _named(df: DataFrame, p: str, keys: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(k).alias(n) for k, n in keys.items()], *[F.col(c).alias(p + c) for c in ("x0", "x1", "y0", "y1")])


def cell_links(points: DataFrame, eps: float, levels: tuple[int, ...] = (3, 6, 9)) -> tuple[DataFrame, DataFrame, float, int]:
    """Cells (cell, gx, gy, n, mx, my and box) of points (x, y), the pairs (a, b) of cells with two points at most ``eps`` apart, the cells' side and the seed of their names.

    A cell's diagonal is ``eps``.  Whether two cells are linked follows from
    the boxes of their points in most cases; undecided pairs are decided on
    ever finer sub-cells, and at last on the points of the few sub-cells left.
    """
    side = eps / math.sqrt(2) * (1 - 1e-12)
    limit = (eps * (1 + 1e-9)) ** 2
    for seed in range(5):
        placed = points.select("x", "y").groupBy("x", "y").agg(F.count("*").alias("n")).withColumn("gx", _grid(F.col("x"), side)).withColumn("gy", _grid(F.col("y"), side))
        spots = materialize(placed.withColumn("cell", _cell(F.col("gx"), F.col("gy"), seed)))
        where = F.struct("gx", "gy")
        folded = spots.groupBy("cell").agg(F.min("gx").alias("gx"), F.min("gy").alias("gy"), (F.min(where) != F.max(where)).alias("two"), F.sum("n").alias("n"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("my"), *_box())
        cells, seen = _written(folded, two=F.max("two"))
        if not seen["two"]:
            break
        release(spots, cells)  # two cells of one name: next seed
    else:
        raise RuntimeError("cells cannot be named apart")
    steps = [(dx, dy) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    left = cells.select("gx", "gy", *[F.col(k).alias(n) for k, n in (("cell", "a"), ("x0", "px0"), ("x1", "px1"), ("y0", "py0"), ("y1", "py1"))])
    near = F.array(*[F.struct((F.col("gx") + dx).alias("hx"), (F.col("gy") + dy).alias("hy")) for dx, dy in steps])
    left = left.withColumn("h", F.explode(near)).withColumn("b", _cell(F.col("h.hx"), F.col("h.hy"), seed)).drop("gx", "gy")
    pairs = left.join(_named(cells, "q", {"cell": "b", "gx": "gx", "gy": "gy"}), "b").filter((F.col("h.hx") == F.col("gx")) & (F.col("h.hy") == F.col("gy")))  # at most 12 neighbours a cell
    low, high = _gaps("p", "q")
    pairs = materialize(pairs.filter(low <= limit).select("a", "b", (high <= limit).alias("sure")))
    linked = [pairs.filter("sure").select("a", "b")]
    open_pairs = pairs.filter("not sure").select("a", "b", F.lit(0).cast("bigint").alias("sa"), F.lit(0).cast("bigint").alias("sb"))
    up = 0
    for bits in levels:
        if not open_pairs.take(1):
            break
        sub = spots.select("cell", "x", "y", _sub(F.col("x"), F.col("y"), side, bits).alias("s"), _sub(F.col("x"), F.col("y"), side, up).alias("up"))
        boxes = sub.groupBy("cell", "up", "s").agg(*_box())
        j = open_pairs.join(_named(boxes, "p", {"cell": "a", "up": "sa", "s": "s1"}), ["a", "sa"]).join(_named(boxes, "q", {"cell": "b", "up": "sb", "s": "s2"}), ["b", "sb"])
        j = materialize(j.filter(low <= limit).select("a", "b", F.col("s1").alias("sa"), F.col("s2").alias("sb"), (high <= limit).alias("sure")))
        sure = j.filter("sure").select("a", "b").distinct()
        linked.append(sure)
        open_pairs = j.filter("not sure").select("a", "b", "sa", "sb").join(sure, ["a", "b"], "left_anti")
        up = bits
    else:
        pts = spots.select("cell", "x", "y", _sub(F.col("x"), F.col("y"), side, up).alias("s"))
        pa = pts.select(F.col("cell").alias("a"), F.col("s").alias("sa"), F.col("x").alias("px"), F.col("y").alias("py"))
        pb = pts.select(F.col("cell").alias("b"), F.col("s").alias("sb"), F.col("x").alias("qx"), F.col("y").alias("qy"))
        near = open_pairs.join(pa, ["a", "sa"]).join(pb, ["b", "sb"]).filter((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2 <= limit)
        linked.append(near.select("a", "b").distinct())
    out = linked[0]
    for x in linked[1:]:
        out = out.unionByName(x)
    return cells, materialize(out.distinct()), side, seed


def link_clusters(df: DataFrame, pid: str, x: str, y: str, eps: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Clusters of points that are linked by steps of at most ``eps``.

    Returns (id, cell, x, y, component) of every point and (cell, component,
    inflow) of every cell.  Rows with a NULL id, or a NULL, NaN or infinite
    coordinate, take no part; of rows of one id the one with the smallest
    coordinates holds.  Distances are compared with a relative tolerance of
    1e-9, so decimal coordinates exactly ``eps`` apart are linked.  A coordinate
    beyond 6e18 times ``eps`` is an error.

    An edge's weight falls with the distance of the cells' means; a cell draws
    flow in proportion to its points, as all of them together would.
    """
    ok = F.col(pid).isNotNull()
    for c in (x, y):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    rows = df.filter(ok).groupBy(F.col(pid).cast("bigint").alias("id")).agg(F.min(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("p"))
    points = rows.select("id", "p.x", "p.y")
    cells, links, side, seed = cell_links(points, eps)
    ends = [cells.select(F.col("cell").alias(e), F.col("mx").alias(f"{e}x"), F.col("my").alias(f"{e}y"), F.col("n").alias(f"{e}n")) for e in "ab"]
    near = F.exp(-((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2) / F.lit(eps * eps))
    w = links.join(ends[0], "a").join(ends[1], "b").select("a", "b", (near * F.col("an")).alias("w"), (near * F.col("bn")).alias("v"))
    names, flow = nested_clusters(materialize(w))
    sent = flow.join(cells.select(F.col("cell").alias("j"), "n"), "j")
    inflow = sent.groupBy("i").agg(F.sum(F.col("w") * F.col("n")).alias("inflow")).withColumnRenamed("i", "cell")
    named = names.select(F.col("node").alias("cell"), F.col("cluster").alias("component"))
    of_cell = materialize(cells.select("cell", "n").join(named, "cell", "left").join(inflow, "cell", "left").select("cell", F.coalesce("component", "cell").alias("component"), F.coalesce("inflow", F.col("n").cast("double")).alias("inflow")))
    located = points.withColumn("cell", _cell(_grid(F.col("x"), side), _grid(F.col("y"), side), seed))
    return skew_join(located, of_cell.select("cell", "component"), "cell"), of_cell


def cluster_members(points: DataFrame, min_size: int = 3) -> DataFrame:
    """(cluster, id, n): every member of the clusters of at least ``min_size`` points; a cluster is named by its smallest id."""
    size = points.groupBy("component").agg(F.min("id").alias("cluster"), F.count("*").alias("n")).filter(F.col("n") >= min_size)
    return skew_join(points, size, "component").select("cluster", "id", "n", "cell", "x", "y")


def typical_members(members: DataFrame, of_cell: DataFrame, top: int = 3) -> DataFrame:
    """(cluster, n, typical): the ids of the ``top`` members in the cells that gather the strongest flow, nearest to the cell's mean first."""
    mean = members.groupBy("cell").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    m = skew_join(members, mean.join(of_cell.select("cell", F.round("inflow", 6).alias("inflow")), "cell"), "cell")
    far = F.round((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2, 9)
    w = Window.partitionBy("cluster").orderBy(F.desc("inflow"), "cell", far, "id")
    best = m.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)  # limited before the shuffle
    return best.groupBy("cluster").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda s: s["id"]).alias("typical"))
