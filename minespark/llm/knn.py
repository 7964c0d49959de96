"""The k most similar vectors of every vector, by a hierarchical k-means tree.

A tree of k-means splits is fitted on a bounded sample, and leaves that turn
out too large are fitted again, all at once and each on a sample of its own.
Every vector is put into one of the leaves, and each leaf gets the bounding box
of all its vectors.  A query is searched in its own bin first.  Then it goes on
best bin first: a priority queue over the boxes of the tree's nodes yields the
bins in the order of their distance, a number of them is visited, the distance
of the k-th neighbour found so far tightens the bound, and the search widens,
twice as many bins each time, until the nearest box left is farther than that
bound, which is exact.  How many bins are visited at first is calibrated
against brute force; for a recall below 1 the search ends with the number that
the calibration found necessary for it.

Leaves that follow each other in the tree are shipped together as bins of some
hundred vectors; a bin too large for one task is cut into blocks, and so are
the queries that visit it.  Exact copies are searched once.  Distances that
agree to twelve decimals are equal; of equally similar vectors the smaller id
comes first.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from minespark.operators.neighbours import nearest
from minespark.operators.rows import skew_join
from minespark.scratch import materialize, release

SAMPLE_ROWS = 20_000  # the tree, and the new tree of a leaf that is too large, are fitted on at most so many vectors
LEAF_ROWS = 24  # wanted vectors in a leaf
MAX_LEAVES = 65_536  # of the whole tree, which is broadcast; beyond so many times LEAF_ROWS vectors leaves grow
BIN_ROWS = 512  # wanted vectors in a bin
BLOCK_ROWS = 4096  # most vectors of a bin, and most queries, in one task's group (in expectation)
EPS = 1e-9


def sq_dists(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """All squared distances by one matrix product (rounding errors about 1e-13)."""
    return np.clip((q**2).sum(1)[:, None] - 2 * q @ p.T + (p**2).sum(1), 0, None)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = sq_dists(x, c).argmin(1)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


@dataclass
class Tree:
    """Nodes in depth-first order: centroid, children (first, number) or leaf number; then leaf boxes, sizes and bins."""

    centers: list
    children: list
    leaf_no: list
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    bins: np.ndarray | None = None
    blocks: np.ndarray | None = None
    flat: tuple | None = None

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf_no)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree, to the nearest child."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if self.leaf_no[node] >= 0:
                out[idx] = self.leaf_no[node]
                continue
            kids = self.children[node]
            a = sq_dists(x[idx], self.centers[node]).argmin(1)
            todo += [(kid, idx[a == i]) for i, kid in enumerate(kids)]
        return out

    def next_bins(self, q: np.ndarray, limit: np.ndarray, visited: list[np.ndarray], width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, bin): the next ``width`` bins of each query besides those ``visited``, nearest box first, none beyond ``limit``.

        Each query has a priority queue of nodes by the distance of their boxes.
        The nearest node is taken out; an inner one is replaced by its children,
        a leaf tells the next bin.  The queues of all queries step together.
        """
        lo, hi, first, count, kids, leaf = self._node_boxes()
        found: list = []
        n_bins = int(self.bins.max()) + 1
        bin_of = np.where(leaf >= 0, self.bins[np.maximum(leaf, 0)], -1)
        step = np.arange(int(count.max(initial=1)))
        rows = max(1, 16_000_000 // n_bins)
        for at in range(0, len(q), rows):
            idx = np.arange(at, min(len(q), at + rows))
            idx = idx[width[idx] > 0]
            x, lim, left = q[idx], limit[idx], width[idx].copy()
            seen = np.zeros((len(idx), n_bins), dtype=bool)
            for i, j in enumerate(idx):
                seen[i, visited[j]] = True
            row = np.arange(len(idx))  # of ``seen``
            queue, dist, size = np.zeros((len(idx), 16), dtype=np.int32), np.full((len(idx), 16), np.inf), np.ones(len(idx), dtype=np.int64)
            dist[:, 0] = 0.0
            while len(idx):
                here, most = np.arange(len(idx)), int(size.max())
                top = dist[:, :most].argmin(1)
                node = queue[here, top].astype(np.int64)
                on = size > 0
                end = np.maximum(size - 1, 0)  # the last one takes the place of the one taken out
                queue[here, top], dist[here, top] = queue[here, end], dist[here, end]
                dist[here, end] = np.inf
                size = end
                b = bin_of[node]
                hit = np.flatnonzero(on & (b >= 0))
                hit = hit[~seen[row[hit], b[hit]]]
                seen[row[hit], b[hit]] = True
                found.append((idx[hit], b[hit]))
                left[hit] -= 1
                inner = np.flatnonzero(on & (b < 0))
                if len(inner):
                    n = node[inner]
                    i, c = np.nonzero(step < count[n][:, None])
                    who, child = inner[i], kids[first[n[i]] + c]
                    new = (bin_of[child] < 0) | ~seen[row[who], bin_of[child]]
                    who, child = who[new], child[new]
                    y = x[who]
                    gap = np.maximum(np.maximum(lo[child] - y, y - hi[child]), 0)
                    d = np.einsum("cd,cd->c", gap, gap)
                    near = d <= lim[who]
                    who, child, d = who[near], child[near], d[near]
                    place = size[who] + np.arange(len(who)) - np.searchsorted(who, who, side="left")
                    if len(place) and place.max() >= dist.shape[1]:
                        more = (len(idx), int(place.max()))
                        queue, dist = np.concatenate([queue, np.zeros(more, dtype=np.int32)], 1), np.concatenate([dist, np.full(more, np.inf)], 1)
                    queue[who, place], dist[who, place] = child, d
                    size = size + np.bincount(who, minlength=len(idx))
                keep = (size > 0) & (left > 0)
                if keep.sum() <= 0.8 * len(idx):
                    idx, row, left, size, x, lim = idx[keep], row[keep], left[keep], size[keep], x[keep], lim[keep]
                    queue, dist = queue[keep], dist[keep]
                elif not keep.all():
                    size[~keep] = 0  # rests until the arrays are cut
                    dist[~keep] = np.inf
        if not found:
            z = np.zeros(0, dtype=np.int64)
            return z, z
        return tuple(np.concatenate(v) for v in zip(*found))

    def box_order(self, q: np.ndarray) -> np.ndarray:
        """For each query all bins, nearest box first: the order in which a queue without a bound yields them."""
        n_bins = int(self.bins.max()) + 1
        out = np.empty((len(q), n_bins), dtype=np.int64)
        for i, x in enumerate(q):
            gap = np.maximum(np.maximum(self.low - x, x - self.high), 0)
            best = np.full(n_bins, np.inf)
            np.minimum.at(best, self.bins, np.einsum("ld,ld->l", gap, gap))
            out[i] = np.argsort(best, kind="stable")
        return out

    def _node_boxes(self):
        """Boxes of all nodes, and their children as (first, count) into one list."""
        if self.flat is None:
            n, dim = len(self.leaf_no), self.low.shape[1]
            lo, hi = np.full((n, dim), np.inf), np.full((n, dim), -np.inf)
            for i in range(n - 1, -1, -1):  # children have greater numbers than their parent
                if self.leaf_no[i] >= 0:
                    lo[i], hi[i] = self.low[self.leaf_no[i]], self.high[self.leaf_no[i]]
                else:
                    k = self.children[i]
                    lo[i], hi[i] = lo[k].min(0), hi[k].max(0)
            count = np.array([len(k) for k in self.children])
            kids = np.array([c for k in self.children for c in k], dtype=np.int64)
            self.flat = lo, hi, np.cumsum(count) - count, count, kids, np.array(self.leaf_no)
        return self.flat


def fit_tree(x: np.ndarray, leaf_rows: int, branch: int = 8, seed: int = 0) -> Tree:
    """A hierarchical k-means tree over sample vectors with about ``leaf_rows`` of them in a leaf."""
    rng = np.random.default_rng(seed)
    t = Tree([], [], [])

    def grow(idx: np.ndarray) -> int:
        node = len(t.leaf_no)
        t.centers.append(None)
        t.children.append([])
        t.leaf_no.append(-1)
        if len(idx) > leaf_rows:
            c = _means(x[idx], min(branch, max(2, -(-len(idx) // leaf_rows))), rng)
            a = sq_dists(x[idx], c).argmin(1)
            used = np.unique(a)
            if len(used) > 1:
                t.centers[node] = c[used]
                t.children[node] = [grow(idx[a == u]) for u in used]
                return node
        t.leaf_no[node] = sum(v >= 0 for v in t.leaf_no)
        return node

    grow(np.arange(len(x)))
    return t


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, 1))


def _top(rows: np.ndarray, cols: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each row's candidates by (distance, id)."""
    order = np.lexsort((ids[cols], d, rows))
    rows, cols, d = rows[order], cols[order], d[order]
    start = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - start < k
    return rows[keep], cols[keep], d[keep]


def nearest_in_block(q: np.ndarray, limit: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance): the k nearest points of each query that are within its limit, in blocks of queries."""
    out = []
    step = max(1, 2_000_000 // max(1, len(p)))
    for i in range(0, len(q), step):
        d = sq_dists(q[i : i + step], p)
        lim = limit[i : i + step].copy()
        if len(p) > k:
            lim = np.minimum(lim, np.partition(d, k - 1, axis=1)[:, k - 1] + EPS)
        r, c = np.nonzero(d <= (lim + EPS)[:, None])
        gap = q[i + r] - p[c]  # exact differences for those that may count
        out.append(_top(i + r, c, np.round(np.einsum("ij,ij->i", gap, gap), 12), ids, k))
    if not out:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def distinct_vectors(vectors: DataFrame, vid: str, vec: str, keep: int) -> DataFrame:
    """(rep, v, ids, n): each distinct vector with its smallest id, its ``keep`` smallest ids and its number of ids."""
    rows = vectors.select(F.col(vid).alias("_id"), F.col(vec), F.xxhash64(vec).alias("_h"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_h", vec).orderBy("_id"))).filter(F.col("_r") <= keep)  # limited before the shuffle
    n = rows.groupBy("_h", vec).agg(F.count("*").alias("n"))
    ids = first.groupBy("_h", vec).agg(F.array_sort(F.collect_list("_id")).alias("ids"))
    return ids.join(n, ["_h", vec]).select("_h", F.element_at("ids", 1).alias("rep"), F.col(vec).alias("v"), "ids", "n")


def build_tree(vecs: DataFrame, n: int) -> tuple[Tree, DataFrame]:
    """The tree, and the vectors with their leaf.

    Fitted on at most SAMPLE_ROWS vectors picked by hash; then every leaf with
    more than four times the wanted vectors is fitted again on at most
    SAMPLE_ROWS of its own, all of them in parallel, until none is left or no
    fit divides any further.
    """
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    pick = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    got = vecs.filter(pick).select("rep", "v").limit(SAMPLE_ROWS).toPandas().sort_values("rep")
    x = _matrix(got["v"])
    wanted = max(LEAF_ROWS, -(-n // MAX_LEAVES))
    tree = fit_tree(x, max(5, int(wanted * len(x) / max(1, n))))
    for _ in range(4):
        placed = put_into_leaves(vecs, tree)
        sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * wanted).collect()  # at most MAX_LEAVES rows
        big = {r["leaf"]: r["n"] for r in sizes}
        grown = _refit(placed, tree, big, wanted) if big else 0
        if not grown:
            return tree, placed
        tree.flat = None
        release(placed)
    return tree, put_into_leaves(vecs, tree)


def _refit(placed: DataFrame, tree: Tree, big: dict[int, int], wanted: int) -> int:
    """Hang new subtrees into the leaves ``big`` (leaf and size); returns how many leaves were divided."""
    spark = placed.sparkSession
    rates = spark.createDataFrame([(int(k), int(min(1.0, SAMPLE_ROWS / v) * (1 << 30)), float(wanted * min(1.0, SAMPLE_ROWS / v))) for k, v in big.items()], "leaf bigint, most bigint, rows double")
    own = placed.join(F.broadcast(rates), "leaf").filter(F.pmod(F.xxhash64("rep", F.lit(9)), F.lit(1 << 30)) < F.col("most")).select("leaf", "rows", "rep", "v")  # at most MAX_LEAVES rows

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rep")
        t = fit_tree(_matrix(b["v"]), max(5, int(b["rows"].iloc[0])))
        return pd.DataFrame({"leaf": [b["leaf"].iloc[0]], "fit": [pickle.dumps((t.centers, t.children, t.leaf_no))]})

    divided = 0
    node_of = {v: i for i, v in enumerate(tree.leaf_no) if v >= 0}
    for r in sorted(own.groupBy("leaf").applyInPandas(fit, "leaf bigint, fit binary").collect(), key=lambda r: r["leaf"]):  # the tree itself, at most MAX_LEAVES leaves or so
        centers, children, leaf_no = pickle.loads(r["fit"])
        if len(leaf_no) == 1:
            continue
        divided += 1
        at, base = node_of[r["leaf"]], len(tree.leaf_no) - 1
        tree.centers[at], tree.children[at], tree.leaf_no[at] = centers[0], [base + c for c in children[0]], -1
        tree.centers += centers[1:]
        tree.children += [[base + c for c in k] for k in children[1:]]
        tree.leaf_no += leaf_no[1:]
    todo, no = [0], 0
    while todo:  # leaves numbered depth first, so those that follow each other are near
        i = todo.pop()
        if tree.children[i]:
            todo += reversed(tree.children[i])
        else:
            tree.leaf_no[i], no = no, no + 1
    return divided


def put_into_leaves(vecs: DataFrame, tree: Tree) -> DataFrame:
    shared = vecs.sparkSession.sparkContext.broadcast(tree)  # at most MAX_LEAVES leaves or so

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=shared.value.assign(_matrix(b["v"])))

    return materialize(vecs.select("rep", "v", "ids").mapInPandas(run, "rep bigint, v array<double>, ids array<bigint>, leaf bigint"))


def measure_leaves(placed: DataFrame, tree: Tree, bin_rows: int = BIN_ROWS, block_rows: int = BLOCK_ROWS) -> Tree:
    """Boxes of all leaves over all vectors, and their bins and blocks."""

    def part(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for b in batches:
            x, leaf = _matrix(b["v"]), b["leaf"].to_numpy()
            for j in np.unique(leaf):
                y = x[leaf == j]
                lo, hi, n = acc.get(j, (np.inf, -np.inf, 0))
                acc[j] = (np.minimum(lo, y.min(0)), np.maximum(hi, y.max(0)), n + len(y))
        yield pd.DataFrame([(j, n, lo, hi) for j, (lo, hi, n) in acc.items()], columns=["leaf", "n", "lo", "hi"])

    schema = "leaf bigint, n bigint, lo array<double>, hi array<double>"
    parts = placed.select("leaf", "v").mapInPandas(part, schema).select("leaf", "n", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "x"))
    got = parts.groupBy("leaf", "i").agg(F.sum("n").alias("n"), F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi")).toPandas()  # one row a leaf and dimension
    dim = int(got["i"].max()) + 1
    tree.low, tree.high = np.full((tree.leaves, dim), np.inf), np.full((tree.leaves, dim), -np.inf)
    size = np.zeros(tree.leaves, dtype=np.int64)
    leaf, i = got["leaf"].to_numpy(), got["i"].to_numpy()
    tree.low[leaf, i], tree.high[leaf, i], size[leaf] = got["lo"].to_numpy(), got["hi"].to_numpy(), got["n"].to_numpy()
    bins, rows, no = np.zeros(tree.leaves, dtype=np.int64), 0, 0
    totals: list[int] = []
    for leaf in range(tree.leaves):  # leaves are numbered in depth-first order
        if rows >= bin_rows:
            totals.append(rows)
            no, rows = no + 1, 0
        bins[leaf] = no
        rows += int(size[leaf])
    totals.append(rows)
    if len(totals) > 1 and totals[-1] < bin_rows:  # no small last bin
        bins[bins == no] = no - 1
        last = totals.pop()
        totals[-1] += last
    tree.bins, tree.blocks = bins, np.maximum(1, -(-np.array(totals) // block_rows))
    return tree


def knn(vectors: DataFrame, vid: str, vec: str, k: int = 5, recall: float = 1.0, calibration_rows: int = 200) -> DataFrame:
    """(id, neighbours): each id's k nearest other ids as array<struct<d2 double, id bigint>>, nearest first.

    ``vectors``: unique BIGINT ids and ARRAY<DOUBLE> vectors of one length;
    rows with a NULL id, a NULL vector, or a NULL or NaN in it take no part.
    Fewer than k others give shorter lists; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ok = F.col(vid).isNotNull() & F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))
    vectors = vectors.filter(ok).select(F.col(vid).cast("bigint").alias(vid), F.col(vec).cast("array<double>").alias(vec))
    vecs = materialize(distinct_vectors(vectors, vid, vec, k + 1))
    n = vecs.count()
    if n == 0:
        return spark.createDataFrame([], "id bigint, neighbours array<struct<d2:double,id:bigint>>")
    tree, placed = build_tree(vecs, n)
    tree = measure_leaves(placed, tree, BIN_ROWS, BLOCK_ROWS)
    shared = spark.sparkContext.broadcast(tree)

    def add_bin(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            if len(b):
                g = t.bins[b["leaf"].to_numpy()]
                yield pd.DataFrame({"bin": g, "block": (b["rep"].to_numpy() * 0x9E3779B1 >> 7) % t.blocks[g], "rep": b["rep"], "v": b["v"], "ids": b["ids"]})

    data = placed.mapInPandas(add_bin, "bin bigint, block bigint, rep bigint, v array<double>, ids array<bigint>")

    def own_bin(b: pd.DataFrame) -> pd.DataFrame:
        x, reps = _matrix(b["v"]), b["rep"].to_numpy()
        r, c, d = nearest_in_block(x, np.full(len(x), np.inf), x, reps, k + 1)
        tau = np.full(len(x), np.inf)
        last = np.flatnonzero(np.append(r[1:] != r[:-1], True))
        full = np.bincount(r, minlength=len(x)) == k + 1
        tau[r[last]] = d[last]
        tau[~full] = np.inf
        near = _lists(r, c, d, b["ids"].to_numpy(), len(x))
        return pd.DataFrame({"bin": b["bin"], "block": b["block"], "rep": reps, "v": b["v"], "tau": tau, "near": near, "seen": [[]] * len(x)})

    near_type = "array<struct<d2:double,ids:array<bigint>>>"
    state_type = f"bin bigint, block bigint, rep bigint, v array<double>, tau double, near {near_type}, seen array<bigint>"
    state = materialize(data.groupBy("bin", "block").applyInPandas(own_bin, state_type))
    first = calibrate(state, data, tree, k, min(recall, 0.9) if recall >= 1 else recall, calibration_rows)
    most = int(tree.bins.max()) + 1 if recall >= 1 else first

    def route(batches: Iterable[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            for i in range(0, len(b), 10_000):
                s = b.iloc[i : i + 10_000].reset_index(drop=True)
                own, new = s["bin"].to_numpy(), s["seen"].map(len).to_numpy() == 0
                seen = [[o] if n else v for o, n, v in zip(own, new, s["seen"])]
                q, g = t.next_bins(_matrix(s["v"]), s["tau"].to_numpy() + EPS, seen, np.minimum(width, most + 1 - np.array([len(v) for v in seen], dtype=np.int64)))
                order = np.argsort(q, kind="stable")
                q, g = q[order], g[order]
                seen = [np.append(v, x) for v, x in zip(seen, np.split(g, np.searchsorted(q, np.arange(1, len(s)))))]
                again = np.flatnonzero(new & (t.blocks[own] > 1))  # at first also the other blocks of the own bin
                q, g = np.append(q, again), np.append(g, own[again])
                order = np.argsort(q, kind="stable")
                q, g = q[order], g[order]
                rep = t.blocks[g]
                q, g = np.repeat(q, rep), np.repeat(g, rep)
                blk = np.arange(len(g)) - np.repeat(np.cumsum(rep) - rep, rep)
                other = (g != s["bin"].to_numpy()[q]) | (blk != s["block"].to_numpy()[q])
                q, g, blk = q[other], g[other], blk[other]
                cut = np.searchsorted(q, np.arange(1, len(s)))
                yield s.assign(seen=pd.Series(seen, dtype=object), bins=pd.Series(np.split(g, cut), dtype=object), blocks=pd.Series(np.split(blk, cut), dtype=object))

    def visit(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"rep": pd.Series([], dtype="int64"), "near": pd.Series([], dtype=object)})
        r, c, d = nearest_in_block(_matrix(q["v"]), q["tau"].to_numpy(), _matrix(p["v"]), p["rep"].to_numpy(), k + 1)
        near = _lists(r, c, d, p["ids"].to_numpy(), len(q))
        on = [i for i, x in enumerate(near) if x]
        return pd.DataFrame({"rep": q["rep"].to_numpy()[on], "near": pd.Series([near[i] for i in on], dtype=object)})

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # routing is much work on few bytes; neighbouring queries stay together
    found = []
    width, moving = first, state.repartitionByRange(spread, "bin", "rep").sortWithinPartitions("bin")
    while True:
        seen = Observation()
        routed = moving.mapInPandas(lambda batches, w=width: route(batches, w), f"{state_type}, bins array<bigint>, blocks array<bigint>")
        routed = materialize(routed.observe(seen, F.count_if(F.size("bins") > 0).alias("open")))
        found.append(routed.filter(F.size("bins") == 0).select("rep", "near"))
        if not seen.get.get("open"):
            break
        going = routed.filter(F.size("bins") > 0)
        visits = going.select("rep", "tau", "v", F.explode(F.arrays_zip("bins", "blocks")).alias("x")).select(F.col("x.bins").alias("bin"), F.col("x.blocks").alias("block"), "rep", "tau", "v")
        per = visits.groupBy("bin", "block").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("bigint").alias("parts"))  # one row a bin and block
        queries = visits.join(per, ["bin", "block"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).drop("parts")
        points = data.join(per, ["bin", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
        keys = ["bin", "block", "part"]
        hits = queries.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInPandas(visit, f"rep bigint, near {near_type}")
        hits = hits.groupBy("rep").agg(F.flatten(F.collect_list("near")).alias("more"))  # at most k + 1 a visited block
        merged = going.drop("bins", "blocks").join(hits, "rep", "left").withColumn("near", F.slice(F.array_sort(F.concat("near", F.coalesce("more", F.array().cast(near_type)))), 1, k + 1)).drop("more")
        tau = F.when(F.size("near") == k + 1, F.least("tau", F.element_at("near", -1)["d2"])).otherwise(F.col("tau"))
        moving = merged.withColumn("tau", tau).select("bin", "block", "rep", "v", "tau", "near", "seen")
        width *= 2
    each = F.expr("flatten(transform(near, x -> transform(x.ids, i -> named_struct('d2', x.d2, 'id', i))))")
    merged = found[0]
    for x in found[1:]:
        merged = merged.unionByName(x)
    merged = merged.select("rep", F.slice(F.array_sort(each), 1, k + 1).alias("near"))
    small = vecs.filter(F.col("n") <= k + 1).select("rep", F.explode("ids").alias("id"))
    big = vecs.filter(F.col("n") > k + 1).select("_h", "v", "rep")
    members = skew_join(vectors.select(F.col(vid).alias("id"), F.col(vec).alias("_v"), F.xxhash64(vec).alias("_h")), big, "_h").filter(F.col("_v") == F.col("v")).select("rep", "id")
    ids = small.unionByName(members)
    out = skew_join(ids, merged, "rep")
    return out.select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("neighbours"))


def measured_recall(near: DataFrame, vectors: DataFrame, vid: str, vec: str, queries, k: int = 5) -> DataFrame:
    """One row: n_queries, n_true and n_found, the true neighbours of the ``queries`` (a condition on the ids), set against all vectors, and those among ``near``."""
    asked = vectors.filter(queries)
    true = nearest(asked, vectors, vid, vec, k).select("query", "neighbour")
    got = near.select(F.col("id").alias("query"), F.explode("neighbours.id").alias("neighbour"), F.lit(1).alias("_hit"))
    both = true.join(got, ["query", "neighbour"], "left")
    n = asked.agg(F.count("*").alias("n_queries"))
    return both.agg(F.count("*").alias("n_true"), F.count("_hit").alias("n_found")).join(n, how="inner")  # one row each


def _lists(r: np.ndarray, c: np.ndarray, d: np.ndarray, ids: np.ndarray, n: int) -> list:
    out: list = [[] for _ in range(n)]
    for i, j, x in zip(r.tolist(), c.tolist(), d.tolist()):
        out[i].append({"d2": x, "ids": ids[j]})
    return out


def calibrate(state: DataFrame, data: DataFrame, tree: Tree, k: int, recall: float, rows: int) -> int:
    """How many bins, nearest first, the queries of a sample must visit to find ``recall`` of their true neighbours.

    The sample of at most ``rows`` queries is set against all vectors by brute force.
    """
    n = max(1, state.count())
    got = state.filter(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 30)) < F.lit(int(min(1.0, rows / n) * (1 << 30)))).select("rep", "v").limit(rows).toPandas()
    if not len(got):
        return 1
    q = _matrix(got["v"])
    shared = data.sparkSession.sparkContext.broadcast(q)

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                r, c, d = nearest_in_block(shared.value, np.full(len(shared.value), np.inf), _matrix(b["v"]), b["rep"].to_numpy(), k + 1)
                yield pd.DataFrame({"q": r, "d2": d, "rep": b["rep"].to_numpy()[c], "bin": b["bin"].to_numpy()[c]})

    w = Window.partitionBy("q").orderBy("d2", "rep")
    true = data.select("bin", "rep", "v").mapInPandas(scan, "q bigint, d2 double, rep bigint, bin bigint").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).toPandas()
    rank = np.argsort(tree.box_order(q), axis=1)
    home = tree.bins[tree.assign(q)]
    i, b = true["q"].to_numpy(), true["bin"].to_numpy()
    need = np.sort(np.where(b == home[i], 0, rank[i, b] + 1))  # bins besides the own one
    return max(1, int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]))
