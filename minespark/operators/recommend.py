"""Neighbourhood collaborative filtering over long ratings (user, item, rating).

Similarities are taken by a join on what both rated or, where users (or items)
are many, in blocks: one matrix product per pair of blocks, of which only the
similarities asked for, or the nearest neighbours of each cell, become rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minespark.operators.prep import lot, with_rid
from minespark.scratch import batches, materialize, path_of

BLOCK = 1024  # vectors of a task's block; predictions meet 2 * BLOCK others at a time
CELLS = 1_000_000  # most targets of a task, in expectation, whose neighbours are kept
COLUMNS = 4096  # most columns of a dense block

METHODS = {f"{kind}-{name}": (kind, name) for kind in ("user", "item") for name in ("mean-utility", "weighted-sum", "adjusted-weighted-sum")}


def ratings_of(df: DataFrame, user: str, item: str, rating: str, missing: float | None = 99) -> DataFrame:
    """(user, item, rating): NULLs and the missing mark are left out; of repeated cells the mean."""
    r = df.select(F.col(user).alias("user"), F.col(item).alias("item"), F.col(rating).cast("double").alias("rating")).dropna()
    r = r.filter(F.col("rating") != missing) if missing is not None else r
    return r.groupBy("user", "item").agg(F.avg("rating").alias("rating"))


def similarity(r: DataFrame, kind: str = "user") -> DataFrame:
    """(a, b, sim), a <> b: centred products over what both rated, divided by each vector's own norm over all it rated.

    Vectors of norm 0 have NULL similarities.  Pairs that share nothing have no
    row (their similarity is 0).
    """
    a, other = ("user", "item") if kind == "user" else ("item", "user")
    m = r.groupBy(a).agg(F.avg("rating").alias("_m"), F.sqrt(F.sum(F.col("rating") * F.col("rating")) - F.count("*") * F.avg("rating") * F.avg("rating")).alias("_norm"))
    c = r.join(m, a).select(F.col(a).alias("a"), F.col(other).alias("o"), (F.col("rating") - F.col("_m")).alias("x"))
    norm = c.groupBy("a").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    dots = c.join(c.select(F.col("a").alias("b"), "o", F.col("x").alias("y")), "o").filter("a <> b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    j = dots.join(norm, "a").join(norm.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b")
    prod = F.col("n") * F.col("nb")
    return j.select("a", "b", F.when(F.round(prod, 12) > 0, F.col("d") / prod).alias("sim"))


def _vectors(r: DataFrame, kind: str) -> DataFrame:
    """(id, o, rating, m, norm): each one's ratings in the order of the other ends, their mean, and the norm about it."""
    a, other = ("user", "item") if kind == "user" else ("item", "user")
    v = r.groupBy(F.col(a).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("o"), "rating"))).alias("l"))
    v = v.withColumn("m", F.aggregate("l.rating", F.lit(0.0), lambda s, e: s + e) / F.size("l"))
    return v.select("id", F.col("l.o").alias("o"), F.col("l.rating").alias("rating"), "m", F.sqrt(F.aggregate("l.rating", F.lit(0.0), lambda s, e: s + (e - F.col("m")) * (e - F.col("m")))).alias("norm"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of every value of the lists; a missing list is empty."""
    return np.asarray(pc.list_parent_indices(lists)).astype(np.int64), lists.flatten()


class _Block:
    """Vectors of a task, which meet all others some at a time."""

    def __init__(self, t: pa.Table):
        b = self.rows = t.combine_chunks().to_batches()[0]
        row, o = _flat(b.column("o"))
        o = o.dictionary_encode()
        self.names, self.at, self.row = o.dictionary, np.asarray(o.indices).astype(np.int64), row
        self.norm = np.nan_to_num(np.asarray(b.column("norm").fill_null(0.0)))
        self.x = self._scaled(b, row, self.norm)

    @staticmethod
    def _scaled(b: pa.RecordBatch, row: np.ndarray, norm: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(norm[row] > 0, (np.asarray(b.column("rating").flatten()) - np.asarray(b.column("m").fill_null(0.0))[row]) / norm[row], 0.0)

    def similarities(self, q: pa.RecordBatch, shared: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Of all own rows and all of q, 0 where nothing is shared or a norm is 0; where a norm is 0; whether something is shared."""
        row, o = _flat(q.column("o"))
        norm = np.asarray(q.column("norm"))
        x = self._scaled(q, row, norm)
        o = o if isinstance(o, pa.DictionaryArray) else o.dictionary_encode()
        at = np.asarray(pc.fill_null(pc.index_in(o.dictionary, value_set=self.names), -1)).astype(np.int64)[np.asarray(o.indices)]
        s, common = np.zeros((len(self.rows), len(q))), np.zeros((len(self.rows), len(q)), bool) if shared else None

        def dense(rows, cols, values, lo, n):
            on = (cols >= lo) & (cols < lo + COLUMNS)
            m = np.zeros((n, min(COLUMNS, len(self.names) - lo)))
            m[rows[on], cols[on] - lo] = values[on]
            return m

        for lo in range(0, len(self.names), COLUMNS):
            s += dense(self.row, self.at, self.x, lo, len(s)) @ dense(row, at, x, lo, len(q)).T
            if shared:
                common |= dense(self.row, self.at, np.ones(len(self.row)), lo, len(s)) @ dense(row, at, np.ones(len(row)), lo, len(q)).T > 0
        none = np.zeros(s.shape, bool) if shared else None
        i, j = np.flatnonzero(self.norm < 1e-4), np.flatnonzero(norm < 1e-4)  # only these can make a product of 0
        for cells, prod in ((np.ix_(i, np.arange(len(q))), np.outer(self.norm[i], norm)), (np.ix_(np.arange(len(s)), j), np.outer(self.norm, norm[j]))):
            zero = np.round(prod, 12) <= 0
            s[cells] = np.where(zero, 0.0, s[cells])
            if shared:
                none[cells] |= zero
        return s, none, common


def similarity_in_blocks(r: DataFrame, kind: str = "user") -> DataFrame:
    """As ``similarity``, for many vectors: a row of every pair that shares something, but no row of what they share.

    Each task holds a block of vectors and reads all written ones some at a
    time, so vectors are not copied to the blocks they meet.
    """
    a = r.schema[kind].dataType.simpleString()
    v = materialize(_vectors(r, kind), tidy=True)
    path, n = path_of(v), v.count()

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in rows if len(b)]
        if own:
            p = _Block(pa.Table.from_batches(own))
            x = p.rows.column("id")
            for q in batches(path, ["id", "o", "rating", "m", "norm"], BLOCK):
                s, none, common = p.similarities(q, True)
                y = q.column("id")
                me = np.asarray(pc.fill_null(pc.index_in(y, value_set=x), -1)).astype(np.int64)
                common[me[me >= 0], np.flatnonzero(me >= 0)] = False
                i, j = np.nonzero(common)
                yield pa.RecordBatch.from_arrays([x.take(pa.array(i)), y.take(pa.array(j)), pa.array(s[i, j], mask=none[i, j])], ["a", "b", "sim"])

    parts = max(1, -(-n // BLOCK), min(r.sparkSession.sparkContext.defaultParallelism, n // 64))
    return v.repartition(parts).mapInArrow(run, f"a {a}, b {a}, sim double")


def predict_in_blocks(r: DataFrame, targets: DataFrame, kind: str, how: str, n: int, low: float = -10.0, high: float = 10.0) -> DataFrame:
    """As ``predict``, without rows of neighbours: each task holds targets, reads all vectors some at a time and keeps the n most similar of each target.

    As in ``predict``, NULL similarities count 0 and ties go to the smaller
    one; similarities that agree to twelve decimals are equal.  Those whose
    ratings (and wants) are equal are compared once; n + 1 neighbours are
    found, of which each leaves itself out.
    """
    a, other = ("user", "item") if kind == "user" else ("item", "user")
    ta, to = r.schema[a].dataType.simpleString(), r.schema[other].dataType.simpleString()
    want = targets.groupBy(F.col(a).alias("id")).agg(F.array_sort(F.collect_set(other)).alias("want"))
    v = _vectors(r, kind).join(want, "id", "full").groupBy("o", "rating", "m", "norm", "want").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    v = materialize(v.withColumn("first", F.slice("ids", 1, n + 1)), tidy=True)
    path = path_of(v)
    size = v.agg(F.count_if(F.size("want") > 0).alias("n"), F.max(F.size("want")).alias("w")).first()
    block = max(1, min(BLOCK, CELLS // max(1, size.w or 0)))
    parts = max(1, -(-size.n // block), min(r.sparkSession.sparkContext.defaultParallelism, size.n // 64))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in rows if len(b)]
        if own:
            p = _Targets(pa.Table.from_batches(own), n + 1)
            step = 64  # the first fill the lists
            for b in batches(path, ["o", "rating", "m", "norm", "first"], 2 * BLOCK):
                b = b.filter(pc.is_valid(b.column("o")))
                at = 0
                while at < len(b):
                    p.meet(b.slice(at, step))
                    at, step = at + step, min(4 * step, 2 * BLOCK)
            yield from p.predictions(how, n, low, high, a, other)

    out = v.filter(F.size("want") > 0).drop("first").repartition(parts).mapInArrow(run, f"{a} {ta}, {other} {to}, pred double")
    return out.select("user", "item", "pred")


class _Targets(_Block):
    """Targets of a task and the k nearest of each so far."""

    def __init__(self, t: pa.Table, k: int):
        super().__init__(t)
        row, o = _flat(self.rows.column("want"))
        o = o.dictionary_encode()
        self.k, self.wants = k, o.dictionary
        self.wanted = np.zeros((len(self.rows), len(o.dictionary)), bool)
        self.wanted[row, np.asarray(o.indices)] = True
        self.least = np.where(self.wanted, -np.inf, np.inf)  # the k-th similarity of each target
        ids = self.rows.column("ids").flatten().to_numpy(zero_copy_only=False)
        self.kind = np.str_ if ids.dtype == object else ids.dtype
        # cell (row * wants + want), similarity, neighbour, its rating and mean; in order of cells, k at most of each
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, self.kind), np.zeros(0), np.zeros(0))

    def meet(self, q: pa.RecordBatch) -> None:
        s, _, _ = self.similarities(q)
        row, o = _flat(q.column("o"))
        o = o.dictionary_encode()
        at = np.asarray(pc.fill_null(pc.index_in(o.dictionary, value_set=self.wants), -1)).astype(np.int64)[np.asarray(o.indices)]
        rating = np.full((len(q), len(self.wants)), np.nan)
        rating[row[at >= 0], at[at >= 0]] = np.asarray(q.column("rating").flatten())[at >= 0]
        rated = ~np.isnan(rating)
        often = rated.sum(axis=0) * 8 >= len(q)
        if often.any():  # one comparison for all of these
            i, j = np.nonzero(s >= self.least[:, often].min(axis=1, initial=np.inf)[:, None] - 1e-11)
            cols = np.flatnonzero(often)
            step = max(1, 100_000 // len(cols))
            if len(i) > step:  # the most similar raise the bound for the rest
                order = np.argsort(-s[i, j], kind="stable")
                i, j = i[order], j[order]
            for x in range(0, len(i), step):
                ii, jj = i[x : x + step], j[x : x + step]
                e, c = np.nonzero(rated[np.ix_(jj, cols)] & (s[ii, jj][:, None] >= self.least[np.ix_(ii, cols)] - 1e-11))
                self._keep(q, s, rating, ii[e], jj[e], cols[c])
        some: list = []
        for c in np.flatnonzero(~often & rated.any(axis=0)):
            rows, raters = np.flatnonzero(self.wanted[:, c]), np.flatnonzero(rated[:, c])
            x, y = np.nonzero(s[np.ix_(rows, raters)] >= self.least[rows, c][:, None] - 1e-11)
            some.append((rows[x], raters[y], np.full(len(x), c)))
            if sum(len(x) for x, _, _ in some) > 100_000:
                self._keep(q, s, rating, *(np.concatenate(x) for x in zip(*some)))
                some = []
        if some:
            self._keep(q, s, rating, *(np.concatenate(x) for x in zip(*some)))

    def _keep(self, q: pa.RecordBatch, s: np.ndarray, rating: np.ndarray, i: np.ndarray, j: np.ndarray, c: np.ndarray) -> None:
        if not len(i):
            return
        n = np.asarray(pc.list_value_length(q.column("first"))).astype(np.int64)
        first = np.append(0, np.cumsum(n))
        m = np.repeat(np.arange(len(i)), n[j])  # each of those whose ratings are equal
        ids = q.column("first").flatten().to_numpy(zero_copy_only=False).astype(self.kind)
        of = ids[np.arange(len(m)) - np.repeat(np.cumsum(n[j]) - n[j], n[j]) + np.repeat(first[j], n[j])]
        i, j, c = i[m], j[m], c[m]
        new = (i * len(self.wants) + c, np.round(s[i, j], 12), of, rating[j, c], np.asarray(q.column("m"))[j])
        touched = np.zeros(self.least.size, bool)
        touched[new[0]] = True
        old = touched[self.found[0]]
        both = [np.concatenate((x[old], y)) for x, y in zip(self.found, new)]
        order = np.lexsort((both[2], -both[1], both[0]))
        both = [x[order] for x in both]
        on = np.arange(len(order)) - np.searchsorted(both[0], both[0], side="left") < self.k
        both = [x[on] for x in both]
        cells, at, n = np.unique(both[0], return_index=True, return_counts=True)
        full = n == self.k
        self.least.reshape(-1)[cells[full]] = both[1][at[full] + self.k - 1]
        self.found = tuple(np.concatenate((x[~old], y)) for x, y in zip(self.found, both))

    def predictions(self, how: str, n: int, low: float, high: float, a: str, other: str) -> Iterator[pa.RecordBatch]:
        w, k = len(self.wants), self.k
        order = np.argsort(self.found[0], kind="stable")
        cell, s, of, x, m = (v[order] for v in self.found)
        slot = np.arange(len(cell)) - np.searchsorted(cell, cell, side="left")
        there, sims, ratings, means = (np.zeros((self.least.size, k)) for _ in range(4))
        for to, values in ((there, 1.0), (sims, s), (ratings, x), (means, m)):
            to[cell, slot] = values
        names = np.zeros((self.least.size, k), self.kind if self.kind is not np.str_ else of.dtype)
        names[cell, slot] = of

        def pred(cells: np.ndarray, without: np.ndarray | None) -> np.ndarray:
            """Of cells, by their first n neighbours, or those besides the one at a slot."""
            use = there[cells] > 0
            if without is not None:
                use[np.arange(len(cells)), without] = False
            use &= np.cumsum(use, axis=1) <= n
            with np.errstate(invalid="ignore", divide="ignore"):
                if how == "mean-utility":
                    p = np.where(use, ratings[cells], 0).sum(axis=1) / use.sum(axis=1)
                else:
                    weight = np.where(use, sims[cells], 0)
                    value = ratings[cells] - means[cells] if how == "adjusted-weighted-sum" else ratings[cells]
                    p = np.where(np.abs(weight.sum(axis=1)) > 1e-12, (value * weight).sum(axis=1) / weight.sum(axis=1), np.nan)
                    if how == "adjusted-weighted-sum":
                        p = own[cells // w] + p
            return np.clip(p, low, high)

        own = np.asarray(self.rows.column("m").cast(pa.float64()).fill_null(np.nan))
        base = pred(np.arange(self.least.size), None).reshape(-1, w)
        all_ids = self.rows.column("ids")
        ready, n_ready = [], 0
        for i in range(len(self.rows)):
            cols = np.flatnonzero(self.wanted[i])
            members = all_ids[i].values
            at = members.to_numpy(zero_copy_only=False).astype(self.kind)
            cells = i * w + np.arange(w)
            hit = np.isin(names[cells], at) & (there[cells] > 0)
            c, z = np.nonzero(hit & self.wanted[i][:, None])
            who, value = np.searchsorted(at, names[cells][c, z]), pred(cells[c], z)
            step = max(1, 500_000 // len(cols))
            for lo in range(0, len(at), step):  # those of equal ratings, some at a time
                some = min(step, len(at) - lo)
                p = np.tile(base[i], (some, 1))
                on = (who >= lo) & (who < lo + some)
                p[who[on] - lo, c[on]] = value[on]
                p = p[:, cols].reshape(-1)
                ready.append(pa.RecordBatch.from_arrays([members.take(pa.array(np.repeat(np.arange(lo, lo + some), len(cols)))), self.wants.take(pa.array(np.tile(cols, some))), pa.array(p, from_pandas=True)], [a, other, "pred"]))
                n_ready += len(p)
                if n_ready > 100_000:
                    yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                    ready, n_ready = [], 0
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()


def predict(r: DataFrame, targets: DataFrame, kind: str = "user", how: str = "mean-utility", n: int | None = 5, sim: DataFrame | None = None, low: float = -10.0, high: float = 10.0, blocks: bool = False) -> DataFrame:
    """(user, item, pred) for every target (user, item), from the n most similar neighbours that have the other end's rating.

    The target's own cell is never used, but the means of the adjusted sum are
    taken over all ratings.  Weights are signed and divided by their plain sum;
    without ``n`` that sum runs over all other users (items), also those
    without the rating.  NULL similarities come last.  Predictions are clipped.
    ``blocks`` is the way of ``predict_in_blocks``.
    """
    a, other = ("user", "item") if kind == "user" else ("item", "user")
    if blocks and (n is None or sim is not None):
        raise ValueError("blocks needs n and takes no sim")
    if blocks:
        return predict_in_blocks(r, targets, kind, how, n, low, high)
    t = targets.select("user", "item").distinct()
    sim = similarity(r, kind) if sim is None else sim
    cand = t.join(r.select(F.col(a).alias("_b"), F.col(other), F.col("rating")), other).filter(F.col("_b") != F.col(a))
    cand = cand.join(sim.select(F.col("a").alias(a), F.col("b").alias("_b"), "sim"), [a, "_b"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    if n is not None:
        w = Window.partitionBy("user", "item").orderBy(F.col("sim").desc_nulls_last(), "_b")
        cand = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    means = r.groupBy(F.col(a).alias("_e")).agg(F.avg("rating").alias("_mean"))
    if how == "mean-utility":
        p = cand.groupBy("user", "item").agg(F.avg("rating").alias("pred"))
    else:
        x = F.col("rating")
        if how == "adjusted-weighted-sum":
            cand = cand.join(means.withColumnRenamed("_e", "_b"), "_b")
            x = F.col("rating") - F.col("_mean")
        p = cand.groupBy("user", "item").agg(F.sum(x * F.col("sim")).alias("_s"), F.sum("sim").alias("_w"))
        if n is None:
            all_w = sim.groupBy(F.col("a").alias(a)).agg(F.sum("sim").alias("_aw"))
            p = p.join(all_w, a, "left").withColumn("_w", F.col("_aw")).drop("_aw")
        p = p.withColumn("pred", F.when(F.abs("_w") > 1e-12, F.col("_s") / F.col("_w")))
        if how == "adjusted-weighted-sum":
            p = p.join(means.withColumnRenamed("_e", a), a, "left").withColumn("pred", F.col("_mean") + F.col("pred"))
    p = p.withColumn("pred", F.when(F.col("pred").isNotNull(), F.greatest(F.least("pred", F.lit(high)), F.lit(low))))
    return t.join(p.select("user", "item", "pred"), ["user", "item"], "left")


def recommend(r: DataFrame, targets: DataFrame, method: str, n: int | None = 5, blocks: bool = False) -> DataFrame:
    """One of METHODS, by name."""
    kind, how = METHODS[method]
    return predict(r, targets, kind, how, n, blocks=blocks)


def all_cells(r: DataFrame, most_items: int = 10_000) -> DataFrame:
    """Every user with every item: what the prediction of the whole matrix is asked for.

    Each user is given the list of items; ValueError beyond ``most_items`` of
    them, where the whole matrix is no sensible target.
    """
    items = [x[0] for x in r.select("item").distinct().orderBy("item").limit(most_items + 1).collect()]
    if len(items) > most_items:
        raise ValueError(f"more than {most_items} items")
    kind = r.schema["item"].dataType.simpleString()
    return r.select("user").distinct().withColumn("item", F.explode(F.array(*[F.lit(x) for x in items]).cast(f"array<{kind}>")))


def evaluate_list(r: DataFrame, cells: DataFrame, method: str, n: int | None = 5) -> DataFrame:
    """(user, item, rating, pred) of the listed cells that have a rating; similarities use the listed users and items only."""
    c = cells.select("user", "item").distinct()
    sub = r.join(c.select("user").distinct(), "user", "left_semi").join(c.select("item").distinct(), "item", "left_semi")
    kind, how = METHODS[method]
    known = c.join(r, ["user", "item"])
    return known.join(predict(sub, known.select("user", "item"), kind, how, n), ["user", "item"], "left").select("user", "item", "rating", "pred")


def evaluate_random(r: DataFrame, size: int, repeats: int, method: str, n: int | None = 5, seed: int = 0) -> DataFrame:
    """(repeat, user, item, rating, pred): ``repeats`` independent samples of ``size`` rated cells, each evaluated as a list of its own."""
    out = None
    for i in range(repeats):
        one = evaluate_list(r, sample_cells(r, size, seed + i), method, n).withColumn("repeat", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.select("repeat", "user", "item", "rating", "pred")


def sample_cells(r: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` rated cells, picked by hash."""
    return r.orderBy(lot(seed, "user", "item"), "user", "item").limit(size).select("user", "item")


def sample_any(r: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` cells of independently drawn users and items, with replacement; unrated ones drop out in the evaluation."""
    users = with_rid(r.select("user").distinct(), ["user"], "_u")
    items = with_rid(r.select("item").distinct(), ["item"], "_i")
    n, m = users.count(), items.count()
    picks = r.sparkSession.range(size).select(F.pmod(lot(seed, "id"), F.lit(max(n, 1))).alias("_u"), F.pmod(lot(seed + 1, "id"), F.lit(max(m, 1))).alias("_i"))
    return picks.join(users, "_u").join(items, "_i").select("user", "item")
