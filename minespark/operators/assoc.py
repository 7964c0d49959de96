"""Association rules: frequent and maximal itemsets, single-consequent rules.

Itemsets are found by parallel FP-growth, which counts conditional trees and
never emits a basket's combinations, so long baskets are no burden.  A
level-wise engine in plain DataFrame operations is kept as a cross-check.

Rules of the thresholds: a single item must be in more than ``min_support`` of
all baskets, a larger set in at least ``min_support`` of them; empty baskets
count in the total.  Supports are compared as exact integers.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minespark.scratch import materialize


def baskets_from_pairs(pairs: DataFrame, tid: str, item: str) -> DataFrame:
    """(tid, items): the distinct items of each basket, sorted; NULL items are dropped."""
    return pairs.select(tid, item).distinct().groupBy(F.col(tid).alias("tid")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _bounds(n: int, min_support: float) -> tuple[int, int]:
    """The least counts of single items (strictly more) and of larger sets."""
    s = Fraction(str(min_support)) * n
    return math.floor(s) + 1, max(1, math.ceil(s))


def support_of(baskets: DataFrame, itemsets: DataFrame) -> DataFrame:
    """``itemsets`` (items) with the number of baskets that contain all their items: joined on items, no nested loop."""
    want = itemsets.select("items", F.size("items").alias("_k"), F.monotonically_increasing_id().alias("_set"))
    want = materialize(want)
    rows = baskets.select("tid", F.explode(F.array_distinct("items")).alias("item"))
    hit = want.select("_set", "_k", F.explode("items").alias("item")).join(rows, "item").groupBy("_set", "tid").agg(F.count("*").alias("c"), F.first("_k").alias("_k"))
    n = hit.filter("c = _k").groupBy("_set").agg(F.count("*").alias("n"))
    return want.join(n, "_set", "left").select("items", F.coalesce("n", F.lit(0)).alias("n"))


def frequent_itemsets(baskets: DataFrame, min_support: float, engine: str = "fpgrowth", max_len: int | None = None) -> tuple[DataFrame, int]:
    """((items, n), number of baskets).  ``baskets``: tid and items, an array; repeated items in a basket count once."""
    b = materialize(baskets.select("tid", F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items")))
    total = b.count()
    if total == 0:
        return b.select("items", F.lit(0).cast("bigint").alias("n")).limit(0), 0
    single, larger = _bounds(total, min_support)
    ones = b.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= single)
    ones = materialize(ones)
    if engine == "fpgrowth":
        from pyspark.ml.fpm import FPGrowth

        model = FPGrowth(itemsCol="items", minSupport=max(0.0, (larger - 0.5) / total)).fit(b)
        sets = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")).filter(F.size("items") > 1)
        if max_len:
            sets = sets.filter(F.size("items") <= max_len)
        # a set with an item that is itself not frequent enough is none
        sets = materialize(sets.withColumn("_s", F.monotonically_increasing_id()))
        bad = sets.select("_s", F.explode("items").alias("item")).join(ones, "item", "left_anti").select("_s").distinct()
        sets = sets.join(bad, "_s", "left_anti").select("items", "n")
    else:
        # occurrences (tid, items) of the frequent sets of a level are extended by a later frequent item of the same basket
        rows = materialize(b.select("tid", F.explode("items").alias("item")).join(ones.select("item"), "item", "left_semi"))
        sets, occ, k = None, rows.select("tid", F.array("item").alias("items")), 1
        level = ones.select(F.array("item").alias("items"))
        while max_len is None or k < max_len:
            a = level.select(F.slice("items", 1, k - 1).alias("head"), F.element_at("items", -1).alias("x"))
            cand = a.join(a.withColumnRenamed("x", "y"), "head").filter("x < y").select(F.concat("head", F.array("x", "y")).alias("items"))
            if k > 1:  # every subset with one item left out must be frequent
                subs = cand.select("items", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k + 1)), lambda i: F.filter("items", lambda x, j: j + 1 != i))).alias("sub"))
                bad = subs.join(level.select(F.col("items").alias("sub")), "sub", "left_anti").select("items").distinct()
                cand = cand.join(bad, "items", "left_anti")
            longer = occ.join(rows, "tid").filter(F.col("item") > F.element_at("items", -1)).select("tid", F.concat("items", F.array("item")).alias("items"))
            longer = materialize(longer.join(cand, "items", "left_semi"))
            found = materialize(longer.groupBy("items").agg(F.count("*").alias("n")).filter(F.col("n") >= larger))
            if not found.take(1):
                break
            sets = found if sets is None else sets.unionByName(found)
            level, k = found.select("items"), k + 1
            occ = longer.join(level, "items", "left_semi")
        sets = ones.select(F.array("item").alias("items"), "n").limit(0) if sets is None else sets
    return ones.select(F.array("item").alias("items"), "n").unionByName(sets), total


def maximal_itemsets(sets: DataFrame) -> DataFrame:
    """The sets that are part of no larger one: each set with one item less than another is removed."""
    subs = sets.filter(F.size("items") > 1).select(F.explode(F.transform("items", lambda x: F.filter("items", lambda y: y != x))).alias("items")).distinct()
    return sets.join(subs, "items", "left_anti")


def rules(sets: DataFrame, total: int, min_confidence: float, of: DataFrame | None = None) -> DataFrame:
    """(antecedent, consequent, support, confidence): one item of each set (of ``of``, default all) follows from the others.

    Confidence is at least ``min_confidence``; the supports come from ``sets``,
    which holds every subset of a frequent set.
    """
    src = (sets if of is None else of).filter(F.size("items") > 1)
    r = src.select("n", F.explode("items").alias("consequent"), "items").select(F.filter("items", lambda x: x != F.col("consequent")).alias("antecedent"), "consequent", "n")
    j = r.join(sets.select(F.col("items").alias("antecedent"), F.col("n").alias("na")), "antecedent")
    conf = F.col("n") / F.col("na")
    return j.filter(conf >= min_confidence).select("antecedent", "consequent", (F.col("n") / F.lit(total)).alias("support"), conf.alias("confidence"))


def rule_text(r: DataFrame, names: DataFrame | None = None, item: str = "id", name: str = "name") -> DataFrame:
    """(text, support, confidence): ``a | b ---> c [sup = ..., conf = ...]``; items get their names by joining on the id."""
    if names is not None:
        r = r.withColumn("_r", F.monotonically_increasing_id())
        n = F.broadcast(names.select(F.col(item).alias("_i"), F.col(name).alias("_n"))) if names.count() <= 100_000 else names.select(F.col(item).alias("_i"), F.col(name).alias("_n"))
        lhs = r.select("_r", F.posexplode("antecedent").alias("_p", "_i")).join(n, "_i", "left").groupBy("_r").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_n", F.col("_i").cast("string")).alias("t")))), lambda x: x["t"]).alias("lhs"))
        r = r.join(lhs, "_r").withColumnRenamed("consequent", "_i").join(n, "_i", "left").withColumn("rhs", F.coalesce("_n", F.col("_i").cast("string")))
    else:
        r = r.select("*", F.transform("antecedent", lambda x: x.cast("string")).alias("lhs"), F.col("consequent").cast("string").alias("rhs"))
    return r.select(F.format_string("%s ---> %s [sup = %.5f, conf = %.5f]", F.array_join("lhs", " | "), F.col("rhs"), F.col("support"), F.col("confidence")).alias("text"), "support", "confidence")


def explore(baskets: DataFrame, min_support: float) -> tuple[DataFrame, DataFrame]:
    """All rules without a confidence bound: distinct supports, and confidences, each in descending order."""
    sets, total = frequent_itemsets(baskets, min_support)
    r = rules(sets, total, 0.0, maximal_itemsets(sets))
    return r.select("support").distinct().orderBy(F.desc("support")), r.select("confidence").orderBy(F.desc("confidence"))


def item_list(c: Column, remove: list[int] | None = None) -> Column:
    """The items of a text line ``tid, i1, i2, ...`` without those of ``remove``."""
    cells = F.split(c, r",\s*")
    items = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), lambda x: F.expr("1") * x.try_cast("int"))
    return F.array_except(items, F.array(*[F.lit(i) for i in remove])) if remove else items
