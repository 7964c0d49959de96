"""Mixing sources to target shares, by hash-threshold histograms.

Each document has a hash; a source's documents below a threshold are taken.
Token sums by source and hash bucket tell between which two bucket bounds a
source's budget ends; only that boundary bucket is split further, level by
level, until the threshold is exact to one document.  What a long document at
the boundary leaves of the budget is filled by further thresholds over the
documents left out that are short against the rest, until none fits.  Nothing
is sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minespark.scratch import materialize, release

HASH_BITS = 60
LEVEL_BITS = 10  # buckets of a histogram: at most 2^LEVEL_BITS a source
HISTOGRAM_ROWS = 1 << 18  # of all sources together: the more sources, the fewer buckets each, and the more levels


@dataclass
class SourcePlan:
    """What is taken of one source: all documents ``whole`` times, and once more those of at most ``size`` tokens with a hash from ``low`` up to ``high``, for each of the ``cuts`` (low, high, size)."""

    source: str
    share: float
    max_repeat: int
    available: int
    wanted: float
    whole: int
    cuts: list


def histogram(items: DataFrame, level: int, bits: int = LEVEL_BITS) -> DataFrame:
    """(source, bucket, tokens, one: whether all its documents have one hash) by the hash's first ``(level + 1) * bits`` bits."""
    return items.groupBy("source", F.shiftright("h", max(0, HASH_BITS - (level + 1) * bits)).alias("bucket")).agg(F.sum("tokens").alias("tokens"), (F.min("h") == F.max("h")).alias("one"))


def hashed(items: DataFrame, item: str, source: str, size: str) -> DataFrame:
    """(item_id, source, tokens, h) of rows with an id and a source; a NULL size counts as 0."""
    ok = items.filter(F.col(item).isNotNull() & F.col(source).isNotNull())
    return ok.select(F.col(item).alias("item_id"), F.col(source).alias("source"), F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint")).alias("tokens"), F.shiftrightunsigned(F.xxhash64(item, F.lit(17)), 64 - HASH_BITS).alias("h"))


def of_sources(items: DataFrame, sources) -> DataFrame:
    """The items of the given sources, whose names are broadcast."""
    names = items.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    return items.join(F.broadcast(names), "source", "left_semi")


def thresholds(items: DataFrame, budgets: dict[str, float]) -> dict[str, tuple[int, float]]:
    """Per source the greatest hash threshold below which its documents do not exceed the budget, and what is left of it.

    ``items`` is read twice: for the first histogram, and for its boundary
    buckets, which are written, so that deeper levels read only them.  Only
    sources with a budget are aggregated.
    """
    spark = items.sparkSession
    left = dict(budgets)
    out: dict[str, tuple[int, float]] = {}
    bits = max(2, min(LEVEL_BITS, int(math.log2(HISTOGRAM_ROWS / max(1, len(budgets))))))
    level, rows, kept = 0, of_sources(items, budgets), None
    while left:
        width = 1 << max(0, HASH_BITS - (level + 1) * bits)
        last = width == 1
        hist: dict[str, list] = {s: [] for s in left}
        for r in histogram(rows, level, bits).collect():  # at most HISTOGRAM_ROWS rows, or four a source
            if r["source"] in hist:
                hist[r["source"]].append((r["bucket"], r["tokens"], r["one"]))
        inner: dict[str, float] = {}
        low: dict[str, int] = {}
        for s, rest in left.items():
            for bucket, tokens, one in sorted(hist[s]):
                if tokens > rest:
                    if one or last:
                        out[s] = (bucket * width, rest)
                    else:
                        inner[s], low[s] = rest, bucket * width
                    break
                rest -= tokens
            else:
                out[s] = (1 << HASH_BITS, rest)
        left, level = inner, level + 1
        if left:
            bounds = spark.createDataFrame([(s, low[s], low[s] + width) for s in left], "source string, lo bigint, hi bigint")
            rows = (items if kept is None else kept).join(F.broadcast(bounds), "source").filter((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("hi"))).drop("lo", "hi")  # one row a source
            rows = materialize(rows)
            if kept is not None:
                release(kept)
            kept = rows
    if kept is not None:
        release(kept)
    return out


def first_fitting(rows: DataFrame, budgets: dict[str, float]) -> dict[str, tuple[int, int]]:
    """Per source the smallest hash whose documents fit the budget, and their tokens; those of one hash (an id's repeated rows) go together."""
    most = rows.sparkSession.createDataFrame([(s, int(b)) for s, b in budgets.items()], "source string, most bigint")
    one = rows.join(F.broadcast(most), "source").filter((F.col("tokens") > 0) & (F.col("tokens") <= F.col("most"))).groupBy("source", "h", "most").agg(F.sum("tokens").alias("tokens"))  # one row a source
    got = one.filter(F.col("tokens") <= F.col("most")).groupBy("source").agg(F.min(F.struct("h", "tokens")).alias("first")).collect()
    return {r["source"]: (r["first"]["h"], r["first"]["tokens"]) for r in got}


def cuts_for(items: DataFrame, budgets: dict[str, float]) -> dict[str, list[tuple[int, int, int]]]:
    """Per source the cuts (low, high, size) whose documents come near the budget without exceeding it.

    After the first threshold, each round takes documents left out of at most a
    quarter of what is left, so the rest shrinks to a quarter at least as long
    as there are enough of them; where there is none, of at most a half, and then
    of all that fit.  It ends when no document left out fits; those of one hash
    (repeated rows of an id) are taken together or not at all.  The documents
    that still fit are written every round, so the next reads only them.
    """
    spark = items.sparkSession
    out: dict[str, list[tuple[int, int, int]]] = {s: [] for s in budgets}
    left, most = dict(budgets), dict.fromkeys(budgets, 1 << 62)  # the first round takes documents of any size
    cap: dict[str, int] = {}  # of sources whose ids have so many rows that shorter documents come first
    rows, kept, least = items, None, {}
    while left:
        found = thresholds(rows, left)
        stuck = {} if kept is None else {s: rest for s, (_, rest) in found.items() if rest == left[s]}  # documents of one hash are too many
        cap |= {s: most[s] // 2 for s in stuck}
        alone = {s: rest for s, rest in stuck.items() if cap[s] < least[s]}
        single = first_fitting(kept, alone) if alone else {}
        bounds = []
        for s, (high, rest) in found.items():
            if s in single:
                cut, rest = (single[s][0], single[s][0] + 1, int(rest)), rest - single[s][1]
            elif s in alone:
                continue
            else:
                cut = (0, 0 if s in stuck else high, most[s])
            if cut[1] > 0:
                out[s].append(cut)
            if rest >= 1 and (kept is not None or high < 1 << HASH_BITS):
                bounds.append((s, *cut, int(rest)))
        left = {}
        if bounds:
            table = spark.createDataFrame(bounds, "source string, low bigint, high bigint, size bigint, rest bigint")
            taken = (F.col("h") >= F.col("low")) & (F.col("h") < F.col("high")) & (F.col("tokens") <= F.col("size"))
            fit = materialize((items if kept is None else kept).join(F.broadcast(table), "source").filter((F.col("tokens") > 0) & (F.col("tokens") <= F.col("rest")) & ~taken).select(items.columns))  # one row a source
            if kept is not None:
                release(kept)
            kept = fit
            least = {r["source"]: r["least"] for r in kept.groupBy("source").agg(F.min("tokens").alias("least")).collect()}  # at most one row a source
            left = {s: rest for s, *_, rest in bounds if s in least}
        if left:
            most = {s: next(n for n in (min(cap.get(s, rest), rest // 4), rest // 4, rest // 2, rest) if n >= least[s]) for s, rest in left.items()}
            rows = kept.join(F.broadcast(spark.createDataFrame(list(most.items()), "source string, most bigint")), "source").filter(F.col("tokens") <= F.col("most")).drop("most")  # one row a source
    if kept is not None:
        release(kept)
    return out


def plan_mix(items: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None) -> list[SourcePlan]:
    """How much of each source is taken.  ``items`` as from :func:`hashed`, written.

    ``targets``: share and most repeats by source.  Shares of sources without
    any token are spread over the others in proportion.  ``total`` is the wanted
    size of the mix; by default the largest at which every source still reaches
    its share within its repeats.  At a larger ``total`` a source is taken as
    often as it may be, and its reached share is smaller than its target.
    """
    have = {r["source"]: int(r["tokens"]) for r in of_sources(items, targets).groupBy("source").agg(F.sum("tokens").alias("tokens")).collect() if r["tokens"]}  # one row a target
    live = {s: (w, r) for s, (w, r) in targets.items() if have.get(s, 0) > 0 and w > 0 and r > 0}
    norm = sum(w for w, _ in live.values())
    if not live:
        return [SourcePlan(s, w, r, have.get(s, 0), 0.0, 0, []) for s, (w, r) in targets.items()]
    size = min(r * have[s] * norm / w for s, (w, r) in live.items()) if total is None else total
    plans = []
    for s, (w, r) in targets.items():
        wanted = min(size * w / norm, r * have[s]) if s in live else 0.0
        whole = min(r, int(math.floor(wanted / have[s] + 1e-12))) if s in live else 0
        plans.append(SourcePlan(s, w, r, have.get(s, 0), wanted, whole, []))
    budgets = {p.source: math.floor(p.wanted - p.whole * p.available + 1e-6) for p in plans if p.source in live and p.whole < p.max_repeat and p.wanted > p.whole * p.available}
    cut = cuts_for(items, budgets) if budgets else {}
    for p in plans:
        p.cuts = cut.get(p.source, [])
    return plans


def counted(items: DataFrame, plans: list[SourcePlan]) -> DataFrame:
    """(item_id, source, tokens, h, whole, copies) of all documents of the target sources; copies of 0 are left out of the mix."""
    rules = [(p.source, p.whole, p.cuts) for p in plans]
    table = items.sparkSession.createDataFrame(rules, "source string, whole int, cuts array<struct<low:bigint,high:bigint,size:bigint>>")
    j = items.join(F.broadcast(table), "source")  # one row a target source
    more = F.exists("cuts", lambda c: (F.col("h") >= c["low"]) & (F.col("h") < c["high"]) & (F.col("tokens") <= c["size"]))
    return j.select("item_id", "source", "tokens", "h", "whole", (F.col("whole") + more.cast("int")).alias("copies"))


def mix(items: DataFrame, plans: list[SourcePlan]) -> DataFrame:
    """(item_id, source, tokens, copies) of the documents taken: one filter, no sort."""
    return counted(items, plans).select("item_id", "source", "tokens", "copies").filter(F.col("copies") > 0)


def still_fitting(items: DataFrame, plans: list[SourcePlan], reached: dict[str, int]) -> set[str]:
    """Sources of which a document, taken once more than all are, would still fit what the tokens reached leave of the wanted ones."""
    rest = {p.source: math.floor(p.wanted - reached[p.source] + 1e-6) for p in plans}
    return set(first_fitting(counted(items, plans).filter(F.col("copies") == F.col("whole")), rest))


def shares(mixed: DataFrame, plans: list[SourcePlan]) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, max_copies) of every target source."""
    spark = mixed.sparkSession
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("max_copies"))
    t = spark.createDataFrame([(p.source, p.share) for p in plans], "source string, target_share double").join(got, "source", "left")
    total = got.agg(F.sum("tokens").alias("_all"))
    j = t.join(F.broadcast(total), how="left")  # one row
    return j.select("source", "target_share", F.coalesce(F.try_divide("tokens", "_all"), F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"))
