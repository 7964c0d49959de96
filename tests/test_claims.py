"""Problems 1, 2, 3 and 5: rules, ties, NULLs, repeated rows, empty tables, clashing names."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from minespark.functions import keys as K
from minespark.operators import features, history, references, rows, snapshots


def one(spark, text, fn):
    return [r[0] for r in spark.createDataFrame([(t,) for t in text], "c string").select(fn(F.col("c"))).collect()]


def test_hex_number(spark):
    same = ["0030C4F4B8D8C062", "30c4f4b8d8c062", " 30C4-F4B8-D8C0-62 ", '"0030c4f4b8d8c062"', "'30C4F4B8:D8C062'", "0x30C4F4B8D8C062", "30C4F4B8D8C0_62\t", "000000030C4F4B8D8C062"]
    assert set(one(spark, same, lambda c: K.hex_text(K.hex_number(c)))) == {"0030C4F4B8D8C062"}
    none = [None, "", " ", "-", "?", "N/A", "null", "not given", "XXXX", "unknown", "12345678901234567", "12.5", "g1"]
    assert set(one(spark, none, K.hex_number)) == {None}
    assert one(spark, ["FFFFFFFFFFFFFFFF", "0"], lambda c: K.hex_text(K.hex_number(c))) == ["F" * 16, "0" * 16]


def test_codes_years_dates(spark):
    assert one(spark, ["7", "007", " 7 ", "DRG 7", "DRG007", "0007", "7.0", "'7'"], K.code_number) == [7] * 8
    assert one(spark, [None, "", "1234", "7.5", "x"], K.code_number) == [None] * 5
    assert one(spark, ["2010", " 2010 ", "2010.0", "FY2010", "12-31-2010", "2010-12-31", "12/31/2010", "20101231", "31122010"], K.calendar_year) == [2010] * 9
    assert one(spark, [None, "", "n/a", "12", "1234"], K.calendar_year) == [None] * 5
    assert spark.createDataFrame([(20100228,), (20101350,), (None,)], "c int").select(K.int_date(F.col("c"))).collect() == [(dt.date(2010, 2, 28),), (None,), (None,)]
    assert one(spark, ["Lab Writeups", "lab-writeups", " LAB_WRITEUPS", "", None], K.name_key) == ["lab_writeups"] * 3 + [None] * 2


def test_versions_of_events(spark):
    ts = dt.datetime(2010, 1, 1)
    data = [(1, ts, 1, "a"), (1, ts + dt.timedelta(1), 1, "b"), (2, ts, 1, "a"), (2, ts, -1, "a"), (3, None, None, "c"), (3, ts, None, "d"), (4, ts, 1, "x"), (4, ts, 1, "y"), (4, ts, 1, "y"), (None, ts, 1, "z")]
    df = spark.createDataFrame(data, "id long, ts timestamp, n int, v string").withColumn("_last", F.lit(9))
    got = {r.id: r.v for r in features.resolve_versions(df, "id", "ts", "n", ["v"]).collect()}
    assert got == {1: "b", 3: "d", 4: "y"}
    assert features.resolve_versions(df.limit(0), "id", "ts", "n", ["v"]).count() == 0


def test_features_against_direct_windows(spark):
    rng = random.Random(1)
    start = dt.date(2010, 1, 1)
    data = [(rng.choice("abc"), rng.choice([1, 2, None]), start + dt.timedelta(rng.randrange(400)), rng.choice([None, 1.25, 10.0, -3.5])) for _ in range(500)]
    df = spark.createDataFrame(data, "e string, k int, d date, x double").withColumn("n", F.lit("clash")).withColumn("day", F.lit("clash"))
    end = dt.date(2010, 12, 1)
    f = features.as_of_features(features.cumulative_table(df, "e", "k", "d", "x"), "e", "k", str(end), [30, 90]).collect()
    assert len(f) == 6
    for r in f:
        mine = [(d, x or 0) for e, k, d, x in data if e == r.e and k == r.k and d <= end]
        assert r.n == len(mine) and float(r.total) == pytest.approx(sum(x for _, x in mine))
        assert r.recency_days == (end - max(d for d, _ in mine)).days
        for w in (30, 90):
            late = [x for d, x in mine if d > end - dt.timedelta(w)]
            assert r[f"n_{w}d"] == len(late) and float(r[f"total_{w}d"]) == pytest.approx(sum(late))
    all_time = features.as_of_features(features.cumulative_table(df, "e", "k", "d", "x"), "e", "k", windows=[30])
    assert all_time.agg(F.sum("n")).first()[0] == sum(k is not None for _, k, _, _ in data)
    wide = features.feature_columns(all_time, "e", "k", [1, 2, 7]).filter("e = 'a'").first()
    assert wide.n_7 == 0 and wide.recency_days_7 is None and wide.n_1 > 0
    by = features.feature_rows(all_time, "e", "k").filter("e = 'a'").first()
    assert by.n_kinds == 2 and by.by_kind[1].n + by.by_kind[2].n == by.n
    assert features.feature_rows(features.as_of_features(features.cumulative_table(df.limit(0), "e", "k", "d", "x"), "e", "k"), "e", "k").count() == 0


def brute_versions(known):
    """known: {year: value or None} -> [(from, to)]"""
    out, last, prev = [], None, None
    for y in sorted(known):
        if prev is not None and y != prev + 1:
            last = None
        prev = y
        v = known[y] if known[y] is not None else last
        if v is None:
            continue
        if last == v and out and out[-1][1] == y - 1:
            out[-1][1] = y
        else:
            out.append([y, y])
        last = v
    return [tuple(x) for x in out]


def test_history_against_a_loop(spark):
    rng = random.Random(2)
    want, data = set(), []
    for k in range(200):
        known = {y: rng.choice([0, 1, 1, None]) for y in range(2008, 2014) if rng.random() < 0.75}
        data += [(k, y, v) for y, v in known.items()]
        want |= {(k, *x) for x in brute_versions(known)}
    df = spark.createDataFrame(data + [(None, 2010, 1), (7000, None, 1)], "kind long, y int, v int").withColumn("valid_from", F.lit("clash"))
    got = history.versions(df, "kind", "y", "v")
    assert {(r.kind, r.valid_from, r.valid_to) for r in got.collect()} == want
    assert history.versions(df.limit(0), "kind", "y", "v").count() == 0
    own = history.versions(spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, None)], "k long, p int, v int"), "k", "p", "v", carry_nulls=False).orderBy("valid_from").collect()
    assert [(r.v, r.valid_from, r.valid_to) for r in own] == [(None, 1, 1), (5, 2, 2), (None, 3, 3)]


def test_snapshot_differences_against_sets(spark):
    rng = random.Random(3)
    snap = {(k, y): (rng.choice([1, 2, None]), rng.choice(["a", None, ""])) for k in range(300) for y in (1, 2, 4) if rng.random() < 0.8}
    want = set()
    for y in (2, 3, 4):
        for k in range(300):
            a, b = snap.get((k, y - 1)), snap.get((k, y))
            if a is None and b is not None:
                want.add((k, y, "added"))
            elif a is not None and b is None:
                want.add((k, y, "removed"))
            elif a != b:
                want.add((k, y, "changed"))
    df = spark.createDataFrame([(k, y, *v) for (k, y), v in snap.items()] + [(None, 1, 1, "a")], "k long, leaf int, a int, n string").withColumn("x", F.lit(1))
    got = snapshots.snapshot_diff(df, "k", "leaf", ["a", "n"])
    assert {tuple(r) for r in got.select("k", "leaf", "change_kind").collect()} == want
    assert snapshots.snapshot_diff(df.limit(0), "k", "leaf", ["a", "n"]).count() == 0
    assert snapshots.snapshot_diff(df.filter("leaf = 1"), "k", "leaf", ["a", "n"]).count() == 0


def test_swapped_null_is_a_change(spark):
    df = spark.createDataFrame([(1, 1, 5, None), (1, 2, None, 5)], "k long, p int, a int, b int")
    assert [r.change_kind for r in snapshots.snapshot_diff(df, "k", "p", ["a", "b"]).collect()] == ["changed"]


def test_only_differing_leaves_are_opened(spark):
    base = spark.range(2000).select(F.col("id").alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("p")).withColumn("v", F.when((F.col("k") == 77) & (F.col("p") == 2), 1).otherwise(0))
    r = base.select("k", F.col("p").cast("bigint").alias("_p"), F.shiftrightunsigned(F.xxhash64("k", F.lit(7)), 52).alias("_leaf"), F.xxhash64("k", "v").alias("_h1"), F.xxhash64("v", "k").alias("_h2"))
    open_leaves = snapshots.differing_leaves(snapshots.leaf_digests(r, "_p"), "_p", 12, 4).filter("_p = 2").collect()
    assert len(open_leaves) == 1


def test_orphans(spark):
    parents = spark.createDataFrame([(1, 2008), (1, 2010), (2, 2009), (-5, 2012), (None, 2008), (9, None)], "key long, p int")
    refs = spark.createDataFrame([(1, 2009, "a"), (1, 2011, "b"), (1, 2007, "c"), (3, 2009, "d"), (None, 2009, "e"), (2, 2009, "f"), (3, 2009, "d"), (-5, 2011, "g"), (9, 2010, "h"), (1, None, "i")], "key long, p int, reason string")
    got = sorted((r.key, r.p, r.reason) for r in references.orphans(refs.withColumn("n", F.lit(1)), parents, "key", "p").collect())
    assert got == [(-5, 2011, "later"), (1, 2007, "later"), (1, 2011, "deleted"), (3, 2009, "missing"), (3, 2009, "missing"), (9, 2010, "missing")]
    assert references.orphans(refs.limit(0), parents, "key", "p").count() == 0
    assert {r.reason for r in references.orphans(refs, parents.limit(0), "key", "p").collect()} == {"missing"}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select((F.col("id") * 7919).alias("k"))
    words = references.bloom_words(keys, "k", 16)
    ok = keys.select(references.bloom_test(keys, "k", words, 16).alias("m")).agg(F.bool_and("m")).first()[0]
    assert ok
    other = spark.range(5000).select((F.col("id") * 7919 + 1).alias("k"))
    wrong = other.select(references.bloom_test(other, "k", words, 16).cast("int").alias("m")).agg(F.avg("m")).first()[0]
    assert wrong < 0.05


def test_hot_key_join_equals_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.createDataFrame([(1, -1)], "k long, v long"))
    assert rows.heavy_keys(left, "k", min_rows=500) == [1]
    for how in ("inner", "left", "left_semi"):
        a = sorted(map(tuple, rows.skew_join(left, right, "k", how, hot=[1]).collect()), key=repr)
        assert a == sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)


def test_latest_rows_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "z"), (None, 1, "n"), (2, None, "x")], "k int, o int, v string")
    got = sorted(map(tuple, rows.latest_rows(df, ["k"], ["o"], ["v"]).collect()), key=repr)
    assert got == [(1, "b"), (2, "x"), (None, "n")]


