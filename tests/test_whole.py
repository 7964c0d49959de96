"""Cases that must not be cut, dropped or mistaken: long lists, deep wraps, nested lists, missing days, long reports."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from minespark import scratch
from minespark.operators import assoc, features, nested, references, rows, snapshots
from minespark.sources import nested_json, readers, writers


def test_json_wrapped_in_strings_however_often():
    text = json.dumps({"a": [1]})
    for _ in range(9):
        text = json.dumps(text)
    assert nested_json.decode(text) == {"a": [1]}
    assert nested_json.decode('"plain"') is None and nested_json.decode('"') is None


def test_lists_in_lists_have_tables_of_their_own(spark):
    data = [(1, json.dumps({"edges": [[{"v": 1}, {"v": 2, "more": [[{"w": 3}]]}], {"v": 4}, [[5]]]}))]
    plan, out = nested.shred(spark.createDataFrame(data, "k long, t string"), "k", "t")
    assert {"edges", "edges[]", "edges[][]", "more", "more[]"} <= set(plan.tables)
    inner = {r.id: (r.parent_table, r.parent_id, r.v) for r in nested.flat_table(plan, out, "k", "edges[]").collect()}
    assert inner == {"0.0.0": ("edges", "0.0", "1"), "0.0.1": ("edges", "0.0", "2"), "0.2.0": ("edges", "0.2", None)}
    assert [r.w for r in nested.flat_table(plan, out, "k", "more[]").collect()] == ["3"]
    assert [(r.parent_id, r.value) for r in nested.flat_table(plan, out, "k", "edges[][]").collect()] == [("0.2.0", "5")]
    assert [r.v for r in nested.flat_table(plan, out, "k", "edges").orderBy("id").collect()] == [None, "4", None]


def test_events_without_a_day(spark):
    day = dt.date(2013, 5, 1)
    e = spark.createDataFrame([("a", 1, None, 2.0), ("a", 1, day, 3.0), ("b", 1, None, 1.0)], "e string, k int, d date, x double")
    cum = features.cumulative_table(e, "e", "k", "d", "x")
    for as_of in (None, "2013-12-31"):
        got = {r.e: r for r in features.as_of_features(cum, "e", "k", as_of, (400,)).collect()}
        assert (got["a"].n, float(got["a"].total), got["a"].last_day, got["a"].n_400d) == (2, 5.0, day, 1)
        assert (got["b"].n, float(got["b"].total), got["b"].last_day, got["b"].recency_days, got["b"].n_400d) == (1, 1.0, None, None, 0)


def test_long_basket_lines_and_long_reports(spark, tmp_path):
    line = "7, " + ", ".join(map(str, range(1_200_000)))
    got = spark.createDataFrame([(line,), ("8",)], "l string").select(F.size(assoc.item_list(F.col("l"))).alias("n")).collect()
    assert [r.n for r in got] == [1_200_000, 0]
    df = spark.range(2500).select("id", (F.col("id") / 2).alias("half"), F.when(F.col("id") > 3, F.lit("x")).alias("t")).orderBy(F.desc("id"))
    writers.text(str(tmp_path / "r.txt"), writers.frame_lines(df))
    lines = (tmp_path / "r.txt").read_text().splitlines()
    assert len(lines) == 2501 and lines[0].split() == ["id", "half", "t"] and lines[1].split() == ["2499", "1249.5000", "x"] and len({len(x) for x in lines}) == 1
    with pytest.raises(ValueError):
        writers.frame_text(spark.range(20), most=10)
    ranks = spark.range(1500).select(F.col("id").cast("string").alias("id"), (F.col("id") / 1e6).alias("pr"))
    assert sum(1 for _ in writers.rank_report(ranks, 3, 1.0, 2.0)) == 1502


def test_types_of_the_whole_column_and_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,c\n0,0,2\nc\n1,2,p\n2,n,q\n,3,p\n")
    df, label = readers.classified_csv(spark, str(tmp_path / "a.csv"))
    assert label == "c" and dict(df.dtypes)["x"] == "double" and dict(df.dtypes)["y"] == "string" and [r.y for r in df.orderBy("_rid").collect()] == ["2", "n", "3"]
    (tmp_path / "b.csv").write_text("x,y,c\n")
    with pytest.raises(ValueError, match="several files"):
        readers.classified_csv(spark, str(tmp_path))


def test_wide_term_table_and_back(spark, tmp_path):
    tf = spark.createDataFrame([(1, "tea", 2), (1, "hot", 1), (2, "tea", 1)], "doc long, term string, f long")
    writers.term_table(tf, str(tmp_path / "w"), wide=True)
    assert {(int(r.doc), r.term, r.f) for r in readers.vectors_csv(spark, str(tmp_path / "w")).collect()} == {tuple(r) for r in tf.collect()}
    with pytest.raises(ValueError):
        writers.term_table(tf, str(tmp_path / "v"), wide=True, most_words=1)


def test_leaves_follow_the_number_of_keys(spark):
    data = spark.range(3000).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("p")).withColumn("v", F.when((F.col("id") % 50 == 0) & (F.col("p") == 2), 1).otherwise(0))
    want = {(i, 2, "changed") for i in range(0, 3000, 50)}
    for bits in (None, 3, 4, 7, 12):
        assert {tuple(r) for r in snapshots.snapshot_diff(data, "id", "p", ["v"], leaf_bits=bits).collect()} == want
    assert snapshots.snapshot_diff(data.filter("id < 3"), "id", "p", ["v"]).count() == 1


def test_a_filter_that_would_be_full_is_not_used(spark, monkeypatch):
    monkeypatch.setattr(references, "MAX_BITS_LOG2", 10)
    parents = spark.range(4000).select(F.col("id").alias("k"), F.lit(2).alias("y"))
    refs = spark.range(3990, 4010).select(F.col("id").alias("k"), F.lit(2).alias("y"))
    assert sorted(r.k for r in references.orphans(refs, parents, "k", "y").collect()) == list(range(4000, 4010))
    assert references.orphans(refs.limit(0), parents, "k", "y").count() == 0


def test_intermediate_tables_go_to_the_named_folder(spark):
    assert scratch.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_hot_keys_with_many_rows_on_the_other_side(spark, monkeypatch):
    monkeypatch.setattr(rows, "BROADCAST_ROWS", 5)
    left = spark.range(4000).select((F.col("id") % 4).alias("k"), F.col("id").alias("x"))
    right = spark.range(40).select((F.col("id") % 5).alias("k"), F.col("id").alias("y"))
    for how in ("inner", "left", "left_semi"):
        got = rows.skew_join(left, right, "k", how, hot=[0, 1])
        want = left.join(right, "k", how)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
