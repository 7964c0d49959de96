"""Harmonic packing: exact round trips, capacity, fill; token counts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minespark.llm import packing, tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=120), st.integers(1, 64))
def test_nothing_is_over_capacity(sizes, cap):
    s = np.array([min(x, cap) for x in sizes], dtype=np.int64)
    b = packing.harmonic(s, cap)
    assert len(b) == len(s) and (b >= 0).all()
    if len(s):
        assert np.bincount(b, weights=s).max() <= cap


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=200))
def test_no_more_than_the_harmonic_bound(sizes):
    s = np.array(sizes, dtype=np.int64)
    used = packing.harmonic(s, 100).max() + 1
    assert used <= 1.7 * np.ceil(s.sum() / 100) + packing.CLASSES


def test_round_trip(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 1, 5, 40, 99, 100, 101, 250, 1000, rng.randrange(100)]) for i in range(400)}
    items = spark.createDataFrame([*sizes.items(), (None, 5), (999, None)], "id long, tokens long").withColumn("share", F.lit("clash")).withColumn("bin", F.lit(1))
    kinds = spark.createDataFrame([(1, 100), (2, 256), (3, 0), (None, 7)], "k int, cap int")
    got = packing.pack(items, kinds, "id", "tokens", "k", "cap").collect()
    for kind, cap in ((1, 100), (2, 256)):
        mine = [r for r in got if r.kind_id == kind]
        assert {r.item_id for r in mine} == set(sizes)
        room: dict = {}
        for i, n in sizes.items():
            pieces = sorted((r for r in mine if r.item_id == i), key=lambda r: r.piece)
            assert sum(r.n_tokens for r in pieces) == n and [r.token_start for r in pieces] == [cap * j for j in range(len(pieces))]
            assert len(pieces) == max(1, -(-n // cap))  # cut only beyond the capacity
        for r in mine:
            room[r.bin] = room.get(r.bin, 0) + r.n_tokens
        assert max(room.values()) <= cap
        assert len(room) <= 1.1 * -(-sum(sizes.values()) // cap) + 2
    assert {r.kind_id for r in got} == {1, 2}


def test_partitions_and_order_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE_ROWS", 50)
    items = spark.range(300).select("id", (F.col("id") * 37 % 90 + 1).alias("n"))
    kinds = spark.createDataFrame([(1, 100)], "k int, cap int")

    def run(df):
        return sorted(map(tuple, packing.pack(df, kinds, "id", "n", "k", "cap").collect()))

    assert run(items) == run(items.repartition(7).orderBy(F.desc("id")))
    assert len({r[1] >> 32 for r in run(items)}) == 6


def test_empty(spark):
    items, kinds = spark.createDataFrame([], "id long, n long"), spark.createDataFrame([(1, 10)], "k int, cap int")
    p = packing.pack(items, kinds, "id", "n", "k", "cap")
    assert p.count() == 0 and packing.fill_report(p, kinds, "k", "cap").count() == 0


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    long = "word " * 50_000
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, long), (5, "<|endoftext|>")], "id long, t string").withColumn("tokens", F.lit("clash"))
    n = {r.id: r.tokens for r in tokens.token_counts(df, "t", ["id"]).collect()}
    enc = tokens.encoding()
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] == len(enc.encode_ordinary(long)) and n[5] > 1
    assert tokens.token_counts(df.limit(0), "t", ["id"]).count() == 0
