"""Mixtures: shares, repeats, one-sided sources, thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from minespark.llm import mixing


def items(spark, seed=1, sizes=(("big", 3000), ("mid", 500), ("small", 40), ("other", 100))):
    rng = random.Random(seed)
    rows, i = [], 0
    for s, n in sizes:
        for _ in range(n):
            rows.append((i, s, rng.choice([1, 5, 20, 100, 400])))
            i += 1
    df = spark.createDataFrame(rows, "id long, s string, n long").withColumn("h", F.lit("clash")).withColumn("copies", F.lit(3))
    return mixing.hashed(df, "id", "s", "n"), rows


TARGETS = {"big": (0.5, 1), "mid": (0.3, 2), "small": (0.1, 5), "absent": (0.1, 3)}


def test_shares_and_repeats(spark):
    it, rows = items(spark)
    plans = mixing.plan_mix(it, TARGETS)
    got = {r.source: r for r in mixing.shares(mixing.mix(it, plans), plans).collect()}
    assert set(got) == set(TARGETS) and got["absent"].reached_share == 0 and got["absent"].tokens == 0
    for s in ("big", "mid", "small"):
        assert got[s].reached_share == pytest.approx(TARGETS[s][0] / 0.9, abs=0.003)
        assert got[s].max_copies <= TARGETS[s][1]
    total = {s: sum(n for _, t, n in rows if t == s) for s in TARGETS}
    want = min(r * total[s] * 0.9 / w for s, (w, r) in TARGETS.items() if s != "absent")
    assert sum(r.tokens for r in got.values()) == pytest.approx(want, rel=0.003)


def test_too_large_a_total_is_capped(spark):
    it, rows = items(spark)
    plans = mixing.plan_mix(it, TARGETS, total=10**9)
    m = {r.source: r for r in mixing.mix(it, plans).groupBy("source").agg(F.min("copies").alias("lo"), F.max("copies").alias("hi"), F.count("*").alias("n")).collect()}
    assert {s: (r.lo, r.hi) for s, r in m.items()} == {"big": (1, 1), "mid": (2, 2), "small": (5, 5)}


def test_thresholds_fill_without_exceeding(spark):
    it, rows = items(spark)
    for budget in (0, 1, 777, 12_345, 10**9):
        got = mixing.cuts_for(it, {"big": budget, "mid": budget})
        for s in ("big", "mid"):
            cond = F.lit(False)
            for low, high, size in got[s]:
                cond = cond | ((F.col("h") >= low) & (F.col("h") < high) & (F.col("tokens") <= size))
            taken = it.filter((F.col("source") == s) & cond).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
            have = sum(n for _, t, n in rows if t == s)
            assert taken <= budget and taken >= min(have, budget) - 8


def test_many_sources_and_few_rows_of_a_histogram(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HISTOGRAM_ROWS", 64)
    rows = [(i, f"s{i % 40}", 1 + i % 7) for i in range(4000)]
    it = mixing.hashed(spark.createDataFrame(rows, "id long, s string, n long"), "id", "s", "n")
    got = mixing.thresholds(it, {f"s{i}": 150.0 for i in range(30)})
    for i in range(30):
        high, rest = got[f"s{i}"]
        taken = it.filter((F.col("source") == f"s{i}") & (F.col("h") < high)).agg(F.sum("tokens")).first()[0]
        assert taken + rest == 150 and 0 <= rest < 7


def test_spellings_of_one_target_add_up(spark, tmp_path):
    from minespark.llm import queries

    spark.createDataFrame([("My Source", 0.25, 1), ("my_source", 0.25, 3), ("other", 0.5, 2), (None, 0.1, 1)], "source string, target_share double, max_repeat int").write.parquet(str(tmp_path / "mix_target.parquet"))
    assert queries._targets(spark, str(tmp_path)) == {"my_source": (0.5, 3), "other": (0.5, 2)}


def test_smaller_budgets_take_subsets(spark):
    it, _ = items(spark)
    low = mixing.thresholds(it, {"big": 1000})["big"][0]
    high = mixing.thresholds(it, {"big": 50_000})["big"][0]
    assert low < high


def test_nulls_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 5), (None, "a", 5), (3, "a", 10), (3, "a", 10)], "id long, s string, n long")
    it = mixing.hashed(df, "id", "s", "n")
    assert it.count() == 3
    plans = mixing.plan_mix(it, {"a": (1.0, 2)})
    assert mixing.mix(it, plans).agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] == 40
    none = mixing.hashed(df.limit(0), "id", "s", "n")
    plans = mixing.plan_mix(none, {"a": (1.0, 2)})
    assert mixing.mix(none, plans).count() == 0 and mixing.shares(mixing.mix(none, plans), plans).first().reached_share == 0
    assert mixing.plan_mix(it, {}) == []


def placed(spark, rows):
    """Items of one source from (id, h, tokens)."""
    return spark.createDataFrame([(i, "a", n, h) for i, h, n in rows], "item_id long, source string, tokens long, h long")


def test_rounds_go_on_until_no_document_fits(spark):
    it = placed(spark, [(0, 0, 500), (1, 1 << 50, 1000), (2, 1 << 51, 10), (3, 1 << 52, 10), (4, 1 << 53, 60), (5, 1 << 54, 60)])
    plan = mixing.SourcePlan("a", 1.0, 1, 1640, 600, 0, mixing.cuts_for(it, {"a": 600})["a"])
    assert {r.item_id for r in mixing.mix(it, [plan]).collect()} == {0, 2, 3, 4}  # 580: the documents of 10 are a quarter of what is left, one of 60 fits then


@pytest.mark.parametrize("repeated", [1, 3, 11])
def test_no_document_left_out_fits(spark, repeated):
    rng = random.Random(3)
    rows = [(i, rng.getrandbits(60), rng.choice([0, 3, 40, 170, 450, 3000, 40_000])) for i in range(120)]
    rows += [r for r in rows for _ in range(r[0] % repeated)]
    it = placed(spark, rows)
    for budget in (2, 700, 2_999, 47_200):
        cuts = mixing.cuts_for(it, {"a": budget})["a"]
        out, used = {}, 0
        for i, h, n in rows:
            if any(low <= h < high and n <= size for low, high, size in cuts):
                used += n
            else:
                out[i] = out.get(i, 0) + n  # an id's rows go together
        assert used <= budget and not [n for n in out.values() if 0 < n <= budget - used]


def test_thresholds_are_exact_if_levels_do_not_divide_the_hash(spark):
    budgets = {"a": 10} | {f"s{i}": 1 for i in range(1000)}  # 8 bits a level
    assert mixing.thresholds(placed(spark, [(0, 16, 10), (1, 17, 10)]), budgets)["a"] == (17, 0)


def test_kept_is_measured_in_tokens_and_sees_documents_left_out(spark, tmp_path, monkeypatch):
    from minespark.llm import queries, tokens

    docs = [(0, "a", "internationalization " * 400)] + [(i, "a", "one two") for i in range(1, 30)] + [(i, "b", "three four five") for i in range(30, 34)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeat int").write.parquet(str(tmp_path / "mix_target.parquet"))
    plans = []
    made = mixing.plan_mix
    monkeypatch.setattr(mixing, "plan_mix", lambda *a: plans.extend(made(*a)) or plans)
    assert sorted(map(tuple, queries.p9_kept(spark, str(tmp_path)).collect())) == [("a", 0.5, True, True, True), ("b", 0.5, True, True, True)]
    assert {p.source: p.available for p in plans} == {s: sum(tokens.count(tokens.encoding(), t) for _, x, t in docs if x == s) for s in "ab"}
    plans.clear()
    monkeypatch.setattr(mixing, "cuts_for", lambda items, budgets: {})  # nothing is taken of a, although short documents fit
    assert {r.source: r.reached for r in queries.p9_kept(spark, str(tmp_path)).collect()} == {"a": False, "b": True}
