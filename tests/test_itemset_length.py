"""Queries of itemsets without a longest length, against brute force on a small fixture."""

import itertools

import pytest

from minespark.plans.registry import QUERIES

ORDERS = [["A", "B", "C", "D", "E"]] * 4 + [["A", "B", "C", "D"], ["A", "B"], ["E"], ["C", "E"], ["F"], []]


@pytest.fixture
def orders(spark, tmp_path):
    rows = [(o, ord(x)) for o, items in enumerate(ORDERS) for x in items]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(ord(x), x) for x in "ABCDEF"], "p_partkey bigint, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def brute():
    """{items: n} of all frequent sets; every order that has lines is a basket."""
    found = {}
    for k in range(1, 7):
        for c in itertools.combinations("ABCDEF", k):
            n = sum(set(c) <= set(o) for o in ORDERS)
            if n > 0.02 * 9:
                found[c] = n
    return found


def test_sets_of_any_length(spark, orders):
    want = brute()
    assert max(map(len, want)) == 5
    assert {tuple(r["items"].split(",")): r["n"] for r in QUERIES["frequent_itemsets"](spark, orders).collect()} == want
    top = {tuple(r["items"].split(",")) for r in QUERIES["maximal_itemsets"](spark, orders).collect()}
    assert top == {("A", "B", "C", "D", "E"), ("F",)}


def test_rules_of_any_length(spark, orders):
    want, rules = brute(), set()
    for items, n in want.items():
        for y in items:
            lhs = tuple(x for x in items if x != y)
            if lhs and n / want[lhs] >= 0.15:
                rules.add((",".join(lhs), y, round(n / 9, 8), round(n / want[lhs], 8)))
    assert {tuple(r) for r in QUERIES["association_rules"](spark, orders).select("antecedent", "consequent", "support", "confidence").collect()} == rules
