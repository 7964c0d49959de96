"""Trees grow until their leaves are pure, however deep that is."""

import pytest

from minespark.operators import tree


def test_tree_deeper_than_fifty(spark):
    rows = [(i, float(i), "AB"[i % 2]) for i in range(130)]  # alternating labels: each split parts one end
    df = spark.createDataFrame(rows, "id int, x double, label string")
    m = tree.c45(df, ["x"], "label", rid="id")
    assert max(r[8] for r in m.node_rows()) > 50
    assert m.transform(df).filter("pred <> label").count() == 0
    top = tree.c45(df, ["x"], "label", rid="id", max_depth=50)
    assert max(r[8] for r in top.node_rows()) == 50


def test_levels_go_on_too(spark, monkeypatch):
    """The level loop hands its depth on: subtrees finished in a task have no limit of their own."""
    rows = [(i, float(i), "AB"[i % 2]) for i in range(130)]
    df = spark.createDataFrame(rows, "id int, x double, label string")
    m = tree.c45(df, ["x"], "label", rid="id", local_rows=128)  # the root's levels are taken by the loop
    assert m.transform(df).filter("pred <> label").count() == 0
    with pytest.raises(ValueError):
        tree.c45(df, ["x"], "label", threshold=-1.0, rid="id")
