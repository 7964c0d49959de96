"""Raters in blocks: not copied to the blocks they meet, compared once where equal, none lost."""

import pytest
from test_customers import predicted, same

from minespark.operators import recommend

ROWS = [(u, f"i{i}", float((u % 6 * 7 + i * i * 3) % 11)) for u in range(60) for i in range(9) if (u % 6 * 5 + i * 3) % 4] + [(90, "i1", 4.0), (91, "alone", 4.0), (92, "i1", 4.0), (93, "i2", 4.0), (94, "i2", 4.0)]
SPARSE = [(u, f"i{i}", float((u * 7 + i * i * 3) % 11)) for u in range(150) for i in range(30) if (u * 5 + i * 3) % 13 == 0 or i == u % 2]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("how", ["weighted-sum", "adjusted-weighted-sum", "mean-utility"])
def test_equal_raters_leave_only_themselves_out(spark, how, monkeypatch):
    monkeypatch.setattr(recommend, "BLOCK", 4)
    for rows in (ROWS, SPARSE):
        r = spark.createDataFrame(rows, "user int, item string, rating double")
        got = recommend.predict(r, recommend.all_cells(r), "user", how, 3, blocks=True)
        assert "CoGroup" not in plan(got) and "Join" not in plan(got)  # neither copies nor rows of neighbours
        same({(x.user, x.item): x.pred for x in got.collect()}, predicted({(u, i): x for u, i, x in rows}, False, how, 3), 1e-8)


def test_equal_raters_by_name(spark, monkeypatch):
    monkeypatch.setattr(recommend, "CELLS", 5)
    r = spark.createDataFrame([(i, str(u), x) for u, i, x in ROWS], "user string, item string, rating double")
    got = recommend.predict(r, recommend.all_cells(r), "item", "weighted-sum", 2, blocks=True)
    assert "CoGroup" not in plan(got)
    same({(x.user, x.item): x.pred for x in got.collect()}, predicted({(i, str(u)): x for u, i, x in ROWS}, True, "weighted-sum", 2), 1e-8)


def test_pairs_of_raters_are_not_copied(spark, monkeypatch):
    monkeypatch.setattr(recommend, "BLOCK", 4)
    r = spark.createDataFrame(SPARSE, "user int, item string, rating double")
    got = recommend.similarity_in_blocks(r)
    assert "CoGroup" not in plan(got) and "Generate" not in plan(got)
    same({(x.a, x.b): x.sim for x in got.collect()}, {(x.a, x.b): x.sim for x in recommend.similarity(r).collect()}, 1e-9)
