"""Every registered query of the core runs on the smallest tables and, where it has SQL, equals it."""

import pytest
from parity import compare

from minespark.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert compare(spark, QUERIES[name], SQL[name], DATA) == ""
    else:
        assert QUERIES[name](spark, DATA).count() >= 0
