"""Every query of the subpackage on the smallest tables."""

import pytest
from parity import compare

from minespark.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert compare(spark, QUERIES[name], SQL[name], DATA) == ""
    else:
        assert QUERIES[name](spark, DATA).count() >= 0
