"""The text operators that SQL can express equal their DuckDB twins."""

from __future__ import annotations

import pytest

from basketry.llm.oracle import oracle_sql
from basketry.llm.queries import queries
from parity import compare, duck_connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_twin(spark, name):
    res = compare(queries()[name](spark, SF), duck_connection(SF), oracle_sql()[name])
    assert res["ok"], res
