"""The numbered queries that SQL can express against their SQL, on whole tables."""

from __future__ import annotations

import pytest
from conftest import DATA, agree

from corpuslake.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert agree(queries.queries()[name](spark, DATA), SQL[name]) > 0
