"""Every query of the reference's operators against its SQL."""

from __future__ import annotations

import pytest
from conftest import DATA, agree

from corpuslake.plans.queries import FOUND, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert agree(FOUND[name](spark, DATA), SQL[name]) > 0
