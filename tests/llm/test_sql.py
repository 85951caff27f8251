"""The queries against their SQL on the shared tables."""

from __future__ import annotations

import pytest

from citegrid.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    got, want, columns, names = oracle.compare(queries.queries()[name](spark, sf_dir), oracle.views(sf_dir), queries.oracle_sql()[name])
    assert columns == names and got == want
