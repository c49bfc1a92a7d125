"""Queries with SQL, against DuckDB on the smallest tables."""

import pytest

from tallyfold.llm import queries

from ..oracle import compare, connection
from .conftest import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    assert compare(df.collect(), df.columns, connection(SF), queries.oracle_sql()[name]) is None
