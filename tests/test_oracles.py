"""Every registered query with SQL, against DuckDB on the smallest tables."""

import pytest

from tallyfold import plans

from .oracle import compare, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = plans.queries()[name](spark, SF)
    assert compare(df.collect(), df.columns, con, plans.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
