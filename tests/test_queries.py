"""Every registered query against DuckDB on the smallest fixture; those without SQL must run."""

import duckdb
import pytest

from quarrylight import plans
from tests.oracle import difference, views


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    views(c, sf)
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_duckdb(spark, sf, con, name):
    assert difference(plans.queries()[name](spark, sf), con, plans.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
