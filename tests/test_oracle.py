"""Every named query with SQL gives the rows DuckDB gives; the others run and give rows."""

import pytest

import __spark_entry__ as entry_points
from comparing import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_matches_sql(spark, sf_dir, con, name):
    assert compare(entry_points.queries()[name](spark, sf_dir), con, entry_points.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(entry_points.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert entry_points.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
