"""Every named query against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry_points

RUNS, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(RUNS[name](spark, sf_dir), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(RUNS) - set(SQL)))
def test_query_gives_rows(spark, sf_dir, name):
    assert RUNS[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
