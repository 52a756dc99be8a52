"""Every registered query equals its DuckDB twin, value by value (rows, columns, types, values)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from marquee import registry
from oracle_harness import compare, duck

QUERIES = registry.queries()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_a_sql_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert ok, message


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 30
    assert df.columns == ["decade", "title_type", "average_rating", "title_count", "total_votes",
                          "median_rating", "prev_decade_rating", "rating_change"]
