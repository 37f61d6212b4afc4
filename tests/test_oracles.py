"""Every registered query with a SQL counterpart gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from trafficlens.plans import catalog

ORACLES = catalog.oracles()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con.sql(ORACLES[name])) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["hour", "provider", "requests", "errors", "hit_rate", "p95_ms", "cost_usd"]
    assert df.count() > 0
