"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from probity.plans import load_registry
from oracle import compare, duck

QUERIES, ORACLES = load_registry().QUERIES, load_registry().ORACLES


@pytest.fixture(scope="module")
def connection(small):
    return duck(small)


def test_entry_gives_the_six_metrics(spark):
    rows = entry.entry(spark).collect()
    assert [r["position"] for r in rows] == list(range(6))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert len(QUERIES) >= 150


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, connection, name):
    assert compare(QUERIES[name](spark, small), connection, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
