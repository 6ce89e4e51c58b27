"""The registry: every query with SQL agrees with it, the others run."""

import pytest

import __spark_entry__ as entry
from graphloom.plans import catalog
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
SLOW = {"experiment_report", "hks_taylor"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_sql(spark, con, name):
    assert compare(spark, con, SMALL, catalog.QUERIES[name], catalog.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - SLOW))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["it", "graph_id", "label", "value"]
