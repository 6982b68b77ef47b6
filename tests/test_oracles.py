"""Every registered query against its SQL on the smallest given tables."""

import pytest
from checking import compare, duck

import __spark_entry__ as entry_points
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, _ = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert problem == ""


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
