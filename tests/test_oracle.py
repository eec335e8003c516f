import os

import pytest

import oracle
from tallyforge import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, con):
    oracle.check(queries.QUERIES[name], queries.SQL[name], spark, SF, con)


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_query_runs(name, spark):
    assert queries.QUERIES[name](spark, SF).count() > 0
