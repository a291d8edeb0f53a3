import os

import pytest

from graphloom.plans import corpus_queries, graph_queries

from .oracle import compare

FOLDER = "/root/testdata/sf0.001"
QUERIES = graph_queries.QUERIES | corpus_queries.QUERIES
SQL = graph_queries.ORACLES | corpus_queries.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0
