"""Queries whose registered SQL covers less than the whole job, against SQL that covers it."""

import os

import pytest

from graphloom.plans import graph_queries
from graphloom.plans.graph_sql import _GRAPH, _INDEX, _TRAVERSED

from .oracle import compare, duck_rows

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_custom_edges_of_scope_all_pair_the_whole_graph(spark):
    compare(spark, graph_queries.custom_edges_all, f"WITH {_GRAPH} SELECT a.id AS source, b.id AS target FROM gn a JOIN gn b ON b.type = 'interface' AND a.id <> b.id WHERE a.type = 'class'", FOLDER)


def test_impact_tests_walk_six_hops_from_the_root_and_its_symbols(spark):
    sql = rf"""WITH RECURSIVE {_GRAPH}, step AS (SELECT source, target FROM ge WHERE edge_type IN {_TRAVERSED} UNION SELECT target, source FROM ge WHERE edge_type IN {_TRAVERSED}),
held AS (SELECT target AS node FROM ge WHERE edge_type = 'contains' AND source = '{_INDEX}'),
reach AS (SELECT node, 0 AS hops FROM (SELECT '{_INDEX}' AS node UNION SELECT node FROM held UNION SELECT id FROM gn WHERE 'file:' || file_path = '{_INDEX}' AND id <> '{_INDEX}' AND NOT EXISTS (SELECT 1 FROM held)) s
UNION SELECT s.target, r.hops + 1 FROM reach r JOIN step s ON s.source = r.node WHERE r.hops < HOPS)
SELECT DISTINCT file_path FROM gn WHERE type = 'file' AND id IN (SELECT node FROM reach) AND regexp_matches(file_path, '\.(?:test|spec)\.tsx?|__tests__/|e2e/|playwright/')"""
    compare(spark, graph_queries.impact_tests, sql.replace("HOPS", "6"), FOLDER)
    assert len(duck_rows(FOLDER, sql.replace("HOPS", "6"))[1]) > len(duck_rows(FOLDER, sql.replace("HOPS", "2"))[1])
