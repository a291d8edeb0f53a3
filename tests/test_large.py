"""Plans and rows of what must hold for tables that are small on disk and large in memory."""

import datetime

import pytest
from pyspark.sql import functions as F

from graphloom import workspace
from graphloom.operators import traverse
from graphloom.plans.star import star_edges, star_nodes
from graphloom.sources.graph_store import GraphStore

MANY = 300_000


@pytest.fixture
def saved(monkeypatch):
    """The name and the plan of every table that is saved."""
    plans, save = [], workspace.Scratch.save

    def kept(self, df, name="t"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return save(self, df, name)

    monkeypatch.setattr(workspace.Scratch, "save", kept)
    return plans


def numbered(spark, n=MANY):
    """Ids that follow one another, which take little room on disk."""
    return spark.range(n).select(F.format_string("node:/w/node:%d", "id").alias("id"), F.lit("node").alias("type"), F.lit("n").alias("name"), F.lit("/w").alias("file_path"), F.lit("pk").alias("package_id"))


def chain(spark, n=MANY):
    """An edge from each node to the next."""
    return spark.range(n - 1).select(F.col("id").alias("edge_id"), F.format_string("node:/w/node:%d", "id").alias("source"), F.format_string("node:/w/node:%d", F.col("id") + 1).alias("target"), F.lit("calls").alias("edge_type"))


def test_many_nodes_are_not_broadcast_to_the_edges(spark, saved):
    store = GraphStore(spark, numbered(spark), chain(spark))
    plan = dict(saved)["edges"]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert store.edges.filter("live and from_package = 'pk' and to_package = 'pk'").count() == MANY - 1


def test_star_edges_know_their_ends_as_a_join_of_ids_finds_them(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    for name, columns, rows in [
        ("region", "r_regionkey int, r_name string", [(0, "R0"), (1, "R1")]),
        ("nation", "n_nationkey int, n_name string, n_regionkey int", [(0, "N0", 0), (1, "N1", 7), (2, "N2", None), (2, "N2 again", 1)]),
        ("customer", "c_custkey bigint, c_name string, c_nationkey int", [(1, "C1", 0), (1, "C1 again", 2), (2, "C2", 9), (None, "C", 0)]),
        ("supplier", "s_suppkey bigint, s_name string, s_nationkey int", [(1, "S1", 2), (2, "S2", None)]),
        ("part", "p_partkey bigint, p_name string", [(1, "P1"), (3, "P3"), (3, "P3 again")]),
        ("orders", "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string", [(1, 1, day, "1"), (2, 5, day, "2"), (2, 2, day, "2"), (3, None, day, "3")]),
        ("lineitem", "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int", [(1, 1, 1, 1), (2, 3, 2, 1), (4, 1, 1, 2), (None, 3, 1, 1), (3, None, None, 1)]),
    ]:
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    known, nodes = star_edges(spark, str(tmp_path)), star_nodes(spark, str(tmp_path))
    bare = known.select("edge_id", "source", "target", "edge_type").distinct()  # repeated rows of an end repeat its edges below
    columns = ["edge_id", "source", "target", "edge_type", "live", "from_package", "to_package"]
    expected = GraphStore(spark, nodes, bare).edges.select(*columns)
    assert sorted({tuple(map(str, r)) for r in known.select(*columns).collect()}) == sorted({tuple(map(str, r)) for r in expected.collect()})
    counts = {r["edge_id"]: r["count"] for r in known.groupBy("edge_id").count().collect()}
    assert counts[3_000_000_001] == 2 and counts[10_000_000_017] == 4 and counts[20_000_000_017] == 2


def star(spark, n=MANY):
    """From s to each node and from there to t."""
    ids = spark.range(n).select("id", F.format_string("node:/w/node:%d", "id").alias("node"))
    out = ids.select(F.col("id").alias("edge_id"), F.lit("s").alias("source"), F.col("node").alias("target"), F.lit("calls").alias("edge_type"))
    return out.unionByName(ids.select((F.col("id") + n).alias("edge_id"), F.col("node").alias("source"), F.lit("t").alias("target"), F.lit("calls").alias("edge_type")))


def test_many_nodes_of_a_level_are_not_broadcast_on_the_way_to_a_path(spark, saved):
    edges = workspace.Scratch(spark, "t").save(star(spark), "given")
    found = traverse.shortest_path(edges, "s", "t").first()
    assert (found["hops"], found["path"]) == (2, ["s", "node:/w/node:0", "t"])
    meeting = [plan for name, plan in saved if name == "both"][-1]
    assert "SortMergeJoin" in meeting and "BroadcastHashJoin" not in meeting


def test_labels_of_a_path_do_not_broadcast_the_nodes(spark):
    nodes = workspace.Scratch(spark, "t").save(numbered(spark), "given")
    path = spark.createDataFrame([(2, ["node:/w/node:7", "nobody", "node:/w/node:299999"])], "hops int, path array<string>")
    rows = traverse.path_labels(path, nodes)
    assert "LeftSemi" in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.select("pos", "label").collect())) == [(0, "node:n"), (1, "nobody"), (2, "node:n")]


@pytest.mark.parametrize(("downstream", "root", "n", "join", "never"), [(True, "node:/w/node:1", 2, "BuildLeft", "BuildRight"), (False, "t", 2 * MANY, "SortMergeJoin", "BroadcastHashJoin")])
def test_names_of_dependencies_are_joined_by_the_number_of_their_rows(spark, downstream, root, n, join, never):
    scratch = workspace.Scratch(spark, "t")
    ends = spark.createDataFrame([("s", "node", "s", "/w", "pk"), ("t", "node", "t", "/w", "pk")], "id string, type string, name string, file_path string, package_id string")
    store = GraphStore(spark, scratch.save(numbered(spark).unionByName(ends), "nodes"), scratch.save(star(spark), "edges"))
    rows = traverse.dependencies(store.nodes, store.edges, root, downstream, 3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert join in plan and never not in plan
    assert rows.count() == n - downstream


@pytest.mark.parametrize(("step", "join", "never"), [(1, "BroadcastHashJoin", "SortMergeJoin"), (64, "SortMergeJoin", "no such join")])
def test_many_keys_of_star_ends_are_sent_whole_only_if_they_are_close(spark, tmp_path, step, join, never):
    keys = spark.range(-100, MANY - 100).select((F.col("id") * step).alias("key"))
    tables = {
        "region": spark.sql("SELECT 0 AS r_regionkey, 'R' AS r_name"),
        "nation": spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey"),
        "customer": keys.unionByName(spark.createDataFrame([(-step,), (70 * step,)], "key long")).selectExpr("key AS c_custkey", "'C' AS c_name", "0 AS c_nationkey"),
        "supplier": spark.sql("SELECT 1L AS s_suppkey, 'S' AS s_name, 0 AS s_nationkey"),
        "part": spark.sql("SELECT 1L AS p_partkey, 'P' AS p_name"),
        "orders": keys.unionByName(spark.createDataFrame([(-101 * step,), (10**12,), (None,)], "key long")).selectExpr("coalesce(key, 5) AS o_orderkey", "key AS o_custkey", "'1' AS o_orderpriority"),
        "lineitem": spark.sql("SELECT 1L AS l_orderkey, 1L AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    edges = star_edges(spark, str(tmp_path))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert join in plan and never not in plan
    calls = edges.filter("edge_type = 'calls' and target is not null").groupBy("live", F.col("target").isin(f"customer:/w/customer:{-step}", f"customer:/w/customer:{70 * step}").alias("twice")).count().collect()
    # of step 1, the order without a customer repeats key 5: its order is met twice, and so is the edge
    assert {(r["live"], r["twice"]): r["count"] for r in calls} == {(True, False): MANY - 2 + (step == 1), (True, True): 4, (False, False): 2}
