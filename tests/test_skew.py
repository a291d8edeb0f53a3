from graphloom.operators.skew import hot_targets, target_statistics

EDGES = "type string, target string, weight double, n_nodes int"


def test_counts_multiply_through_the_join(spark):
    edges = spark.createDataFrame([("c", "x", 1.0, 0)] * 3 + [("c", "y", None, 0), ("d", "x", 2.0, 0), (None, None, None, 0)], EDGES)
    nodes = spark.createDataFrame([("x",), ("x",), (None,)], "id string")
    got = {(r["type"], r["target"]): (r["n_edges"], r["n_joined"], r["sum_weight"], r["n_nodes"]) for r in target_statistics(edges, nodes).collect()}
    assert got == {("c", "x"): (3, 6, 3.0, 2), ("c", "y"): (1, 0, None, 0), ("d", "x"): (1, 2, 2.0, 2), (None, None): (1, 0, None, 0)}


def test_hot_targets(spark):
    edges = spark.createDataFrame([("c", "x", 1.0, 0)] * 98 + [("c", "y", 1.0, 0), ("d", "x", 1.0, 0)], EDGES)
    nodes = spark.createDataFrame([], "id string")
    assert {tuple(r)[:2] for r in hot_targets(edges, nodes).collect()} == {("c", "x"), ("c", "y"), ("d", "x")}
    assert {tuple(r)[:2] for r in hot_targets(edges, nodes, 0.5).collect()} == {("c", "x")}
    assert hot_targets(edges.limit(0), nodes).count() == 0
