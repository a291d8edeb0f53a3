from graphloom.operators.references import asof_orphans, compress_runs, orphan_references

EDGES = "id bigint, source string, target string, metadata string, run int"
RUNS = "run_id int, started_at timestamp, finished_at timestamp, status string"


def solve(spark, edges, nodes=(), library=(), changes=(), runs=((9, None, None, "success"),)):
    make = spark.createDataFrame
    found = orphan_references(
        make(edges, EDGES), make([(n,) for n in nodes], "id string"), make([(n,) for n in library], "id string"), make(list(changes), "change_id bigint, run_id int, node_id string, op string"), make(list(runs), RUNS)
    )
    return sorted((r["edge_id"], r["side"], r["reason"]) for r in found.collect())


def test_reasons(spark):
    changes = [(1, 3, "d", "delete"), (2, 5, "l", "add"), (3, 2, "w", "delete"), (4, 6, "w", "add"), (5, 6, "w", "add")]
    edges = [(n, "a", t, '{"run": %s}' % r, 0) for n, (t, r) in enumerate([("d", 2), ("d", 3), ("l", 4), ("l", '"5"'), ("w", 1), ("w", 4), ("w", 6), ("lib", 1), ("none", 1), ("x:*:y", 1), ("unresolved-call:q", 1)])]
    expected = [(1, "target", "deleted"), (2, "target", "late"), (5, "target", "deleted"), (8, "target", "missing")]
    assert solve(spark, edges + edges, ["a", "d", "l", "w", "a"], ["lib"], changes) == expected


def test_unreadable_runs_take_the_latest(spark):
    edges = [(1, "a", "d", None, 0), (2, "a", "d", "{bad", 0), (3, "a", "d", '{"run": null}', 0), (4, None, None, None, 0), (None, "zz", "zz", None, 0)]
    assert solve(spark, edges, ["a", "d"], [], [(1, 9, "d", "delete")]) == [(1, "target", "deleted"), (2, "target", "deleted"), (3, "target", "deleted")]


def test_empty_tables(spark):
    assert solve(spark, []) == []
    assert solve(spark, [(1, "a", "b", None, 0)], runs=()) == [(1, "source", "missing"), (1, "target", "missing")]


def test_runs_of_integer_keys(spark):
    keys = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("g", 3), ("g", 7), ("h", 2), ("g", None)], "k string, n int")
    runs = compress_runs(keys, ["k"], "n")
    assert {tuple(r) for r in runs.collect()} == {("g", 1, 3), ("g", 7, 7), ("h", 2, 2)}
    refs = spark.createDataFrame([("g", 0), ("g", 2), ("g", 5), ("g", 5), ("i", 1)], "k string, n int")
    assert {tuple(r) for r in asof_orphans(refs, runs, "k", "n").collect()} == {("g", 0, "late"), ("g", 5, "deleted"), ("i", 1, "missing")}
