import random

import pytest

from graphloom.operators.hierarchy import descendants, graph_links, resolve_hierarchy

SCHEMA = "type string, child string, parent string"


def brute(links):
    parent = {}
    for t, c, p in links:
        if t and c and p:
            parent[t, c] = min(p, parent.get((t, c), p))
    out = {}
    for t, c in parent:
        path, at = [c], c
        while (t, at) in parent and parent[t, at] not in path:
            at = parent[t, at]
            path.append(at)
        if (t, at) in parent:
            loop = path[path.index(parent[t, at]) :]
            out[t, c] = (min(loop), -1)
        else:
            out[t, c] = (at, len(path) - 1)
    return out


def solve(spark, links):
    rows = resolve_hierarchy(spark.createDataFrame(links, SCHEMA)).collect()
    assert len({(r["type"], r["node_id"]) for r in rows}) == len(rows)
    return {(r["type"], r["node_id"]): (r["root_id"], r["depth"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_loops(spark, seed):
    rng = random.Random(seed)
    links = [(rng.choice("ab"), f"n{i}", f"n{rng.randrange(max(0, i - 3), i + 1) if rng.random() < 0.9 else rng.randrange(60)}") for i in range(60)]
    assert solve(spark, links + links[:10]) == brute(links)


def test_long_chain_and_loops(spark):
    links = [("a", f"{i:04}", f"{i + 1:04}") for i in range(300)]
    links += [("b", "x", "x"), ("b", "y", "x"), ("b", "p", "q"), ("b", "q", "r"), ("b", "r", "p"), ("b", "t", "q"), ("b", "s", "t")]
    assert solve(spark, links) == brute(links)


def test_empty_nulls_and_clashing_columns(spark):
    assert solve(spark, []) == {}
    rows = spark.createDataFrame([("a", None, "p", 1), (None, "c", "p", 2), ("a", "c", None, 3), ("a", "c", "p", 4), ("a", "c", "p", 5)], SCHEMA + ", root int")
    assert [tuple(r) for r in resolve_hierarchy(rows).select("node_id", "root_id", "depth").collect()] == [("c", "p", 1)]


def test_paths_and_descendants(spark):
    links = spark.createDataFrame([("a", "c", "b"), ("a", "b", "r"), ("a", "d", "c"), ("a", "l", "l")], SCHEMA)
    found = resolve_hierarchy(links, with_paths=True)
    assert {r["node_id"]: list(r["path"]) for r in found.filter("depth > 0").collect()} == {"b": ["r", "b"], "c": ["r", "b", "c"], "d": ["r", "b", "c", "d"]}
    assert {tuple(r) for r in descendants(found).select("ancestor_id", "node_id", "distance").collect()} == {("r", "b", 1), ("r", "c", 2), ("b", "c", 1), ("r", "d", 3), ("b", "d", 2), ("c", "d", 1)}


def test_links_are_read_from_either_end(spark):
    edges = spark.createDataFrame([("contains", "p", "c", "forward"), ("contains", "c", "p", "backward"), ("extends", "c", "p", "forward"), ("extends", "p", "c", "backward"), ("calls", "x", "y", "forward"), ("contains", None, "c", "forward")], "type string, source string, target string, direction string")
    assert {tuple(r) for r in graph_links(edges).distinct().collect()} == {("contains", "c", "p"), ("extends", "c", "p")}


def ways(links):
    """Per node the steps up to each other node met, and the path from the root or the first node of a loop."""
    parent, up, paths = {}, {}, {}
    for t, c, p in links:
        parent[t, c] = min(p, parent.get((t, c), p))
    for t, c in parent:
        way = [c]
        while (t, way[-1]) in parent and parent[t, way[-1]] not in way:
            way.append(parent[t, way[-1]])
        up |= {(t, a, c): n for n, a in enumerate(way) if n}
        stop = way.index(parent[t, way[-1]]) if (t, way[-1]) in parent else len(way) - 1
        paths[t, c] = way[stop::-1]
    return up, paths


@pytest.mark.parametrize("seed", [3, 4])
def test_nodes_on_and_below_loops_have_paths_and_ancestors(spark, seed):
    rng = random.Random(seed)
    links = [(t, f"n{i}", f"n{rng.randrange(80)}") for t in "ab" for i in range(60)]
    links += [("c", f"{i}", f"{(i + 1) % 7}") for i in range(7)] + [("c", "x", "3"), ("c", "y", "x"), ("c", "z", "y"), ("d", "l", "l"), ("d", "m", "l")]
    found = resolve_hierarchy(spark.createDataFrame(links, SCHEMA), with_paths=True)
    up, paths = ways(links)
    assert {(r["type"], r["node_id"]): list(r["path"]) for r in found.collect()} == paths
    rows = [tuple(r) for r in descendants(found).select("type", "ancestor_id", "node_id", "distance").collect()]
    assert len(rows) == len(up) and {r[:3]: r[3] for r in rows} == up
