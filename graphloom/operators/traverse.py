"""Bounded traversals of the property graph.

One expansion step serves all profiles: the frontier, keyed by its node, meets the
edges on one end. Profiles differ in direction, edge types, what blocks a step, and
whether paths or nodes are kept. Paths of bounded length are lazy unions of levels;
closures over nodes cut their lineage at every level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.graph import CALLER_TYPES, IMPACT_TYPES, TRAVERSED, live_edges
from graphloom.workspace import Scratch, by_size


def _union(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def _grown(spark, level: DataFrame, depth: int, grow) -> tuple[DataFrame, int]:
    """All levels of a traversal and their number of rows. Each is saved before the next grows
    from it, so that none is computed twice and its rows decide how it meets the edges."""
    scratch, levels, rows = Scratch(spark, "levels"), [], []
    for hop in range(1, depth + 1):
        levels.append(scratch.save(grow(by_size(levels[-1], rows[-1]), hop) if levels else level, "level"))
        rows.append(levels[-1].count())
    return _union(levels), sum(rows)


def _named(found: tuple[DataFrame, int], nodes: DataFrame) -> DataFrame:
    rows = by_size(*found)
    own = nodes.select(F.col("id").alias("node_id"), F.col("type").alias("node_type"), F.col("name").alias("node_name"))
    return rows.join(own, "node_id").select("hops", "edge_id", "edge_type", "node_id", "node_type", "node_name", F.array_join("path", " -> ").alias("via"))


def dependencies(nodes: DataFrame, edges: DataFrame, root: str, downstream: bool = False, depth: int = 1, from_package: str | None = None, to_package: str | None = None) -> DataFrame:
    """What root depends on (downstream) or what depends on it, one row per path and edge.

    All simple paths of at most depth edges over edges with both ends. Downstream a
    path never meets a node again. Upstream the guard of a path lags by one node, so
    a self-loop met at the second hop or later is taken once more, by definition. An unknown root gives an empty result.
    """
    live = live_edges(nodes, edges, from_package, to_package)
    near, far = ("source", "target") if downstream else ("target", "source")
    step = live.select("edge_id", "edge_type", F.col(near).alias("at"), F.col(far).alias("next"))
    first = step.filter(F.col("at") == root)
    guard = F.array("at", "next") if downstream else F.array("next", "at")
    level = first.select(F.lit(1).alias("hops"), "edge_id", "edge_type", F.col("next").alias("node_id"), F.array("at", "next").alias("path"), guard.alias("guard"))
    found = _grown(nodes.sparkSession, level, depth, lambda front, hop: front.select("node_id", "path", "guard")
        .join(step, F.col("node_id") == F.col("at")).filter(~F.array_contains("guard", F.col("next")))
        .select(F.lit(hop).alias("hops"), "edge_id", "edge_type", F.col("next").alias("node_id"), F.array_append("path", F.col("next")).alias("path"), F.array_append("guard", F.col("next") if downstream else F.col("at")).alias("guard")))
    return _named(found, nodes)


def callers(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 1, from_package: str | None = None, to_package: str | None = None) -> DataFrame:
    """Who calls, imports or depends on root, as dependencies upstream.

    The first level keeps functions and files only, deeper levels any node; no path
    meets a node again.
    """
    live = live_edges(nodes, edges.filter(F.col("edge_type").isin(CALLER_TYPES)), from_package, to_package)
    kinds = nodes.filter(F.col("type").isin("function", "file")).select(F.col("id").alias("source"))
    first = live.filter(F.col("target") == root).join(kinds, "source", "left_semi")
    level = first.select(F.lit(1).alias("hops"), "edge_id", "edge_type", F.col("source").alias("node_id"), F.array("target", "source").alias("path"))
    step = live.select("edge_id", "edge_type", "source", "target")
    found = _grown(nodes.sparkSession, level, depth, lambda front, hop: front.select("node_id", "path")
        .join(step, F.col("node_id") == F.col("target")).filter(~F.array_contains("path", F.col("source")))
        .select(F.lit(hop).alias("hops"), "edge_id", "edge_type", F.col("source").alias("node_id"), F.array_append("path", F.col("source")).alias("path")))
    return _named(found, nodes)


def shortest_path(edges: DataFrame, start: str, goal: str, most: int = 20) -> DataFrame:
    """The shortest path over all edge types: hops, path; empty if there is none.

    Of equally short paths the least array is taken. start = goal needs a self-loop.
    The search grows from both ends, always on the side with the smaller frontier,
    and keeps sets of nodes per level, no paths. From where the sides meet, each
    level is cut back to the nodes on shortest paths; the path is then read off, one
    least neighbour per step. A level's number of rows decides how it is joined.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "path")
    step = edges.select("source", "target")

    def saved(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        level = scratch.save(df, name)
        return level, level.count()

    def targets(level: tuple[DataFrame, int]) -> DataFrame:
        return by_size(level[0].withColumnRenamed("node", "target"), level[1])

    def answer(path: list[str] | None) -> DataFrame:
        return spark.createDataFrame([(len(path) - 1, path)] if path else [], "hops int, path array<string>")

    if start == goal:
        return answer(None if step.filter((F.col("source") == start) & (F.col("target") == start)).isEmpty() else [start, start])
    sides = [[(spark.createDataFrame([(n,)], "node string"), 1)] for n in (start, goal)]
    meeting = None
    while meeting is None:
        if len(sides[0]) + len(sides[1]) - 2 >= most:
            return answer(None)
        n = 0 if sides[0][-1][1] <= sides[1][-1][1] else 1
        near, far = ("source", "target") if n == 0 else ("target", "source")
        grown = by_size(*sides[n][-1]).join(step, F.col("node") == F.col(near)).select(F.col(far).alias("node")).filter("node is not null").distinct()
        seen = by_size(_union([df for df, _ in sides[n]]), sum(rows for _, rows in sides[n]))
        level = saved(grown.join(seen, "node", "left_anti"), "level")
        if not level[1]:
            return answer(None)
        sides[n].append(level)
        both = saved(level[0].join(by_size(*sides[1 - n][-1]), "node", "left_semi"), "both")
        if both[1]:
            meeting = both
    before, after = sides
    allowed = [meeting]  # the nodes on shortest paths, from the last level before the meeting back to the first
    for level, rows in before[-2:0:-1]:
        into = step.join(targets(allowed[0]), "target", "left_semi").select(F.col("source").alias("node"))
        allowed.insert(0, saved(into.join(by_size(level, rows), "node", "left_semi").distinct(), "allowed"))
    allowed = allowed if len(before) > 1 else []
    path = [start]
    for level in [*allowed, *after[-2::-1]]:
        path.append(step.filter(F.col("source") == path[-1]).join(targets(level), "target", "left_semi").agg(F.min("target")).first()[0])
    return answer(path)


def path_labels(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each step of a path as position and label ``type:name``; unknown ids keep their id.

    A path is short: its ids go to the nodes, and the few nodes found come back.
    """
    steps = path.select(F.posexplode("path").alias("pos", "node_id"))
    own = nodes.select(F.col("id").alias("node_id"), F.concat_ws(":", "type", "name").alias("label")).join(F.broadcast(steps.select("node_id")), "node_id", "left_semi")
    return steps.join(F.broadcast(own), "node_id", "left").select("pos", "node_id", F.coalesce("label", "node_id").alias("label"))


def neighbourhood(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """The one-hop edges of a node: way (out or in), edge_type, node_id, node_type, node_name, resolved.

    resolved is false if the other end's tags hold ``unresolved``. A self-loop is both.
    """
    own = nodes.select(F.col("id").alias("node_id"), F.col("type").alias("node_type"), F.col("name").alias("node_name"), "tags")
    out = edges.filter(F.col("source") == root).select(F.lit("out").alias("way"), "edge_id", "edge_type", F.col("target").alias("node_id"))
    into = edges.filter(F.col("target") == root).select(F.lit("in").alias("way"), "edge_id", "edge_type", F.col("source").alias("node_id"))
    tags = F.from_json("tags", "array<string>")
    return out.unionByName(into).join(own, "node_id").select("way", "edge_id", "edge_type", "node_id", "node_type", "node_name", (~F.coalesce(F.array_contains(tags, "unresolved"), F.lit(False))).alias("resolved"))


def affected_files(nodes: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """Files that changed paths reach against the traversed edges: changed_path, file_path, path.

    changed has a column path. Seeds are the nodes of a file and the file itself. All
    walks of at most depth edges count, also through a node twice; only file nodes
    come out, one row per distinct path.
    """
    files = changed.select(F.col("path").alias("changed_path")).filter("changed_path is not null").distinct()
    inside = nodes.select("id", "file_path").join(files, F.col("file_path") == F.col("changed_path")).select("changed_path", F.col("id").alias("node"))
    seeds = inside.unionByName(files.select("changed_path", F.concat(F.lit("file:"), "changed_path").alias("node"))).distinct()
    step = edges.filter(F.col("edge_type").isin(TRAVERSED)).select("source", "target").distinct()
    level, levels = seeds.select("changed_path", "node", F.array("node").alias("path")), []
    for _ in range(depth):
        level = level.join(step, F.col("node") == F.col("target")).select("changed_path", F.col("source").alias("node"), F.array_append("path", F.col("source")).alias("path"))
        levels.append(level)
    own = nodes.filter("type = 'file'").select(F.col("id").alias("node"), "file_path")
    return _union(levels).join(own, "node").select("changed_path", "file_path", "path").distinct()


def reached(edges: DataFrame, seeds: DataFrame, most: int = 6) -> DataFrame:
    """Nodes within most hops of the seeds over traversed edges in either direction: node, hops."""
    scratch = Scratch(edges.sparkSession, "reached")
    rows = edges.filter(F.col("edge_type").isin(TRAVERSED)).select("source", "target")
    step = scratch.save(rows.unionByName(rows.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "step")
    frontier = scratch.save(seeds.select("node").filter("node is not null").distinct(), "frontier")
    seen = frontier.select("node", F.lit(0).alias("hops"))
    for hop in range(1, most + 1):
        grown = frontier.join(step, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        frontier = scratch.save(grown.join(seen.select("node"), "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = scratch.save(seen.unionByName(frontier.select("node", F.lit(hop).alias("hops"))), "seen")
    return seen


def contained(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """The symbols of a file node by ``contains`` edges; without any, by its path: node, p1, p2, p3.

    p1, p2, p3 order them: by id, or by type, name and id.
    """
    held = edges.filter((F.col("edge_type") == "contains") & (F.col("source") == root)).select(F.col("target").alias("node")).distinct().select("node", F.col("node").alias("p1"), F.lit("").alias("p2"), F.lit("").alias("p3"))
    own = nodes.filter((F.col("id") == root) & (F.col("type") == "file")).select(F.col("file_path").alias("own_path"))
    if own.isEmpty():
        return held.limit(0)
    if not held.isEmpty():
        return held
    same = nodes.filter("type != 'file'").join(F.broadcast(own), F.col("file_path") == F.col("own_path"))
    return same.select(F.col("id").alias("node"), F.col("type").alias("p1"), F.coalesce("name", F.lit("")).alias("p2"), F.col("id").alias("p3"))


def impact_walk(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 3, edge_type: str | None = None, cap: int = 50, from_package: str | None = None, to_package: str | None = None) -> DataFrame:
    """Relationships around a root, nearest first, at most cap in all.

    Columns: pos, depth, direction (downstream along an edge, upstream against it),
    edge_id, edge_type, source, target, truncated boolean (the same in every row).
    Only edges with both ends count, and of those the given packages. The walk starts
    at the root and, for a file, all its symbols. Edges of a level are taken by the
    place of the frontier node, type, source, target and id; each (edge, direction)
    once; self-loops never. A neighbour is expanded once. The report is a top-k: per
    level at most cap + 1 rows reach the driver; the symbols stay distributed.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "impact")
    kinds = [edge_type] if edge_type else IMPACT_TYPES
    rows = live_edges(nodes, edges, from_package, to_package).filter(F.col("edge_type").isin(kinds) & (F.col("source") != F.col("target"))).select("edge_id", "edge_type", "source", "target")
    first = spark.createDataFrame([(root, 0, "", "", "")], "node string, p0 int, p1 string, p2 string, p3 string")
    symbols = contained(nodes, edges, root).filter(F.col("node") != root).select("node", F.lit(1).alias("p0"), "p1", "p2", "p3")
    seeds = scratch.save(first.unionByName(symbols), "seeds")
    frontier, visited, taken, found, truncated = seeds, set(), set(), [], False
    order = ["p0", "p1", "p2", "p3", "edge_type", "source", "target", "edge_id", "direction"]
    for level in range(1, depth + 1):
        if frontier is None or truncated:
            break
        along = rows.join(frontier, F.col("source") == F.col("node")).withColumn("direction", F.lit("downstream"))
        against = rows.join(frontier, F.col("target") == F.col("node")).withColumn("direction", F.lit("upstream"))
        fresh = along.unionByName(against)
        if taken:
            known = F.broadcast(spark.createDataFrame(sorted(taken), "edge_id long, direction string"))
            fresh = fresh.join(known, ["edge_id", "direction"], "left_anti")
        place = F.struct(*order[:4])
        best = fresh.groupBy("edge_id", "direction", "edge_type", "source", "target").agg(F.min(place).alias("p")).select("*", "p.*")
        candidates = best.orderBy(*order).limit(cap - len(found) + 1).collect()
        grown: list[str] = []
        for r in candidates:
            if len(found) >= cap:
                truncated = True
                break
            taken.add((r["edge_id"], r["direction"]))
            found.append((len(found), level, r["direction"], r["edge_id"], r["edge_type"], r["source"], r["target"]))
            other = r["target"] if r["direction"] == "downstream" else r["source"]
            if other not in visited:
                visited.add(other)
                grown.append(other)
        known_seeds = {r["node"] for r in seeds.filter(F.col("node").isin(grown)).select("node").collect()} if grown and level < depth else set()
        grown = [n for n in grown if n not in known_seeds]
        frontier = F.broadcast(spark.createDataFrame([(n, i, "", "", "") for i, n in enumerate(grown)], first.schema)) if grown else None
    out = [(*f, truncated) for f in found]
    return spark.createDataFrame(out, "pos int, depth int, direction string, edge_id long, edge_type string, source string, target string, truncated boolean")


def explore_relationships(nodes: DataFrame, edges: DataFrame, matches: DataFrame, fanout: int = 50) -> DataFrame:
    """Of each match (column id) at most fanout edges per direction, by type and name of the other end."""
    own = nodes.select(F.col("id").alias("other"), F.col("type").alias("other_type"), F.col("name").alias("other_name"))
    rows = edges.filter(F.col("edge_type").isin(TRAVERSED))
    out = rows.select(F.col("source").alias("id"), F.lit("out").alias("way"), "edge_id", "edge_type", F.col("target").alias("other"))
    into = rows.select(F.col("target").alias("id"), F.lit("in").alias("way"), "edge_id", "edge_type", F.col("source").alias("other"))
    met = out.unionByName(into).join(matches.select("id").distinct(), "id").join(own, "other")
    order = Window.partitionBy("id", "way").orderBy("other_type", "other_name", "edge_id")
    return met.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= fanout).select("id", "way", "nth", "edge_id", "edge_type", "other", "other_type", "other_name")
