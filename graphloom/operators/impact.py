"""The report of what a change to one node touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import IMPACT_TEST, impact_flags
from graphloom.operators.traverse import contained, impact_walk, reached


def met_nodes(walk: DataFrame, nodes: DataFrame) -> DataFrame:
    """The far ends of a walk's relationships, each once: id, type, name, file_path."""
    far = walk.select(F.when(F.col("direction") == "downstream", F.col("target")).otherwise(F.col("source")).alias("id")).distinct()
    return nodes.select("id", "type", "name", "file_path").join(F.broadcast(far), "id")


def bucket_counts(met: DataFrame) -> DataFrame:
    """One row: how many of the nodes are fields, schemas, hooks, routes and components."""
    flags = impact_flags(F.col("type"), F.col("name"), F.col("file_path"))
    return met.agg(*[F.count_if(F.coalesce(f, F.lit(False))).alias(k) for k, f in flags.items()])


def impact_tests(nodes: DataFrame, edges: DataFrame, root: str, most: int = 6) -> DataFrame:
    """The test files within most hops of the root and, for a file, of its symbols: file_path."""
    start = nodes.filter(F.col("id") == root).select(F.col("id").alias("node"))
    near = reached(edges, start.unionByName(contained(nodes, edges, root).select("node")), most)
    tests = nodes.filter(F.col("type") == "file").filter(F.col("file_path").rlike(IMPACT_TEST))
    return tests.join(near, F.col("id") == F.col("node"), "left_semi").select("file_path").distinct()


def impact_report(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 3, edge_type: str | None = None, cap: int = 50, from_package: str | None = None, to_package: str | None = None) -> DataFrame:
    """The impact of a root in one result: section, pos, depth, direction, edge_type, source, target, value.

    Sections, in this order by pos: upstream and downstream (the relationships of the
    walk, by depth, edge type, source and target; value is the far end's name), fields,
    schemas, hooks, routes and components among the nodes met (as type:name and path), param_flow
    (its distinct ends) and tests (files within six hops). A walk cut at ``cap`` has a
    row ``truncated``. All but the tests are bounded by the cap.
    """
    walk = impact_walk(nodes, edges, root, depth, edge_type, cap, from_package, to_package).withColumn("id", F.when(F.col("direction") == "downstream", F.col("target")).otherwise(F.col("source")))
    met = met_nodes(walk, nodes)
    blank = lambda kind: F.lit(None).cast(kind)

    def plain(df: DataFrame, section: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), blank("int").alias("depth"), blank("string").alias("direction"), blank("string").alias("edge_type"), blank("string").alias("source"), blank("string").alias("target"), "value")

    links = walk.join(met.select("id", F.col("name").alias("value")), "id")
    parts = [links.select(F.col("direction").alias("section"), "depth", "direction", "edge_type", "source", "target", "value")]
    flags = impact_flags(F.col("type"), F.col("name"), F.col("file_path"))
    for name, flag in flags.items():
        parts.append(plain(met.filter(flag).select(F.concat("type", F.lit(":"), "name", F.lit("  "), "file_path").alias("value")).distinct(), name))
    flow = walk.filter("edge_type = 'param_flow'").select("source", "target").distinct()
    parts.append(flow.select(F.lit("param_flow").alias("section"), blank("int").alias("depth"), blank("string").alias("direction"), F.lit("param_flow").alias("edge_type"), "source", "target", blank("string").alias("value")))
    parts.append(plain(walk.filter("truncated").select(F.lit("true").alias("value")).distinct(), "truncated"))
    parts.append(plain(impact_tests(nodes, edges, root).select(F.col("file_path").alias("value")), "tests"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = ["upstream", "downstream", *flags, "param_flow", "truncated", "tests"]
    place = F.array_position(F.array(*map(F.lit, order)), F.col("section")).cast("int")
    return rows.withColumn("pos", place).orderBy("pos", "depth", "edge_type", "source", "target", "value").select("section", "pos", "depth", "direction", "edge_type", "source", "target", "value")
