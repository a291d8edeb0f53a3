"""The clean property graph behind all graph operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_COLUMNS = ["id", "type", "name", "file_path", "line_start", "line_end", "summary", "documentation", "tags", "complexity", "package_id"]

#: Edge types that traversals follow.
TRAVERSED = ["imports", "calls", "references", "renders", "queries", "mutates", "param_flow", "uses_hook", "tested_by"]
IMPACT_TYPES = [*TRAVERSED, "has_field", "contains"]
CALLER_TYPES = ["calls", "imports", "depends_on"]


def clean_nodes(nodes: DataFrame, *more: DataFrame) -> DataFrame:
    """One row per id, of nodes and further node tables; absent columns are null.

    Rows with a null id are left out. Of rows with the same id the first table wins,
    then the greatest row.
    """
    parts = []
    for n, df in enumerate((nodes, *more)):
        have = set(df.columns)
        cols = [F.col(c) if c in have else F.lit(None).cast("int" if c.startswith("line_") else "string").alias(c) for c in NODE_COLUMNS]
        parts.append(df.filter("id is not null").select(*cols, F.lit(-n).alias("rank")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = rows.groupBy("id").agg(F.max(F.struct("rank", *[c for c in NODE_COLUMNS if c != "id"])).alias("r"))
    return best.select("id", *[F.col(f"r.{c}").alias(c) for c in NODE_COLUMNS if c != "id"])


def clean_edges(edges: DataFrame) -> DataFrame:
    """One row per edge id with both ends, in the stored direction."""
    cols = ["source", "target", "type", "direction", "weight", "metadata"]
    rows = edges.filter("id is not null and source is not null and target is not null")
    return rows.groupBy("id").agg(F.max(F.struct(*cols)).alias("r")).select(F.col("id").alias("edge_id"), *[F.col(f"r.{c}").alias("edge_type" if c == "type" else c) for c in cols])


def fold(text: Column) -> Column:
    """Lower case of ASCII letters only, as SQLite compares names."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def live_edges(nodes: DataFrame, edges: DataFrame, from_package: str | None = None, to_package: str | None = None) -> DataFrame:
    """Edges whose two ends exist, with optional package conditions on both.

    Stored edges know their ends; of others they are looked up by equi-joins on ids,
    in which a hot end is split by the handling of skew. A null package never equals
    a wanted one.
    """
    if "live" in edges.columns:
        rows = edges.filter("live")
    else:
        a = nodes.select(F.col("id").alias("source"), F.col("package_id").alias("from_package"))
        b = nodes.select(F.col("id").alias("target"), F.col("package_id").alias("to_package"))
        rows = edges.join(a, "source").join(b, "target")
    if from_package is not None:
        rows = rows.filter(F.col("from_package") == from_package)
    if to_package is not None:
        rows = rows.filter(F.col("to_package") == to_package)
    return rows.select("edge_id", "source", "target", "edge_type")
