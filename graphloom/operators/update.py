"""Replacing a stored graph, and what an update reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and file rows that stay when the files of paths (column path) are deleted.

    Edges go with either end. Semi- and anti-joins on ids, never a collected list.
    """
    gone = nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("k")).distinct()
    left = edges.join(gone, F.col("source") == F.col("k"), "left_anti").join(gone, F.col("target") == F.col("k"), "left_anti")
    return nodes.join(gone, F.col("id") == F.col("k"), "left_anti"), left, files.join(paths.select("path"), "path", "left_anti")


def update_counters(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: nodes and edges of the given files; an edge counts once per file it touches."""
    own = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path").select("id", "file_path")
    a = edges.join(own, F.col("source") == F.col("id")).select("edge_id", "file_path")
    b = edges.join(own, F.col("target") == F.col("id")).select("edge_id", "file_path")
    n = own.agg(F.count("*").alias("nodes"))
    return n.crossJoin(F.broadcast(a.unionByName(b).distinct().agg(F.count("*").alias("edges"))))


def restore_external(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """A new snapshot's nodes plus the stored ones without a file that it lacks."""
    old = stored.filter("file_path = ''").join(fresh.select("id"), "id", "left_anti")
    return fresh.unionByName(old, allowMissingColumns=True)


def merge_meta(meta: DataFrame, changes: dict[str, str | None]) -> DataFrame:
    """Key-value rows with the given keys replaced or added."""
    new = meta.sparkSession.createDataFrame(sorted(changes.items()), "key string, value string")
    return meta.join(new.select("key"), "key", "left_anti").unionByName(new)
