"""The report of affected files: grouped, filtered and ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import file_group, filter_glob, group_ordinal
from graphloom.operators.traverse import affected_files


def report(nodes: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 3, tests_only: bool = False, pattern: str | None = None) -> DataFrame:
    """file_path, file_group, paths (array of arrays), by group and path.

    Changed files without a node are echoed with no paths and pass any filter. The
    pattern is matched against the whole path; only * is special in it.
    """
    rows = affected_files(nodes, edges, changed, depth).groupBy("file_path").agg(F.collect_set("path").alias("paths"))
    rows = rows.select("file_path", file_group(F.col("file_path")).alias("file_group"), F.array_sort("paths").alias("paths"))
    if pattern:
        rows = rows.filter(F.col("file_path").rlike(filter_glob(pattern)))
    unknown = changed.select(F.col("path").alias("file_path")).distinct().join(nodes.select("file_path"), "file_path", "left_anti")
    echoed = unknown.select("file_path", file_group(F.col("file_path")).alias("file_group"), F.array().cast("array<array<string>>").alias("paths"))
    rows = rows.unionByName(echoed)
    if tests_only:
        rows = rows.filter("file_group = 'tests'")
    return rows.orderBy(group_ordinal(F.col("file_group")), F.collate("file_path", "UNICODE"))
