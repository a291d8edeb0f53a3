"""Counts and top lists over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, files."""
    a = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "file").alias("files"))
    return a.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges")))).select("nodes", "edges", "files")


def by_type(rows: DataFrame, column: str) -> DataFrame:
    """Rows per type."""
    return rows.groupBy(F.col(column).alias("type")).agg(F.count("*").alias("n"))


def top_imported(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """The targets of most imports: id, name, type, n. Counted before the join, so a hot target is one row."""
    counted = edges.filter("edge_type = 'imports'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    return counted.join(nodes.select("id", "name", "type"), "id").orderBy(F.desc("n"), "id").limit(most)


def largest_files(nodes: DataFrame, most: int = 10) -> DataFrame:
    """The files of most symbols: file_path, n; the empty path of placeholders counts as one."""
    return nodes.filter("type != 'file'").groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(most)


def packages(nodes: DataFrame, root: str = "") -> DataFrame:
    """Nodes per package: the package id, else the first directory below root, else ``root``."""
    below = F.regexp_replace("file_path", "^" + root.rstrip("/") + "/", "") if root else F.col("file_path")
    first = F.element_at(F.filter(F.split(below, "/"), lambda x: ~x.isin("", ".")), 1)
    parts = F.size(F.filter(F.split(below, "/"), lambda x: ~x.isin("", ".")))
    return nodes.groupBy(F.coalesce("package_id", F.when(parts > 1, first), F.lit("root")).alias("package")).agg(F.count("*").alias("n"))


def tag_distribution(nodes: DataFrame, most: int = 20) -> DataFrame:
    """The most frequent tags: tag, n. Unreadable tags give none."""
    tags = nodes.select(F.explode(F.from_json("tags", "array<string>")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def file_counts(nodes: DataFrame, pattern: str | None = None) -> DataFrame:
    """Per file node its functions, classes, interfaces and other symbols, zero-filled.

    pattern is a part of the path without regard to ASCII case.
    """
    kinds = ["function", "class", "interface", "type_alias"]
    counted = nodes.filter("type != 'file'").groupBy("file_path").agg(*[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n_symbols"))
    files = nodes.filter("type = 'file'").select("file_path").distinct()
    if pattern is not None:
        from graphloom.operators.graph import fold

        files = files.filter(fold(F.col("file_path")).contains(fold(F.lit(pattern))))
    rows = files.join(counted, "file_path", "left")
    return rows.select("file_path", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds], F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def bars(counts: DataFrame, width: int = 40) -> DataFrame:
    """type, n and a bar whose length is n scaled to the greatest."""
    top = counts.agg(F.max("n").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select("type", "n", F.expr(f"repeat('#', cast(round(n / top * {width}) as int))").alias("bar"))
