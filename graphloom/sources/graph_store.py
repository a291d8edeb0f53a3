"""The clean graph of a dataset, stored once and read by every graph operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.workspace import Scratch, by_size

_STORES: dict[tuple, tuple] = {}


class GraphStore:
    """Nodes, one row per id, and edges, one row per edge id with what is known of their ends.

    Cleaning, the check of both ends and the ends' packages cost full shuffles of the
    raw tables; here they are paid once. What is stored is plain columns, so that a
    query reads those it names and nothing is aggregated or joined again: edges have
    ``live`` (both ends exist), ``from_package`` and ``to_package``; edges that come with
    these columns are not joined. Edges are sorted by target within their files, so that
    looking up a hot node reads few row groups.
    """

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> None:
        self._scratch = Scratch(spark, "graph")
        self.nodes = self._scratch.save(nodes, "nodes")
        if "live" not in edges.columns:
            edges = self._known(edges)
        self.edges = self._scratch.save(edges.sortWithinPartitions("target"), "edges")

    def _known(self, edges: DataFrame) -> DataFrame:
        ends = by_size(self.nodes.select("id", "package_id"), self.nodes.count())
        a = ends.select(F.col("id").alias("source"), F.lit(True).alias("a"), F.col("package_id").alias("from_package"))
        b = ends.select(F.col("id").alias("target"), F.lit(True).alias("b"), F.col("package_id").alias("to_package"))
        known = edges.join(a, "source", "left").join(b, "target", "left")
        return known.select(*edges.columns, (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("live"), "from_package", "to_package")


def _state(spark: SparkSession, paths: list[str]) -> tuple:
    """Length and time of the files behind the paths, so that new data gives a new store."""
    found = []
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in status or []]
    return tuple(found)


def stored_once(spark: SparkSession, name: str, paths: list[str], build: Callable[[], object]) -> object:
    """What build makes of some tables, made again only when they are new to this session."""
    key, state = (spark.sparkContext.applicationId, name, *paths), _state(spark, paths)
    if key not in _STORES or _STORES[key][0] != state:
        _STORES[key] = (state, build())
    return _STORES[key][1]


def graph_store(spark: SparkSession, name: str, paths: list[str], build: Callable[[], tuple[DataFrame, DataFrame]]) -> GraphStore:
    """The store of a graph, built from its tables when they are new to this session."""
    return stored_once(spark, name, paths, lambda: GraphStore(spark, *build()))
