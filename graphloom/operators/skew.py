"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.workspace import Scratch


def target_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Result per (type, target) of edges joined with nodes on target = id.

    Columns: type, target, n_edges (rows of edges, repeated ones included),
    n_joined (rows that the plain join would give), sum_weight (over the edge rows,
    nulls skipped; null if all are), n_nodes (rows of nodes with that id, 0 if none).
    Null types and targets are keys of their own; a null target joins nothing.
    Empty edges give an empty result, empty nodes give n_nodes = 0.

    Eager aggregation through the join: both inputs are aggregated by the join key
    first, before any row is shuffled, so a key with a third of all rows leaves each
    map task as one state; the compact states are joined, counts multiplied, and
    rolled up by type and target.
    """
    left = edges.select("type", "target", "weight").groupBy("type", "target").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("sum_weight"))
    right = nodes.select(F.col("id").alias("node_id")).filter("node_id is not null").groupBy("node_id").agg(F.count("*").alias("n_nodes"))
    joined = left.join(right, F.col("target") == F.col("node_id"), "left").withColumn("n_nodes", F.coalesce("n_nodes", F.lit(0)))
    return joined.select("type", "target", "n_edges", (F.col("n_edges") * F.col("n_nodes")).alias("n_joined"), "sum_weight", "n_nodes")


def type_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """target_statistics rolled up by type: type, n_targets, n_edges, n_joined, top_target_edges."""
    return (
        target_statistics(edges, nodes)
        .groupBy("type")
        .agg(F.count("target").alias("n_targets"), F.sum("n_edges").alias("n_edges"), F.sum("n_joined").alias("n_joined"), F.max("n_edges").alias("top_target_edges"))
    )


def hot_targets(edges: DataFrame, nodes: DataFrame, share: float = 0.01) -> DataFrame:
    """(type, target) pairs that hold at least that share of all rows of edges.

    Columns: type, target, n_edges, n_joined. The joined states of target_statistics
    are written once; the total is rolled up from them, so edges are read a single
    time, and that one row is the only thing broadcast. Pairs with a null type or
    target are reported as such; empty edges give an empty result.
    """
    scratch = Scratch(edges.sparkSession, "skew")
    states = scratch.save(target_statistics(edges, nodes).select("type", "target", "n_edges", "n_joined"), "states")
    total = states.agg(F.sum("n_edges").alias("total"))
    return states.crossJoin(F.broadcast(total)).filter(F.col("n_edges") >= F.col("total") * F.lit(share)).select("type", "target", "n_edges", "n_joined")
