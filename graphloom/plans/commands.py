"""What the commands do to a project and its store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import audit, explore, freshness, ingest, scan, search, stats, update
from graphloom.operators.graph import clean_edges, clean_nodes
from graphloom.operators.incremental import digest
from graphloom.sources import project
from graphloom.sources.store import SnapshotStore


def scan_project(spark: SparkSession, root: str, store: SnapshotStore, now_ms: int, keep_external: bool = False) -> dict[str, int]:
    """Reads a project into a new snapshot: how many nodes, edges and files it has.

    Edges are numbered in their canonical order. With keep_external, stored nodes
    without a file that the project does not bring are kept, as an update does.
    """
    texts, configs = project.load_project(spark, root), project.discover_configs(spark, root)
    nodes, edges = scan.scan(texts, configs)
    if keep_external:
        nodes = update.restore_external(nodes, store.read("nodes"))
    numbered = ingest.canonical_order(edges.withColumn("metadata", F.coalesce("metadata", F.lit(""))))
    rows = numbered.select(F.col("edge_number").alias("id"), "source", "target", F.col("edge_type").alias("type"), F.lit("forward").alias("direction"), F.lit(1.0).alias("weight"), F.nullif("metadata", F.lit("")).alias("metadata"))
    files = project.file_records(spark, root, nodes, now_ms)
    meta = update.merge_meta(store.read("meta"), {"graph": json.dumps({"lastIndexedAt": now_ms, "root": root})})
    store.write(nodes=nodes, edges=rows, files=files, meta=meta)
    return {t: store.read(t).count() for t in ("nodes", "edges", "files")}


def update_project(spark: SparkSession, root: str, store: SnapshotStore, now_ms: int) -> dict[str, int]:
    """Scans again if files changed: what changed, and the nodes and edges of it before and after."""
    stored = store.read("files").select("path", digest(F.col("content_hash")).alias("digest"), "size", "modified_at")
    current = project.file_records(spark, root, store.read("nodes"), now_ms).select("path", digest(F.col("content_hash")).alias("digest"), "size", "modified_at")
    stale = freshness.stale_files(stored, current).select("path")
    changed = stale.unionByName(current.select("path").join(stored.select("path"), "path", "left_anti"))
    paths = [r["path"] for r in changed.limit(10_001).collect()]  # named for the report only
    if not paths:
        return {"changed": 0}
    told = spark.createDataFrame([(x,) for x in paths], "path string") if len(paths) <= 10_000 else changed

    def counted() -> tuple[int, int]:
        r = update.update_counters(clean_nodes(store.read("nodes")), clean_edges(store.read("edges")), told).first()
        return r["nodes"], r["edges"]

    before = counted()
    scan_project(spark, root, store, now_ms, keep_external=True)
    after = counted()
    return {"changed": told.count(), "nodes_before": before[0], "edges_before": before[1], "nodes_after": after[0], "edges_after": after[1]}


def init_store(store: SnapshotStore) -> bool:
    """An empty snapshot in a new store; an existing one stays as it is."""
    if store.current() is not None:
        return False
    store.write()
    return True


def stats_sections(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The summary of a graph: totals, counts by type with bars, packages, tags, top lists."""
    by_node = stats.by_type(nodes, "type")
    return {
        "totals": stats.totals(nodes, edges),
        "nodes by type": stats.bars(by_node).orderBy(F.desc("n"), "type"),
        "edges by type": stats.bars(stats.by_type(edges, "edge_type")).orderBy(F.desc("n"), "type"),
        "packages": stats.packages(nodes).orderBy(F.desc("n"), "package"),
        "most imported": stats.top_imported(nodes, edges),
        "largest files": stats.largest_files(nodes),
        "tags": stats.tag_distribution(nodes),
    }


def audit_store(store: SnapshotStore, root: str | None, docs: bool, include_internal: bool = False) -> DataFrame:
    """All checks of a store against the project's texts, which lie where they were scanned."""
    spark = store.spark
    nodes, edges = clean_nodes(store.read("nodes")), clean_edges(store.read("edges"))
    where = root or json.loads(store.read("meta").filter("key = 'graph'").first()["value"])["root"]
    texts = project.load_project(spark, where)
    documented = audit.documentation_issues(nodes, scan.declared_parameters(texts, nodes), include_internal) if docs else None
    return audit.audit_report(nodes, edges, texts, scan.stale_symbols(nodes, texts), documented).orderBy("check", "id", "detail")


def explore_store(store: SnapshotStore, nodes: DataFrame, edges: DataFrame, keyword: str, node_type: str | None, root: str | None) -> DataFrame:
    """The explore report of a store, with code and freshness from the project it was scanned from."""
    spark = store.spark
    known = store.read("meta").filter("key = 'graph'").first()
    where = root or (json.loads(known["value"]).get("root") if known else None)
    found = search.search(nodes, keyword, node_type).select(F.monotonically_increasing_id().alias("pos"), "id")  # a top list, in its order
    matches = spark.createDataFrame([(n, r["id"]) for n, r in enumerate(found.collect())], "pos int, id string")
    texts = project.load_project(spark, where) if where else spark.createDataFrame([], "path string, text string")
    spelled = lambda df: df.select("path", digest(F.col("content_hash")).alias("digest"), "size", "modified_at")
    stored = spelled(store.read("files"))
    stale = freshness.stale_files(stored, spelled(project.file_records(spark, where, store.read("nodes"), 0))) if where else stored.select("path", F.lit("unknown").alias("reason"))
    order = F.array_position(F.array(*map(F.lit, ["match", "relationship", "snippet", "stale"])), F.col("section"))
    return explore.explore_report(nodes, edges, matches, texts, stale).orderBy(order, "id", "way", "pos")
