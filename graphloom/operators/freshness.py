"""Which indexed files have changed since they were indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.incremental import digest


def newest(rows: DataFrame, *rank: str) -> DataFrame:
    """The row of each path with the greatest rank: path, digest, size, modified_at."""
    keep = F.struct(*rank, digest(F.col("content_hash")).alias("digest"), "size", "modified_at")
    return rows.filter("path is not null").groupBy("path").agg(F.max(keep).alias("r")).select("path", "r.digest", "r.size", "r.modified_at")


def stale_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored files that differ from what is there now: path, reason.

    Both have path, digest, size, modified_at. deleted: not there; unknown: there but
    unreadable (null digest); modified: another time, size or digest.
    """
    now = current.select("path", F.col("digest").alias("d"), F.col("size").alias("s"), F.col("modified_at").alias("m"), F.lit(True).alias("there"))
    rows = stored.join(now, "path", "left")
    same = F.col("digest").eqNullSafe(F.col("d")) & F.col("size").eqNullSafe(F.col("s")) & F.col("modified_at").eqNullSafe(F.col("m"))
    reason = F.when(F.col("there").isNull(), "deleted").when(F.col("d").isNull(), "unknown").when(~same, "modified")
    return rows.select("path", reason.alias("reason")).filter("reason is not null")


def file_status(stored: DataFrame, current: DataFrame, path: str) -> DataFrame:
    """One row: path and status current, stale (changed) or missing (no stored row, gone or unreadable)."""
    one = stored.sparkSession.createDataFrame([(path,)], "path string")
    known = one.join(stored.filter(F.col("path") == path).select("path", F.lit(1).alias("known")), "path", "left")
    stale = stale_files(stored.filter(F.col("path") == path), current.filter(F.col("path") == path))
    return known.join(stale, "path", "left").select("path", F.when(F.col("known").isNull() | F.col("reason").isin("deleted", "unknown"), "missing").when(F.col("reason").isNotNull(), "stale").otherwise("current").alias("status"))


def freshness(stored: DataFrame, current: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: stale (files of any reason), missing (deleted ones), checked_at (last indexed, or 0)."""
    rows = stale_files(stored, current).agg(F.count("*").alias("stale"), F.count_if(F.col("reason") == "deleted").alias("missing"))
    at = meta.agg(F.max(F.when(F.col("key") == "graph", F.get_json_object("value", "$.lastIndexedAt").try_cast("bigint"))).alias("at"))
    return rows.crossJoin(F.broadcast(at)).select("stale", "missing", F.coalesce("at", F.lit(0)).alias("checked_at"))
