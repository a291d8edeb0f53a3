"""References to records that do not exist, at the time they were written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.keys import key128

FIRST, LAST = -(2**31), 2**31 - 1


def compress_runs(keys: DataFrame, group: list[str], key: str, end: str | None = None) -> DataFrame:
    """Sorted integer keys compressed into contiguous runs: group, run_start, run_end.

    A row stands for one key, or for all keys from ``key`` to ``end``. Repeated and
    overlapping keys count once, null keys give nothing. Rows of one group are
    ordered in one partition; give a group of bounded size, or a bucket of the key.
    """
    last = F.col(end or key)
    each = keys.filter(F.col(key).isNotNull()).select(*group, F.col(key).alias("first_key"), last.alias("last_key"))
    order = Window.partitionBy(*group).orderBy("first_key", "last_key")
    reach = F.max("last_key").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = each.withColumn("opens", F.when(reach.isNull() | (F.col("first_key") > reach + 1), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*group, "island").agg(F.min("first_key").alias("run_start"), F.max("last_key").alias("run_end")).drop("island")


def asof_match(references: DataFrame, runs: DataFrame, group: str, key: str, *carry: str) -> DataFrame:
    """Each reference with the runs around its key: group, key, carry, reach, ahead.

    As-of match: reach is the end of the run with the greatest start not above the
    key, ahead the start of the next run; null if there is none. The key exists
    exactly if it is not beyond reach. Both sides are merged by one sort per group.
    """
    rest = [F.col(c) for c in carry]
    wanted = references.select(group, F.col(key).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("run_end"), *rest)
    nothing = [F.lit(None).cast(references.schema[c].dataType).alias(c) for c in carry]
    known = runs.select(group, F.col("run_start").alias("at"), F.lit(0).alias("kind"), F.col("run_end").cast("bigint").alias("run_end"), *nothing)
    order = Window.partitionBy(group).orderBy("at", "kind")
    merged = known.unionByName(wanted).select(
        group,
        F.col("at").alias(key),
        "kind",
        *carry,
        F.last("run_end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("reach"),
        F.first(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("ahead"),
    )
    return merged.filter("kind = 1").drop("kind")


def asof_orphans(references: DataFrame, runs: DataFrame, group: str, key: str) -> DataFrame:
    """Distinct (group, key) of references outside every run, with the reason.

    Beyond the end of the preceding run a key is ``deleted``; without such a run it
    is ``late`` if the group has later runs, else ``missing``.
    """
    matched = asof_match(references.select(group, key).distinct(), runs, group, key)
    reason = F.when(F.col("reach").isNull(), F.when(F.col("ahead").isNull(), "missing").otherwise("late")).when(F.col(key) > F.col("reach"), "deleted")
    return matched.select(group, key, reason.alias("reason")).filter("reason is not null")


def existence_runs(nodes: DataFrame, library_nodes: DataFrame, node_changes: DataFrame) -> DataFrame:
    """For each parent id the scan runs at which it exists, as contiguous runs.

    Columns k (key of the id), run_start, run_end. A node exists from an ``add``
    until a later ``delete``, before its first change only if that is a ``delete``,
    and always without changes; library nodes always exist.
    """
    changes = node_changes.select("node_id", "run_id", "op").filter("node_id is not null and run_id is not null and op in ('add', 'delete')").distinct()
    order = Window.partitionBy("node_id").orderBy("run_id")
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    until = F.min(F.when(F.col("op") == "delete", F.col("run_id"))).over(ahead)
    marked = changes.select("node_id", "run_id", "op", (until - 1).alias("until"), F.row_number().over(order).alias("nth"))
    spans = marked.filter("op = 'add' or nth = 1").select(
        "node_id",
        F.when(F.col("op") == "add", F.col("run_id")).otherwise(F.lit(FIRST)).alias("run_start"),
        F.when(F.col("op") == "add", F.coalesce("until", F.lit(LAST))).otherwise(F.col("run_id") - 1).alias("run_end"),
    )
    ids = nodes.select(key128("id").alias("k")).filter("k is not null").distinct()
    spans = spans.select(key128("node_id").alias("sk"), "run_start", "run_end")
    own = ids.join(spans, F.col("k") == F.col("sk"), "left").select("k", F.coalesce("run_start", F.lit(FIRST)).alias("run_start"), F.coalesce("run_end", F.lit(LAST)).alias("run_end"))
    shared = library_nodes.filter("id is not null").select(key128("id").alias("k"), F.lit(FIRST).alias("run_start"), F.lit(LAST).alias("run_end"))
    return own.unionByName(shared).groupBy("k", "run_start").agg(F.max("run_end").alias("run_end"))


def edge_run(metadata: Column, latest: Column) -> Column:
    """The scan run in an edge's metadata, a number or numeric string; else latest."""
    run = F.regexp_extract(F.trim(F.get_json_object(metadata, "$.run")), r"^(\d{1,9})(?:\.0*)?$", 1)
    return F.coalesce(run.try_cast("int"), latest)


def edge_references(edges: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """One row per edge row and end: edge_id, side, k, run; placeholders left out."""
    latest = scan_runs.agg(F.max("run_id").alias("latest_run"))
    ends = F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("ref")), F.struct(F.lit("target").alias("side"), F.col("target").alias("ref"))))
    rows = edges.select("id", "source", "target", "metadata").filter("id is not null").crossJoin(F.broadcast(latest))
    rows = rows.select(F.col("id").alias("edge_id"), edge_run(F.col("metadata"), F.col("latest_run")).alias("run"), ends.alias("e"))
    rows = rows.filter("e.ref is not null and not contains(e.ref, ':*:') and not startswith(e.ref, 'unresolved-call:')")
    return rows.select("edge_id", F.col("e.side").alias("side"), key128("e.ref").alias("k"), F.coalesce("run", F.lit(LAST)).alias("run"))


def parent_keys(references: DataFrame, existence: DataFrame, buckets: int) -> DataFrame:
    """References and parents under integer keys: bucket, k, run, first_key, last_key, parent.

    The ids of both sides form one sorted dictionary per bucket of their hash. A key
    is the place of the id in it, times 2**32, plus the run; a parent holds the keys
    of all runs at which it exists, so parents that always exist and stand next to
    each other in the dictionary have contiguous keys.
    """
    held = existence.select("k", F.lit(None).cast("int").alias("run"), F.col("run_start").alias("lo"), F.col("run_end").alias("hi"), F.lit(True).alias("parent"))
    named = references.select("k", "run").distinct().select("k", "run", F.col("run").alias("lo"), F.col("run").alias("hi"), F.lit(False).alias("parent"))
    rows = held.unionByName(named).withColumn("bucket", F.pmod(F.col("k.a"), F.lit(buckets)).cast("int"))
    place = F.dense_rank().over(Window.partitionBy("bucket").orderBy("k")).cast("bigint")
    base = place * F.lit(2**32) - F.lit(FIRST)
    return rows.select("bucket", "k", "run", (base + F.col("lo")).alias("first_key"), (base + F.col("hi")).alias("last_key"), "parent")


def orphan_references(edges: DataFrame, nodes: DataFrame, library_nodes: DataFrame, node_changes: DataFrame, scan_runs: DataFrame, buckets: int = 4096, salt: int = 16) -> DataFrame:
    """References of edges to nodes that do not exist: edge_id, side, run, reason.

    reason is ``missing`` (in no table), ``deleted`` (gone by the edge's run) or
    ``late`` (added only in a later run). Null ends are no references, an edge
    without a readable run takes the latest of scan_runs, repeated rows give one
    row, empty tables give an empty result (or, if only the nodes are empty, every
    reference as missing). Further columns are ignored.

    The integer keys of all parents are compressed into contiguous runs, and each
    distinct reference meets the run before it: a key beyond that run's end does not
    exist. Whether the id existed before or exists later shows in the runs around
    its own block of keys. References are made distinct before, so a key that holds
    a third of them is a handful of rows; the join back to the edges is spread over
    ``salt`` parts of every key. Buckets are ordered in one task each: give more of
    them where a bucket of ids would not fit. The only broadcast is the one-row latest run.
    """
    references = edge_references(edges, scan_runs)
    keyed = parent_keys(references, existence_runs(nodes, library_nodes, node_changes), buckets)
    runs = compress_runs(keyed.filter("parent"), ["bucket"], "first_key", "last_key")
    matched = asof_match(keyed.filter("not parent").select("bucket", "first_key", "k", "run"), runs, "bucket", "first_key", "k", "run")
    block = F.col("first_key") - F.col("run") + F.lit(FIRST)
    beyond = F.col("reach").isNull() | (F.col("first_key") > F.col("reach"))
    reason = F.when(F.col("reach") >= block, "deleted").when(F.col("ahead") < block + F.lit(2**32), "late").otherwise("missing")
    bad = matched.filter(beyond).select("k", "run", reason.alias("reason"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("part"))
    spread = references.withColumn("part", F.pmod(F.xxhash64("edge_id"), F.lit(salt)).cast("int"))
    return spread.join(bad, ["k", "run", "part"]).select("edge_id", "side", "run", "reason").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per end, run and reason: side, run, reason, n_refs."""
    return orphans.groupBy("side", "run", "reason").agg(F.count("*").alias("n_refs"))
