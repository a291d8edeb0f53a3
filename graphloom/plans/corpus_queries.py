"""Queries of the general (not text-related) corpus operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import hierarchy, incremental, references, skew
from graphloom.sources.tables import table


def p2_found(spark, d):
    links = hierarchy.graph_links(table(spark, d, "edges"))
    return hierarchy.resolve_hierarchy(links).select("type", "node_id", "root_id", "depth")


def p2_paths(spark, d):
    links = hierarchy.graph_links(table(spark, d, "edges"))
    rows = hierarchy.resolve_hierarchy(links, with_paths=True)
    return rows.select("type", "node_id", "depth", F.array_join("path", " / ").alias("full_path"))


def p2_descendants(spark, d):
    links = hierarchy.graph_links(table(spark, d, "edges"))
    return hierarchy.descendants(hierarchy.resolve_hierarchy(links, with_paths=True))


def _orphans(spark, d):
    return references.orphan_references(*(table(spark, d, t) for t in ("edges", "nodes", "library_nodes", "node_changes", "scan_runs")))


def p3_found(spark, d):
    return _orphans(spark, d).select("edge_id", "side", "reason")


def p3_report(spark, d):
    return references.orphan_report(_orphans(spark, d))


def p5_found(spark, d):
    return incremental.replay_changes(table(spark, d, "files"), table(spark, d, "file_observations"), table(spark, d, "scan_runs"))


def p6_found(spark, d):
    return skew.hot_targets(table(spark, d, "edges"), table(spark, d, "nodes")).select("type", "target")


def p6_per_target(spark, d):
    rows = skew.target_statistics(table(spark, d, "edges"), table(spark, d, "nodes"))
    return rows.select("type", "target", "n_edges", "n_joined", F.round("sum_weight", 4).alias("sum_weight"), "n_nodes")


def p6_per_type(spark, d):
    return skew.type_statistics(table(spark, d, "edges"), table(spark, d, "nodes"))


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p3_found, p3_report, p5_found, p6_found, p6_per_target, p6_per_type)}

_LINKS = """
links AS (
  SELECT type, child, min(parent) AS parent FROM (
    SELECT type,
      CASE WHEN (type = 'contains') <> (coalesce(direction, 'forward') = 'backward') THEN target ELSE source END AS child,
      CASE WHEN (type = 'contains') <> (coalesce(direction, 'forward') = 'backward') THEN source ELSE target END AS parent
    FROM edges WHERE type IN ('contains', 'extends')) l
  WHERE child IS NOT NULL AND parent IS NOT NULL GROUP BY type, child),
up AS (
  SELECT type, child AS node_id, parent AS cur, 1 AS steps, [child] AS seen FROM links
  UNION ALL
  SELECT u.type, u.node_id, l.parent, u.steps + 1, list_append(u.seen, u.cur)
  FROM up u JOIN links l ON l.type = u.type AND l.child = u.cur WHERE NOT list_contains(u.seen, u.cur)),
ends AS (
  SELECT u.*, list_contains(u.seen, u.cur) AS looped FROM up u
  WHERE list_contains(u.seen, u.cur) OR NOT EXISTS (SELECT 1 FROM links l WHERE l.type = u.type AND l.child = u.cur))
"""

_ORPHANS = """
latest AS (SELECT max(run_id) AS r FROM scan_runs),
refs AS (
  SELECT id AS edge_id, side, CASE side WHEN 'source' THEN source ELSE target END AS ref,
    coalesce(try_cast(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.run') END AS INTEGER), (SELECT r FROM latest)) AS run
  FROM edges, (VALUES ('source'), ('target')) s(side)),
wanted AS (SELECT DISTINCT * FROM refs WHERE ref IS NOT NULL AND ref NOT LIKE '%:*:%' AND ref NOT LIKE 'unresolved-call:%'
  AND ref NOT IN (SELECT id FROM library_nodes)),
firsts AS (SELECT node_id, min(run_id) AS first_run, arg_min(op, run_id) AS first_op FROM node_changes GROUP BY node_id),
lasts AS (SELECT w.ref, w.run, arg_max(c.op, c.run_id) AS last_op FROM (SELECT DISTINCT ref, run FROM wanted) w
  JOIN node_changes c ON c.node_id = w.ref AND c.run_id <= w.run GROUP BY w.ref, w.run),
judged AS (SELECT DISTINCT w.edge_id, w.side, w.run,
  CASE WHEN w.ref NOT IN (SELECT id FROM nodes) THEN 'missing' WHEN l.last_op = 'delete' THEN 'deleted'
       WHEN l.last_op IS NULL AND f.first_op = 'add' AND f.first_run > w.run THEN 'late' END AS reason
  FROM wanted w LEFT JOIN lasts l ON l.ref = w.ref AND l.run = w.run LEFT JOIN firsts f ON f.node_id = w.ref),
orphans AS (SELECT * FROM judged WHERE reason IS NOT NULL)
"""

_PER_TARGET = """
per_target AS (
  SELECT e.type, e.target, e.n_edges, e.n_edges * coalesce(n.n, 0) AS n_joined, e.sum_weight, coalesce(n.n, 0) AS n_nodes
  FROM (SELECT type, target, count(*) AS n_edges, sum(weight) AS sum_weight FROM edges GROUP BY type, target) e
  LEFT JOIN (SELECT id, count(*) AS n FROM nodes GROUP BY id) n ON n.id = e.target)
"""

ORACLES = {
    "p2_found": f"""WITH RECURSIVE {_LINKS}
SELECT type, node_id, CASE WHEN looped THEN list_min(seen[list_position(seen, cur):]) ELSE cur END AS root_id,
  CAST(CASE WHEN looped THEN -1 ELSE steps END AS INTEGER) AS depth FROM ends""",
    "p2_paths": f"""WITH RECURSIVE {_LINKS}
SELECT type, node_id, CAST(CASE WHEN looped THEN -1 ELSE steps END AS INTEGER) AS depth,
  array_to_string(CASE WHEN looped THEN list_reverse(seen[1:list_position(seen, cur)]) ELSE list_prepend(cur, list_reverse(seen)) END, ' / ') AS full_path FROM ends""",
    "p2_descendants": f"""WITH RECURSIVE {_LINKS}
SELECT type, cur AS ancestor_id, node_id, CAST(steps AS INTEGER) AS distance FROM up WHERE NOT list_contains(seen, cur)""",
    "p3_found": f"WITH {_ORPHANS} SELECT edge_id, side, reason FROM orphans",
    "p3_report": f"WITH {_ORPHANS} SELECT side, run, reason, count(*) AS n_refs FROM orphans GROUP BY ALL",
    "p5_found": """
WITH records AS (
  SELECT path, 0 AS run_id, -1 AS obs_id, lower(right(trim(content_hash), 64)) AS digest, indexed_at FROM files WHERE content_hash IS NOT NULL AND path IS NOT NULL AND indexed_at IS NOT NULL
  UNION ALL
  SELECT path, run_id, obs_id, lower(right(trim(content_hash), 64)), indexed_at FROM file_observations WHERE content_hash IS NOT NULL AND path IS NOT NULL AND indexed_at IS NOT NULL),
ok AS (SELECT run_id, coalesce(lag(run_id) OVER (ORDER BY run_id), 0) AS before FROM scan_runs WHERE status = 'success'),
at_run AS (SELECT o.run_id, r.path, arg_max(r.digest, {'t': r.indexed_at, 'r': r.run_id, 'o': r.obs_id}) AS digest
  FROM ok o JOIN records r ON r.run_id <= o.run_id GROUP BY ALL),
before AS (SELECT o.run_id, r.path, arg_max(r.digest, {'t': r.indexed_at, 'r': r.run_id, 'o': r.obs_id}) AS digest
  FROM ok o JOIN records r ON r.run_id <= o.before GROUP BY ALL)
SELECT CAST(a.run_id AS INTEGER) AS run_id, a.path FROM at_run a LEFT JOIN before b ON b.run_id = a.run_id AND b.path = a.path WHERE b.digest IS NULL OR b.digest <> a.digest""",
    "p6_found": f"WITH {_PER_TARGET} SELECT type, target FROM per_target WHERE n_edges >= 0.01 * (SELECT count(*) FROM edges)",
    "p6_per_target": f"WITH {_PER_TARGET} SELECT type, target, n_edges, n_joined, round(sum_weight, 4) AS sum_weight, n_nodes FROM per_target",
    "p6_per_type": f"""WITH {_PER_TARGET} SELECT type, count(target) AS n_targets, CAST(sum(n_edges) AS BIGINT) AS n_edges,
  CAST(sum(n_joined) AS BIGINT) AS n_joined, max(n_edges) AS top_target_edges FROM per_target GROUP BY type""",
}
