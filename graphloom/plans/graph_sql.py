"""The graph queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from graphloom.plans.star import STAR_SQL

_HOT = "function:/srv/checkouts/_platform/runtime/src/store.ts:useShelf"
_TYPE = "interface:/srv/checkouts/_platform/runtime/src/types.ts:Envelope"
_LOG = "function:/srv/checkouts/_platform/runtime/src/log.ts:emitTrace"
_INDEX = "file:/srv/checkouts/_platform/runtime/src/index.ts"
_REGION = "region:/w/region:2"
_TRAVERSED = "('imports','calls','references','renders','queries','mutates','param_flow','uses_hook','tested_by')"
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_GRAPH = """
gn AS (SELECT id, any_value(type) AS type, any_value(name) AS name, any_value(file_path) AS file_path, any_value(summary) AS summary,
         any_value(documentation) AS documentation, any_value(tags) AS tags, any_value(complexity) AS complexity, any_value(package_id) AS package_id
       FROM (SELECT id, type, name, file_path, summary, documentation, tags, complexity, package_id FROM nodes
             UNION ALL SELECT id, type, name, file_path, NULL, NULL, NULL, NULL, package_id FROM library_nodes WHERE id NOT IN (SELECT id FROM nodes)) u
       WHERE id IS NOT NULL GROUP BY id),
ge AS (SELECT id AS edge_id, any_value(source) AS source, any_value(target) AS target, any_value(type) AS edge_type, any_value(direction) AS direction,
         any_value(weight) AS weight, any_value(metadata) AS metadata FROM edges WHERE id IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL GROUP BY id)
"""


def _deps(graph: str, root: str, down: bool, depth: int, package: str | None = None) -> str:
    near, far = ("source", "target") if down else ("target", "source")
    first_guard = f"[{near}, {far}]" if down else f"[{far}, {near}]"
    grown = f"e.{far}" if down else f"e.{near}"
    wanted = f"AND b.package_id = '{package}'" if package else ""
    start = f"'{root}'" if root else "(SELECT source FROM ge GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"
    return f"""WITH RECURSIVE {graph},
live AS (SELECT e.* FROM ge e JOIN gn a ON a.id = e.source JOIN gn b ON b.id = e.target WHERE true {wanted}),
walk AS (
  SELECT 1 AS hops, edge_id, edge_type, {far} AS node_id, [{near}, {far}] AS path, {first_guard} AS guard FROM live WHERE {near} = {start}
  UNION ALL
  SELECT w.hops + 1, e.edge_id, e.edge_type, e.{far}, list_append(w.path, e.{far}), list_append(w.guard, {grown})
  FROM walk w JOIN live e ON e.{near} = w.node_id WHERE w.hops < {depth} AND NOT list_contains(w.guard, e.{far}))
SELECT CAST(hops AS INTEGER) AS hops, edge_id, edge_type, node_id, n.type AS node_type, n.name AS node_name, array_to_string(path, ' -> ') AS via
FROM walk w JOIN gn n ON n.id = w.node_id"""


def _callers(depth: int) -> str:
    return f"""WITH RECURSIVE {_GRAPH},
live AS (SELECT e.*, a.type AS source_type FROM ge e JOIN gn a ON a.id = e.source JOIN gn b ON b.id = e.target WHERE edge_type IN ('calls', 'imports', 'depends_on')),
walk AS (
  SELECT 1 AS hops, edge_id, edge_type, source AS node_id, [target, source] AS path FROM live WHERE target = '{_LOG}' AND source_type IN ('function', 'file')
  UNION ALL
  SELECT w.hops + 1, e.edge_id, e.edge_type, e.source, list_append(w.path, e.source) FROM walk w JOIN live e ON e.target = w.node_id
  WHERE w.hops < {depth} AND NOT list_contains(w.path, e.source))
SELECT CAST(hops AS INTEGER) AS hops, edge_id, edge_type, node_id, n.type AS node_type, n.name AS node_name, array_to_string(path, ' -> ') AS via
FROM walk w JOIN gn n ON n.id = w.node_id"""


def _route(start: str, goal: str, most: int) -> str:
    return f"""WITH RECURSIVE {STAR_SQL}, step AS (SELECT DISTINCT source, target FROM ge),
reach AS (SELECT '{start}' AS node, 0 AS hops UNION SELECT s.target, r.hops + 1 FROM reach r JOIN step s ON s.source = r.node WHERE r.hops < {most}),
need AS (SELECT min(hops) AS n FROM reach WHERE node = '{goal}' AND hops > 0),
walk AS (SELECT '{start}' AS node, 0 AS hops, ['{start}'] AS path
  UNION ALL SELECT s.target, w.hops + 1, list_append(w.path, s.target) FROM walk w JOIN step s ON s.source = w.node
  WHERE w.hops < (SELECT n FROM need) AND NOT list_contains(w.path, s.target)),
best AS (SELECT hops, min(path) AS path FROM walk WHERE node = '{goal}' AND hops = (SELECT n FROM need) GROUP BY hops)"""


_AFFECTED = f"""
changed AS (SELECT DISTINCT path AS changed_path FROM file_observations WHERE run_id = (SELECT max(run_id) FROM file_observations) AND path IS NOT NULL),
step AS (SELECT DISTINCT source, target FROM ge WHERE edge_type IN {_TRAVERSED}),
walk AS (
  SELECT * FROM (SELECT changed_path, n.id AS node, 0 AS hops, [n.id] AS path FROM changed c JOIN gn n ON n.file_path = c.changed_path
    UNION SELECT changed_path, 'file:' || changed_path, 0, ['file:' || changed_path] FROM changed) s
  UNION ALL
  SELECT w.changed_path, s.source, w.hops + 1, list_append(w.path, s.source) FROM walk w JOIN step s ON s.target = w.node WHERE w.hops < 3),
affected AS (SELECT DISTINCT changed_path, n.file_path, w.path FROM walk w JOIN gn n ON n.id = w.node WHERE n.type = 'file' AND hops > 0)
"""
_GROUP = r"""CASE WHEN regexp_matches({0}, '(?:^|/)(?:__tests__|e2e|playwright)/|\.(?:test|spec)\.[cm]?[jt]sx?$') THEN 'tests'
 WHEN regexp_matches({0}, '/app/.*/(?:page|layout|route|loading|error|not-found)\.[jt]sx?$|/pages/.*\.[jt]sx?$|/api/.*\.(?:ts|tsx|js|jsx)$') THEN 'routes'
 WHEN regexp_matches({0}, '/components?/.*\.[jt]sx?$') THEN 'components'
 WHEN regexp_matches({0}, '/db/|/models?/|/repositories?/|/queries\.[jt]sx?$') THEN 'dataAccess' ELSE 'other' END"""

_DIGEST = "lower(right(trim(content_hash), 64))"
_NEWEST = """
stored AS (SELECT path, {d} AS digest, size, modified_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, {d} DESC NULLS LAST, size DESC NULLS LAST, modified_at DESC NULLS LAST) AS nth FROM files WHERE path IS NOT NULL) f WHERE nth = 1),
now AS (SELECT path, {d} AS digest, size, modified_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, obs_id DESC NULLS LAST, {d} DESC NULLS LAST, size DESC NULLS LAST, modified_at DESC NULLS LAST) AS nth FROM file_observations WHERE path IS NOT NULL) f WHERE nth = 1),
stale AS (SELECT s.path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN n.digest IS NULL THEN 'unknown'
  WHEN s.digest IS DISTINCT FROM n.digest OR s.size IS DISTINCT FROM n.size OR s.modified_at IS DISTINCT FROM n.modified_at THEN 'modified' END AS reason
  FROM stored s LEFT JOIN now n ON n.path = s.path)
""".format(d=_DIGEST)

_FTS = r"""
cells AS (SELECT id, c, regexp_extract_all(lower(v), '[\p{L}\p{N}]+') AS t FROM (
  SELECT id, unnest(['id', 'name', 'file_path', 'summary', 'documentation', 'tags']) AS c, unnest([id, name, file_path, coalesce(summary, ''), coalesce(documentation, ''), coalesce(tags, '')]) AS v FROM gn) x),
counted AS (SELECT id, CAST(sum(len(t)) AS BIGINT) AS len, CAST(sum(len(list_filter(range(1, len(t)), lambda i: t[i] = 'src' AND starts_with(t[i + 1], 'index')))) AS BIGINT) AS f FROM cells GROUP BY id),
corpus AS (SELECT count(*) AS a, avg(len) AS l, count(*) FILTER (WHERE f > 0) AS w FROM counted),
scored AS (SELECT n.id, n.type, n.name, n.file_path, n.summary,
  round(greatest(ln((a - w + 0.5) / (w + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * c.len / l)), 9) AS score FROM counted c JOIN gn n USING (id), corpus WHERE f > 0),
best AS (SELECT *, CASE WHEN lower(name) = 'src index' THEN 0 WHEN contains(lower(file_path), 'src index') THEN 1 WHEN contains(lower(coalesce(summary, '')), 'src index') THEN 2 ELSE 3 END AS bucket
  FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 50) s)
"""

_LIKE = " OR ".join(f"coalesce({_FOLD.format(c)} LIKE '%{{0}}%', false)" for c in ("name", "summary", "tags", "documentation"))

_CALLS = """
fn AS (SELECT id, name, file_path FROM gn WHERE type = 'function'),
calls AS (SELECT e.edge_id AS call_id, f.name AS owner_name, f.file_path, CASE WHEN e.edge_id % 3 = 0 THEN 'this.' ELSE '' END || regexp_extract(e.target, '([^:]*)$', 1) AS expression
  FROM ge e JOIN fn f ON f.id = e.source WHERE e.edge_type = 'calls'),
lookups AS (SELECT file_path AS lf, ln, min(id) AS lt FROM (SELECT file_path, id, unnest(list_distinct([regexp_replace(name, '@[0-9]+$', ''), name])) AS ln
  FROM gn WHERE type IN ('function', 'class', 'interface', 'type_alias')) x GROUP BY ALL),
pairs AS (SELECT s.file_path, e.edge_id AS declaration, t.file_path AS target_file FROM ge e JOIN gn s ON s.id = e.source AND s.type = 'file' JOIN gn t ON t.id = e.target AND t.type = 'file' WHERE e.edge_type = 'imports'),
bindings AS (SELECT p.file_path, declaration, target_file, regexp_extract(f.name, '([^.]*)$', 1) AS local_name, f.name AS imported_name FROM pairs p JOIN fn f ON f.file_path = p.target_file),
asked AS (SELECT *, string_split(expression, '.') AS parts FROM calls),
named AS (SELECT *, parts[-1] AS called, CASE WHEN len(parts) > 1 THEN parts[-2] END AS qualifier FROM asked),
chosen AS (SELECT n.call_id, arg_min(b.imported_name, {'d': declaration, 't': b.target_file, 'i': b.imported_name}) AS imported_name, arg_min(b.target_file, {'d': declaration, 't': b.target_file, 'i': b.imported_name}) AS target_file
  FROM named n JOIN bindings b ON b.file_path = n.file_path AND b.local_name = coalesce(n.qualifier, n.called) GROUP BY n.call_id),
solved AS (SELECT n.call_id, n.file_path, a.lt AS t1, b.lt AS t2, c.lt AS t3, i.lt AS ti FROM named n
  LEFT JOIN lookups a ON a.lf = n.file_path AND a.ln = n.called AND (n.qualifier IS NULL OR n.qualifier = 'this')
  LEFT JOIN lookups b ON b.lf = n.file_path AND b.ln = n.qualifier || '.' || n.called
  LEFT JOIN lookups c ON c.lf = n.file_path AND n.qualifier = 'this' AND c.ln = CASE WHEN contains(n.owner_name, '.') THEN split_part(n.owner_name, '.', 1) || '.' || n.called ELSE n.called END
  LEFT JOIN chosen h ON h.call_id = n.call_id LEFT JOIN lookups i ON i.lf = h.target_file AND i.ln = h.imported_name)
"""

_OWNER = """
paths AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL),
configs AS (SELECT DISTINCT regexp_extract(path, '^(/srv/checkouts/[^/]+/packages/[^/]+)/', 1) AS dir FROM paths),
owner AS (SELECT p.path, max_by(c.dir, length(c.dir)) AS config_dir FROM paths p LEFT JOIN configs c ON c.dir <> '' AND starts_with(p.path, c.dir || '/') GROUP BY p.path)
"""

_SPECIFIERS = r"""
paths AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL),
specs AS (SELECT DISTINCT importer, specifier FROM (SELECT path AS importer, unnest(regexp_extract_all(text, 'from ["''](\.[^"'']*)["'']', 1)) AS specifier FROM sources WHERE text IS NOT NULL) s),
stems AS (SELECT importer, specifier, regexp_replace(importer, '/[^/]*$', '') || substr(specifier, 2) AS stem FROM specs WHERE starts_with(specifier, './')),
tries AS (SELECT s.importer, s.specifier, t.nth, s.stem || t.suffix AS candidate FROM stems s,
  (SELECT unnest(range(9)) AS nth, unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) AS suffix) t),
resolved AS (SELECT s.importer, s.specifier, arg_min(p.path, t.nth) AS target_path FROM specs s LEFT JOIN tries t ON t.importer = s.importer AND t.specifier = s.specifier LEFT JOIN paths p ON p.path = t.candidate GROUP BY ALL)
"""

_KINDS = ["function", "class", "interface", "type_alias"]
_COUNTS = ", ".join(f"count(*) FILTER (WHERE n.type = '{k}') AS n_{k}" for k in _KINDS)
_FILES = f"""files_seen AS (SELECT DISTINCT file_path FROM gn WHERE type = 'file'),
per_file AS (SELECT f.file_path, {_COUNTS}, count(n.id) AS n_symbols FROM files_seen f LEFT JOIN gn n ON n.file_path = f.file_path AND n.type <> 'file' GROUP BY f.file_path)"""


def _named(text: str) -> str:
    return f"WITH RECURSIVE {_GRAPH}, {text}"


def _level(root: str) -> str:
    """The first level of an impact walk from a node that is no file, cut at 50."""
    return f"""around AS (SELECT e.* FROM ge e JOIN gn a ON a.id = e.source JOIN gn b ON b.id = e.target
  WHERE e.edge_type IN {_TRAVERSED.replace("'tested_by'", "'tested_by','has_field','contains'")} AND e.source <> e.target AND (e.source = '{root}' OR e.target = '{root}')),
level AS (SELECT CAST(row_number() OVER w - 1 AS INTEGER) AS pos, 1 AS depth, CASE WHEN source = '{root}' THEN 'downstream' ELSE 'upstream' END AS direction, edge_id, edge_type, source, target,
  (SELECT count(*) FROM around) > 50 AS truncated FROM around WINDOW w AS (ORDER BY edge_type, source, target, edge_id) QUALIFY row_number() OVER w <= 50)"""


_PREFIXES = "('file','func','function','class','module','concept','config','document','service','table','endpoint','pipeline','schema','resource','domain','flow','step','article','entity','topic','claim','source')"
_ALTERNATIVES = _PREFIXES[2:-2].replace("','", "|")
_LEGACY_IDS = f"""
raw AS (SELECT DISTINCT type, name, file_path, CASE type WHEN 'function' THEN regexp_replace(id, '^function:', 'func:') WHEN 'file' THEN 'file:' || id WHEN 'field' THEN name ELSE id END AS old_id FROM (SELECT DISTINCT id, type, name, file_path FROM nodes) n),
single AS (SELECT *, coalesce(split_part(old_id, ':', 1) IN {_PREFIXES} AND starts_with(old_id, split_part(old_id, ':', 1) || ':' || split_part(old_id, ':', 1) || ':'), false) AS doubled FROM raw),
cut AS (SELECT *, CASE WHEN doubled THEN substring(old_id, length(split_part(old_id, ':', 1)) + 2) ELSE old_id END AS o FROM single),
own AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(o, '^[^:]+:(?:{_ALTERNATIVES}):.') AND NOT regexp_matches(o, '^(?:{_ALTERNATIVES}):') THEN regexp_replace(o, '^[^:]+:', '') ELSE o END, '^func:', 'function:') AS p FROM cut),
named AS (SELECT *, CASE WHEN type = 'func' THEN 'function' WHEN type IN {_PREFIXES} THEN type ELSE 'file' END AS kind FROM own),
fixed AS (SELECT old_id, doubled, CASE WHEN regexp_matches(p, '^(?:{_ALTERNATIVES}):') THEN p WHEN type IN ('function', 'class') THEN concat_ws(':', kind, CASE WHEN coalesce(file_path, '') <> '' THEN file_path ELSE '__nofilepath__' END, coalesce(name, p)) ELSE concat_ws(':', kind, p) END AS new_id FROM named),
judged AS (SELECT old_id, new_id, CASE WHEN old_id = new_id THEN 'unchanged' WHEN doubled THEN 'double_prefix' WHEN starts_with(old_id, 'func:') THEN 'renamed_prefix' ELSE 'added_prefix' END AS fix FROM fixed)
"""

ORACLES = {
    "search_stored": f"""WITH {_GRAPH}, words AS (SELECT unnest(list_concat({", ".join(f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')" for c in ("id", "name", "file_path", "summary", "documentation", "tags"))})) AS token FROM gn)
SELECT count(DISTINCT token) AS n_tokens, count(*) AS n_postings, (SELECT count(*) FROM gn) AS n_nodes FROM words""",
    "legacy_ids": f"WITH {_LEGACY_IDS} SELECT old_id, new_id, fix FROM judged",
    "legacy_fix_counts": f"WITH {_LEGACY_IDS} SELECT fix, count(*) AS n FROM judged GROUP BY fix",
    "documentation_audit": f"""WITH {_GRAPH},
own AS (SELECT id, CASE WHEN json_valid(documentation) THEN CAST(documentation AS JSON) END AS doc FROM gn WHERE type IN ('function', 'class', 'interface', 'type_alias') AND file_path <> ''
  AND json_valid(tags) AND json_type(CAST(tags AS JSON)) = 'ARRAY' AND (json_contains(tags, '"exported"') OR json_contains(tags, '"public"'))),
told AS (SELECT *, coalesce(json_extract_string(doc, '$.version') = '1' AND json_extract_string(doc, '$.hasJsDoc') = 'true', false) AS ok FROM own),
tags AS (SELECT id, unnest(from_json(json_extract(doc, '$.tags'), '["JSON"]')) AS tag, generate_subscripts(from_json(json_extract(doc, '$.tags'), '["JSON"]'), 1) AS nth FROM told WHERE ok),
each AS (SELECT id, nth, json_extract_string(tag, '$.name') AS name, concat_ws(':', json_extract_string(tag, '$.name'), coalesce(json_extract_string(tag, '$.subject'), json_extract_string(tag, '$.text'), '')) AS ident FROM tags)
SELECT id, 'missing_jsdoc' AS issue, CAST(NULL AS VARCHAR) AS subject FROM told WHERE NOT ok
UNION ALL SELECT id, 'missing_description', NULL FROM told WHERE ok AND coalesce(json_extract_string(doc, '$.description'), '') = ''
UNION ALL SELECT id, 'duplicate_tag', name FROM (SELECT *, row_number() OVER (PARTITION BY id, ident ORDER BY nth) AS again FROM each) r WHERE again > 1
UNION ALL SELECT id, 'extra_tag', name FROM each WHERE name NOT IN ('param', 'arg', 'argument', 'returns', 'return', 'deprecated', 'throws', 'example', 'see', 'remarks', 'since', 'template', 'typeParam', 'public', 'private', 'protected')""",
    "graph_stored": " UNION ALL ".join(
        f"SELECT * FROM (WITH {g} SELECT '{name}' AS graph, (SELECT count(*) FROM gn) AS n_nodes, count(*) AS n_edges, count(*) FILTER (WHERE source IN (SELECT id FROM gn) AND target IN (SELECT id FROM gn)) AS n_live FROM ge) t"
        for name, g in (("graph", _GRAPH), ("star", STAR_SQL))
    ),
    "deps_up_d3": _deps(STAR_SQL, _REGION, False, 3),
    "deps_down_d3": _deps(STAR_SQL, "order:/w/orders:1", True, 3),
    "deps_up_d1": _deps(_GRAPH, _TYPE, False, 1),
    "deps_down_d1": _deps(_GRAPH, "", True, 1),
    "deps_down_d2": _deps(_GRAPH, "", True, 2),
    "deps_up_d2": _deps(_GRAPH, _TYPE, False, 2),
    "deps_pkg": _deps(_GRAPH, _HOT, False, 2, "runtime"),
    "callers_d1": _callers(1),
    "callers_d2": _callers(2),
    "path_shortest": f"{_route('order:/w/orders:1', 'nation:/w/nation:3', 6)} SELECT CAST(hops AS INTEGER) AS hops, array_to_string(path, ' -> ') AS route FROM best",
    "path_labels": f"""{_route('order:/w/orders:2', 'region:/w/region:1', 6)}, steps AS (SELECT unnest(range(len(path))) AS pos, unnest(path) AS id FROM best)
SELECT CAST(pos AS INTEGER) AS pos, coalesce(n.type || ':' || n.name, s.id) AS label FROM steps s LEFT JOIN gn n ON n.id = s.id""",
    "inspect": f"""{_named('''met AS (SELECT 'out' AS way, edge_id, edge_type, target AS node_id FROM ge WHERE source = '@' UNION ALL SELECT 'in', edge_id, edge_type, source FROM ge WHERE target = '@')'''.replace('@', _TYPE))}
SELECT way, edge_id, edge_type, node_id, n.type AS node_type, n.name AS node_name, NOT coalesce(list_contains(CAST(CASE WHEN json_valid(n.tags) THEN n.tags END AS VARCHAR[]), 'unresolved'), false) AS resolved FROM met JOIN gn n ON n.id = node_id""",
    "resolve_exact": f"WITH {_GRAPH} SELECT id, type, name, 1 AS tier, CASE WHEN count(*) OVER () > 1 THEN 'ambiguous' ELSE 'single' END AS verdict FROM gn WHERE {_FOLD.format('name')} = 'useshelf'",
    "resolve_partial": f"WITH {_GRAPH} SELECT id, type, name, 2 AS tier, CASE WHEN count(*) OVER () > 1 THEN 'ambiguous' ELSE 'single' END AS verdict FROM gn WHERE contains({_FOLD.format('name')}, 'seshel')",
    "resolve_type_name": f"WITH {_GRAPH} SELECT id, type, name, 1 AS tier FROM gn WHERE type = 'interface' AND name = 'Envelope'",
    "stats_totals": f"WITH {_GRAPH} SELECT (SELECT count(*) FROM gn) AS nodes, (SELECT count(*) FROM ge) AS edges, (SELECT count(*) FROM gn WHERE type = 'file') AS files",
    "stats_nodes_by_type": f"WITH {_GRAPH} SELECT type, count(*) AS n FROM gn GROUP BY type",
    "stats_edges_by_type": f"WITH {_GRAPH} SELECT edge_type AS type, count(*) AS n FROM ge GROUP BY edge_type",
    "stats_bars": f"WITH {_GRAPH}, c AS (SELECT type, count(*) AS n FROM gn GROUP BY type) SELECT type, n, repeat('#', CAST(round(n / (SELECT max(n) FROM c) * 40) AS INTEGER)) AS bar FROM c",
    "stats_top_imported": f"WITH {_GRAPH} SELECT n.id, n.name, n.type, count(*) AS n FROM ge e JOIN gn n ON n.id = e.target WHERE e.edge_type = 'imports' GROUP BY ALL ORDER BY count(*) DESC, n.id LIMIT 10",
    "stats_largest_files": f"WITH {_GRAPH} SELECT file_path, count(*) AS n FROM gn WHERE type <> 'file' GROUP BY file_path ORDER BY n DESC, file_path LIMIT 10",
    "stats_packages": f"WITH {_GRAPH} SELECT coalesce(package_id, split_part(substr(file_path, length('/srv/checkouts/') + 1), '/', 1)) AS package, count(*) AS n FROM gn GROUP BY 1",
    "tag_distribution": f"WITH {_GRAPH} SELECT tag, count(*) AS n FROM (SELECT unnest(CAST(CASE WHEN json_valid(tags) THEN tags END AS VARCHAR[])) AS tag FROM gn) t GROUP BY tag ORDER BY n DESC, tag LIMIT 20",
    "files_counts": f"{_named(_FILES)} SELECT * FROM per_file",
    "files_pattern": f"{_named(_FILES)} SELECT * FROM per_file WHERE contains({_FOLD.format('file_path')}, 'tests/')",
    "search_like": f"WITH {_GRAPH} SELECT id, type, name, file_path FROM gn WHERE {_LIKE.format('ledger')} ORDER BY type, name, id LIMIT 20",
    "search_fts": f"{_named(_FTS)} SELECT id, type, name, CAST(bucket AS INTEGER) AS bucket, score FROM best ORDER BY bucket, score DESC, id LIMIT 20",
    "search_dispatch": f"WITH {_GRAPH} SELECT id, type, name FROM gn WHERE type = 'function' AND ({_LIKE.format('edger')}) ORDER BY type, name, id LIMIT 20",
    "explore_fanout": f"""WITH {_GRAPH}, matches AS (SELECT id FROM gn WHERE {_LIKE.format('useshelf')} ORDER BY type, name, id LIMIT 20),
met AS (SELECT source AS id, 'out' AS way, edge_id, edge_type, target AS other FROM ge WHERE edge_type IN {_TRAVERSED} UNION ALL SELECT target, 'in', edge_id, edge_type, source FROM ge WHERE edge_type IN {_TRAVERSED})
SELECT * FROM (SELECT m.id, m.way, CAST(row_number() OVER (PARTITION BY m.id, m.way ORDER BY n.type, n.name, m.edge_id) AS INTEGER) AS nth, m.edge_id, m.edge_type, m.other, n.type AS other_type, n.name AS other_name
  FROM met m JOIN matches x ON x.id = m.id JOIN gn n ON n.id = m.other) r WHERE nth <= 50""",
    "affected_files": f"{_named(_AFFECTED)} SELECT changed_path, file_path, array_to_string(path, ' <- ') AS route FROM affected",
    "affected_groups": f"""{_named(_AFFECTED)}, g AS (SELECT file_path, count(DISTINCT path) AS n_paths, {_GROUP.format('file_path')} AS file_group FROM affected GROUP BY file_path)
SELECT file_path, file_group, CAST(list_position(['tests', 'routes', 'components', 'dataAccess', 'other'], file_group) - 1 AS INTEGER) AS ordinal, n_paths FROM g""",
    "affected_tests": f"{_named(_AFFECTED)}, g AS (SELECT file_path, count(DISTINCT path) AS n_paths, {_GROUP.format('file_path')} AS file_group FROM affected GROUP BY file_path) SELECT file_path, n_paths FROM g WHERE file_group = 'tests'",
    "impact_level": f"WITH {_GRAPH}, {_level(_TYPE)} SELECT * FROM level",
    "impact_buckets": rf"""WITH {_GRAPH}, {_level(_HOT)},
met AS (SELECT * FROM gn WHERE id IN (SELECT CASE direction WHEN 'downstream' THEN target ELSE source END FROM level))
SELECT count(*) FILTER (WHERE type = 'field') AS fields, count(*) FILTER (WHERE type = 'schema') AS schemas, count(*) FILTER (WHERE type = 'function' AND regexp_matches(name, 'use[A-Z]')) AS hooks,
  count(*) FILTER (WHERE regexp_matches(file_path, '/app/.*/(?:page|layout|route)\.[jt]sx?$|/pages/.*\.[jt]sx?$|/api/.*\.(?:ts|tsx|js|jsx)$')) AS routes,
  count(*) FILTER (WHERE regexp_matches(file_path, '/components?/.*\.[jt]sx?$')) AS components FROM met""",
    "impact_tests": rf"""WITH RECURSIVE {_GRAPH}, step AS (SELECT source, target FROM ge WHERE edge_type IN {_TRAVERSED} UNION SELECT target, source FROM ge WHERE edge_type IN {_TRAVERSED}),
held AS (SELECT target AS node FROM ge WHERE edge_type = 'contains' AND source = '{_INDEX}'),
reach AS (SELECT node, 0 AS hops FROM (SELECT '{_INDEX}' AS node UNION SELECT node FROM held UNION SELECT id FROM gn WHERE 'file:' || file_path = '{_INDEX}' AND id <> '{_INDEX}' AND NOT EXISTS (SELECT 1 FROM held)) s
  UNION SELECT s.target, r.hops + 1 FROM reach r JOIN step s ON s.source = r.node WHERE r.hops < 6)
SELECT DISTINCT file_path FROM gn WHERE type = 'file' AND id IN (SELECT node FROM reach) AND regexp_matches(file_path, '\.(?:test|spec)\.tsx?|__tests__/|e2e/|playwright/')""",
    "orphan_edges": rf"""WITH {_GRAPH}, m AS (SELECT e.*, a.id IS NULL AS ns, b.id IS NULL AS nt FROM ge e LEFT JOIN gn a ON a.id = e.source LEFT JOIN gn b ON b.id = e.target)
SELECT edge_id, edge_type, CASE WHEN ns AND nt THEN 'both' WHEN ns THEN 'source' ELSE 'target' END AS missing FROM m WHERE (ns OR nt) AND NOT (nt AND (contains(target, ':*:') OR starts_with(target, 'unresolved-call:')
  OR regexp_matches(target, '^file:.*/node_modules/') OR coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.resolution') END IN ('external', 'unresolved'), false)))""",
    "duplicate_nodes": f"""WITH {_GRAPH} SELECT type, scope, name, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (
  SELECT type, CASE WHEN type = 'param' THEN regexp_replace(id, ':[^:]*$', '') ELSE file_path END AS scope, regexp_replace(name, '@[0-9]+$', '') AS name, id FROM gn WHERE file_path <> '') x GROUP BY ALL HAVING count(*) > 1""",
    "missing_files": f"WITH {_GRAPH} SELECT id, file_path FROM gn WHERE type = 'file' AND file_path NOT IN (SELECT path FROM sources WHERE path IS NOT NULL)",
    "stale_files": f"WITH {_NEWEST} SELECT path, reason FROM stale WHERE reason IS NOT NULL",
    "freshness_block": f"WITH {_NEWEST} SELECT count(*) AS stale, count(*) FILTER (WHERE reason = 'deleted') AS missing, (SELECT coalesce(max(CAST(json_extract_string(value, '$.lastIndexedAt') AS BIGINT)), 0) FROM meta WHERE key = 'graph') AS checked_at FROM stale WHERE reason IS NOT NULL",
    "update_counters": f"""WITH {_GRAPH}, p AS (SELECT DISTINCT path FROM file_observations WHERE run_id = (SELECT max(run_id) FROM file_observations)), own AS (SELECT id, file_path FROM gn WHERE file_path IN (SELECT path FROM p))
SELECT (SELECT count(*) FROM own) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT e.edge_id, o.file_path FROM ge e JOIN own o ON o.id = e.source OR o.id = e.target) t) AS edges""",
    "delete_files": f"""WITH {_GRAPH}, {_NEWEST}, p AS (SELECT DISTINCT path FROM file_observations WHERE run_id = (SELECT max(run_id) FROM file_observations)), gone AS (SELECT id FROM gn WHERE file_path IN (SELECT path FROM p))
SELECT (SELECT count(*) FROM gn WHERE id NOT IN (SELECT id FROM gone)) AS nodes, (SELECT count(*) FROM ge WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)) AS edges, (SELECT count(*) FROM stored WHERE path NOT IN (SELECT path FROM p)) AS files""",
    "node_counts_per_file": f"WITH {_GRAPH} SELECT file_path, count(*) AS n FROM gn GROUP BY file_path",
    "placeholders": f"""WITH {_GRAPH} SELECT DISTINCT target AS id, split_part(target, ':', 1) AS type, array_to_string(string_split(target, ':')[3:], ':') AS name, '' AS file_path, '["unresolved"]' AS tags
FROM ge WHERE contains(target, ':*:') AND target NOT IN (SELECT id FROM gn)""",
    "dedup_edges": f"WITH {_GRAPH} SELECT source, target, edge_type, metadata, max(edge_id) AS edge_id FROM ge GROUP BY ALL",
    "canonical_edges": f"WITH {_GRAPH}, u AS (SELECT DISTINCT source, target, edge_type, metadata FROM ge), c AS (SELECT source, target, edge_type, coalesce(metadata, '') AS metadata FROM u) SELECT row_number() OVER (ORDER BY source, target, edge_type, metadata) AS edge_number, * FROM c",
    "call_resolution": f"""{_named(_CALLS)} SELECT call_id, coalesce(t1, t2, t3, ti, 'unresolved-call:' || file_path || ':' || call_id) AS target_id,
  CASE WHEN coalesce(t1, t2, t3) IS NOT NULL THEN 'resolved' WHEN ti IS NOT NULL THEN 'import' ELSE 'unresolved' END AS resolution FROM solved""",
    "custom_edges_same_file": f"WITH {_GRAPH} SELECT a.id AS source, b.id AS target FROM gn a JOIN gn b ON b.file_path = a.file_path AND b.type = 'interface' AND a.id <> b.id WHERE a.type = 'class'",
    "custom_edges_imported": f"""WITH {_GRAPH}, pairs AS (SELECT DISTINCT s.file_path AS pf, t.file_path AS qf FROM ge e JOIN gn s ON s.id = e.source AND s.type = 'file' JOIN gn t ON t.id = e.target AND t.type = 'file' WHERE e.edge_type = 'imports'),
a AS (SELECT id, file_path FROM gn WHERE type = 'class'), b AS (SELECT id, file_path FROM gn WHERE type = 'interface' AND starts_with(name, 'S'))
SELECT a.id AS source, b.id AS target FROM a JOIN b ON b.file_path = a.file_path AND a.id <> b.id UNION ALL SELECT a.id, b.id FROM a JOIN pairs p ON p.pf = a.file_path JOIN b ON b.file_path = p.qf AND a.id <> b.id""",
    "custom_edges_all": f"WITH {_GRAPH} SELECT a.id AS source, b.id AS target FROM gn a JOIN gn b ON b.type = 'interface' AND a.id <> b.id WHERE a.type = 'class'",
    "package_owner": f"WITH {_OWNER} SELECT path, coalesce(string_split(config_dir, '/')[-1], 'root') AS package_id, config_dir FROM owner",
    "batch_plan": f"WITH {_OWNER} SELECT path, config_dir, CAST((row_number() OVER (PARTITION BY config_dir ORDER BY path) - 1) // 32 AS INTEGER) AS batch FROM owner",
    "import_resolution": f"WITH {_SPECIFIERS} SELECT importer, specifier, target_path FROM resolved",
    "legacy_edge_dedup": f"""WITH {_GRAPH}, k AS (SELECT e.source, e.target, e.edge_type, CASE lower(coalesce(e.direction, '')) WHEN 'both' THEN 'bidirectional' WHEN 'mutual' THEN 'bidirectional' WHEN 'bidirectional' THEN 'bidirectional' WHEN 'backward' THEN 'backward' ELSE 'forward' END AS direction,
  coalesce(e.weight, 0.5) AS weight, e.edge_id FROM ge e WHERE e.source IN (SELECT id FROM gn) AND e.target IN (SELECT id FROM gn))
SELECT source, target, edge_type, direction, weight, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY source, target, edge_type, direction ORDER BY weight DESC, edge_id) AS nth FROM k) r WHERE nth = 1""",
    "legacy_complexity": f"WITH {_GRAPH} SELECT CASE WHEN lower(trim(complexity)) IN ('simple', 'low', 'easy') THEN 'simple' WHEN lower(trim(complexity)) IN ('complex', 'high', 'hard', 'difficult') THEN 'complex' ELSE 'moderate' END AS complexity, count(*) AS n FROM gn GROUP BY 1",
    "legacy_import_recovery": f"""WITH {_GRAPH}, {_SPECIFIERS}, ids AS (SELECT id, file_path FROM gn WHERE type = 'file')
SELECT DISTINCT s.id AS source, t.id AS target, 0.7 AS weight FROM resolved r JOIN ids s ON s.file_path = r.importer JOIN ids t ON t.file_path = r.target_path
WHERE NOT EXISTS (SELECT 1 FROM ge e WHERE e.edge_type = 'imports' AND e.source = s.id AND e.target = t.id)""",
}
ORACLES["search_scan"] = ORACLES["search_fts"]
