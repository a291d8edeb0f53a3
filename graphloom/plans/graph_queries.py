"""Queries of the graph operators over a dataset directory, with their SQL.

The graph is that of the tables nodes, library_nodes and edges; ``deps_*`` with a
region run over the star graph of the business tables, a projection written the
same way in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.paths import file_group, group_ordinal
from graphloom.operators import audit, freshness, impact, ingest, legacy, resolve, scan, search, stats, traverse, update
from graphloom.operators.graph import clean_edges, clean_nodes
from graphloom.operators.search_index import SearchIndex, indexed_search
from graphloom.plans.star import STAR_SQL, star_edges, star_nodes
from graphloom.sources.graph_store import graph_store, stored_once
from graphloom.sources.tables import table
from graphloom.workspace import Scratch

REGION = "region:/w/region:2"
HOT = "function:/srv/checkouts/_platform/runtime/src/store.ts:useShelf"
TYPE = "interface:/srv/checkouts/_platform/runtime/src/types.ts:Envelope"
LOG = "function:/srv/checkouts/_platform/runtime/src/log.ts:emitTrace"
INDEX = "file:/srv/checkouts/_platform/runtime/src/index.ts"


def _store(spark, d):
    paths = [f"{d}/{t}.parquet" for t in ("nodes", "library_nodes", "edges")]
    return graph_store(spark, "graph", paths, lambda: (clean_nodes(table(spark, d, "nodes"), table(spark, d, "library_nodes")), clean_edges(table(spark, d, "edges"))))


def _star(spark, d):
    paths = [f"{d}/{t}.parquet" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")]
    return graph_store(spark, "star", paths, lambda: (star_nodes(spark, d), star_edges(spark, d)))


def _nodes(spark, d):
    return _store(spark, d).nodes


def _edges(spark, d):
    return _store(spark, d).edges.drop("live", "from_package", "to_package")


def graph_stored(spark, d):
    """Builds the stores of both graphs, if they are new, and counts them."""
    parts = [(name, store.nodes, store.edges) for name, store in (("graph", _store(spark, d)), ("star", _star(spark, d)))]
    rows = [n.agg(F.lit(name).alias("graph"), F.count("*").alias("n_nodes")).crossJoin(F.broadcast(e.agg(F.count("*").alias("n_edges"), F.count_if("live").alias("n_live")))) for name, n, e in parts]
    return rows[0].unionByName(rows[1])


def _hops(df):
    return df.select("hops", "edge_id", "edge_type", "node_id", "node_type", "node_name", "via")


def _busiest(edges):
    """The id with the most outgoing edges, the least of several."""
    top = edges.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").first()
    return top["source"] if top else ""


def _dependencies(root, downstream, depth, packages=(None, None), star=False):
    def query(spark, d):
        graph = _star(spark, d) if star else _store(spark, d)
        nodes, edges = graph.nodes, graph.edges
        at = root if root else _busiest(edges)
        return _hops(traverse.dependencies(nodes, edges, at, downstream, depth, *packages))

    return query


def _callers(depth):
    return lambda spark, d: _hops(traverse.callers(_nodes(spark, d), _store(spark, d).edges, LOG, depth))


def path_shortest(spark, d):
    found = traverse.shortest_path(_star(spark, d).edges, "order:/w/orders:1", "nation:/w/nation:3")
    return found.select("hops", F.array_join("path", " -> ").alias("route"))


def path_labels(spark, d):
    nodes, edges = _star(spark, d).nodes, _star(spark, d).edges
    return traverse.path_labels(traverse.shortest_path(edges, "order:/w/orders:2", "region:/w/region:1"), nodes).select("pos", "label")


def inspect(spark, d):
    return traverse.neighbourhood(_nodes(spark, d), _edges(spark, d), TYPE)


def resolve_exact(spark, d):
    return resolve.resolve_node(_nodes(spark, d), "useshelf")


def resolve_partial(spark, d):
    return resolve.resolve_node(_nodes(spark, d), "SESHEL")


def resolve_type_name(spark, d):
    return resolve.resolve_root(_nodes(spark, d), "interface:Envelope", "/srv/checkouts")


def stats_totals(spark, d):
    return stats.totals(_nodes(spark, d), _edges(spark, d))


def stats_nodes_by_type(spark, d):
    return stats.by_type(_nodes(spark, d), "type")


def stats_edges_by_type(spark, d):
    return stats.by_type(_edges(spark, d), "edge_type")


def stats_bars(spark, d):
    return stats.bars(stats.by_type(_nodes(spark, d), "type"))


def stats_top_imported(spark, d):
    return stats.top_imported(_nodes(spark, d), _edges(spark, d))


def stats_largest_files(spark, d):
    return stats.largest_files(_nodes(spark, d))


def stats_packages(spark, d):
    return stats.packages(_nodes(spark, d), "/srv/checkouts")


def tag_distribution(spark, d):
    return stats.tag_distribution(_nodes(spark, d))


def files_counts(spark, d):
    return stats.file_counts(_nodes(spark, d))


def files_pattern(spark, d):
    return stats.file_counts(_nodes(spark, d), "TESTS/")


def search_like(spark, d):
    return search.like_search(_nodes(spark, d), "ledger")


def _index(spark, d):
    paths = [f"{d}/{t}.parquet" for t in ("nodes", "library_nodes")]
    return stored_once(spark, "search", paths, lambda: SearchIndex.build(_nodes(spark, d)))


def search_stored(spark, d):
    """Builds the search index, if it is new, and counts it."""
    index = _index(spark, d)
    return index.postings.agg(F.countDistinct("token").alias("n_tokens"), F.count("*").alias("n_postings")).crossJoin(F.broadcast(index.corpus.select(F.col("all").alias("n_nodes"))))


def search_fts(spark, d):
    return indexed_search(_index(spark, d), _nodes(spark, d), "src index")


def search_scan(spark, d):
    return search.phrase_search(_nodes(spark, d), "src index")


def search_dispatch(spark, d):
    return search.search(_nodes(spark, d), "edger", "function")


def explore_fanout(spark, d):
    matches = search.like_search(_nodes(spark, d), "useShelf")
    return traverse.explore_relationships(_nodes(spark, d), _edges(spark, d), matches)


def _changed(spark, d):
    seen = table(spark, d, "file_observations", "run_id", "path")
    return seen.join(F.broadcast(seen.agg(F.max("run_id").alias("run_id"))), "run_id").select("path").distinct()


def affected_files(spark, d):
    rows = traverse.affected_files(_nodes(spark, d), _edges(spark, d), _changed(spark, d))
    return rows.select("changed_path", "file_path", F.array_join("path", " <- ").alias("route"))


def affected_groups(spark, d):
    rows = traverse.affected_files(_nodes(spark, d), _edges(spark, d), _changed(spark, d))
    files = rows.groupBy("file_path").agg(F.countDistinct("path").alias("n_paths"))
    return files.select("file_path", file_group(F.col("file_path")).alias("file_group"), group_ordinal(file_group(F.col("file_path"))).alias("ordinal"), "n_paths")


def affected_tests(spark, d):
    return affected_groups(spark, d).filter("file_group = 'tests'").select("file_path", "n_paths")


def impact_walk(spark, d):
    return traverse.impact_walk(_nodes(spark, d), _store(spark, d).edges, TYPE, depth=3)


def impact_level(spark, d):
    return traverse.impact_walk(_nodes(spark, d), _store(spark, d).edges, TYPE, depth=1)


def impact_buckets(spark, d):
    nodes = _nodes(spark, d)
    return impact.bucket_counts(impact.met_nodes(traverse.impact_walk(nodes, _store(spark, d).edges, HOT, depth=1), nodes))


def impact_tests(spark, d):
    return impact.impact_tests(_nodes(spark, d), _edges(spark, d), INDEX)


def impact_report(spark, d):
    return impact.impact_report(_nodes(spark, d), _store(spark, d).edges, HOT)


def orphan_edges(spark, d):
    return audit.orphan_edges(_nodes(spark, d), _edges(spark, d))


def duplicate_nodes(spark, d):
    return audit.duplicate_nodes(_nodes(spark, d))


def missing_files(spark, d):
    return audit.missing_files(_nodes(spark, d), table(spark, d, "sources", "path"))


def documentation_audit(spark, d):
    return audit.documentation_issues(_nodes(spark, d))


def documentation_params(spark, d):
    nodes, texts = _nodes(spark, d), table(spark, d, "sources", "path", "text")
    return audit.documentation_issues(nodes, scan.declared_parameters(texts, nodes))


def audit_all(spark, d):
    nodes, texts = _nodes(spark, d), table(spark, d, "sources", "path", "text")
    return audit.audit_report(nodes, _edges(spark, d), texts, scan.stale_symbols(nodes, texts), audit.documentation_issues(nodes))


def _stored(spark, d):
    return freshness.newest(table(spark, d, "files"), "indexed_at")


def _current(spark, d):
    return freshness.newest(table(spark, d, "file_observations"), "indexed_at", "obs_id")


def stale_files(spark, d):
    return freshness.stale_files(_stored(spark, d), _current(spark, d))


def freshness_block(spark, d):
    return freshness.freshness(_stored(spark, d), _current(spark, d), table(spark, d, "meta"))


def update_counters(spark, d):
    return update.update_counters(_nodes(spark, d), _edges(spark, d), _changed(spark, d))


def delete_files(spark, d):
    n, e, f = update.delete_files(_nodes(spark, d), _edges(spark, d), _stored(spark, d), _changed(spark, d))
    counts = [x.agg(F.count("*").alias(name)) for x, name in ((n, "nodes"), (e, "edges"), (f, "files"))]
    return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))


def node_counts_per_file(spark, d):
    return _nodes(spark, d).groupBy("file_path").agg(F.count("*").alias("n"))


def placeholders(spark, d):
    return ingest.placeholders(_nodes(spark, d), _edges(spark, d))


def dedup_edges(spark, d):
    return ingest.deduplicate_edges(_edges(spark, d)).select("source", "target", "edge_type", "metadata", "edge_id")


def canonical_edges(spark, d):
    return ingest.canonical_order(ingest.deduplicate_edges(_edges(spark, d)).select("source", "target", "edge_type", F.coalesce("metadata", F.lit("")).alias("metadata"))).select("edge_number", "source", "target", "edge_type", "metadata")


def _call_inputs(spark, d):
    nodes = _nodes(spark, d)
    functions = nodes.filter("type = 'function'")
    calls = _edges(spark, d).filter("edge_type = 'calls'")
    own = functions.select(F.col("id").alias("source"), F.col("name").alias("owner_name"), "file_path")
    called = F.regexp_extract("target", "([^:]*)$", 1)
    c = calls.join(own, "source").select(F.col("edge_id").alias("call_id"), "owner_name", "file_path", F.when(F.col("edge_id") % 3 == 0, F.concat(F.lit("this."), called)).otherwise(called).alias("expression"))
    imports = _edges(spark, d).filter("edge_type = 'imports'")
    files = nodes.filter("type = 'file'").select("id", "file_path")
    pairs = imports.join(files.select(F.col("id").alias("source"), "file_path"), "source").join(files.select(F.col("id").alias("target"), F.col("file_path").alias("target_file")), "target")
    base = F.regexp_extract("name", r"([^.]*)$", 1)
    exported = functions.select(F.col("file_path").alias("target_file"), "name")
    b = pairs.join(exported, "target_file").select("file_path", F.col("edge_id").alias("declaration"), F.lit(0).alias("binding"), "target_file", F.lit("named").alias("kind"), base.alias("local_name"), F.col("name").alias("imported_name"))
    return c, ingest.symbol_lookups(nodes), b


def call_resolution(spark, d):
    return ingest.resolve_calls(*_call_inputs(spark, d))


def custom_edges_same_file(spark, d):
    return ingest.custom_edges(_nodes(spark, d), _edges(spark, d), "class", "interface", "same-file")


def custom_edges_imported(spark, d):
    return ingest.custom_edges(_nodes(spark, d), _edges(spark, d), "class", "interface", "imported", "S*")


def custom_edges_all(spark, d):
    return ingest.custom_edges(_nodes(spark, d), _edges(spark, d), "class", "interface", "all")


def _configs(files):
    return files.select(F.regexp_extract("path", r"^(/srv/checkouts/[^/]+/packages/[^/]+)/", 1).alias("dir")).filter("dir != ''").distinct()


def package_owner(spark, d):
    files = table(spark, d, "files", "path")
    return ingest.package_owner(files, _configs(files))


def batch_plan(spark, d):
    return ingest.plan_batches(package_owner(spark, d).select("path", "config_dir"))


def import_resolution(spark, d):
    files = table(spark, d, "files", "path").distinct()
    text = table(spark, d, "sources", "path", "text").filter("text is not null")
    spec = F.explode(F.regexp_extract_all("text", F.lit(r"from [\"'](\.[^\"']*)[\"']"), F.lit(1)))
    return ingest.resolve_imports(text.select(F.col("path").alias("importer"), spec.alias("specifier")), files)


def _scanned(spark, d):
    """Nodes and edges of one scan of the sources, saved."""

    def build():
        scratch, texts = Scratch(spark, "scanned"), table(spark, d, "sources", "path", "text")
        nodes, edges = scan.scan(texts, _configs(texts))
        return scratch.save(nodes, "nodes"), scratch.save(edges, "edges")

    return stored_once(spark, "scan", [f"{d}/sources.parquet"], build)


def ingest_nodes(spark, d):
    return _scanned(spark, d)[0]


def ingest_edges(spark, d):
    return _scanned(spark, d)[1]


def stale_symbols(spark, d):
    return scan.stale_symbols(_nodes(spark, d), table(spark, d, "sources", "path", "text"))


def legacy_ids(spark, d):
    n = table(spark, d, "nodes", "id", "type", "name", "file_path").distinct()
    raw = F.when(F.col("type") == "function", F.regexp_replace("id", "^function:", "func:")).when(F.col("type") == "file", F.concat(F.lit("file:"), F.col("id"))).when(F.col("type") == "field", F.col("name")).otherwise(F.col("id"))
    rows = n.select(raw.alias("old_id"), legacy.normalized_id(raw, F.col("type"), F.col("file_path"), F.col("name")).alias("new_id"))
    return rows.select("old_id", "new_id", legacy.id_fix(F.col("old_id"), F.col("new_id")).alias("fix"))


def legacy_fix_counts(spark, d):
    return legacy_ids(spark, d).groupBy("fix").agg(F.count("*").alias("n"))


def legacy_edge_dedup(spark, d):
    ids = _nodes(spark, d).select(F.col("id").alias("old_id"), F.col("id").alias("new_id"))
    return legacy.merge_edges(_edges(spark, d), ids, _nodes(spark, d))


def legacy_complexity(spark, d):
    return _nodes(spark, d).groupBy(legacy.normalized_complexity(F.coalesce("complexity", F.lit(""))).alias("complexity")).agg(F.count("*").alias("n"))


def legacy_tested_by(spark, d):
    return legacy.link_tests(_nodes(spark, d), _edges(spark, d))


def legacy_import_recovery(spark, d):
    known = import_resolution(spark, d).filter("target_path is not null").select(F.col("importer"), F.col("target_path").alias("imported")).distinct()
    return legacy.recover_imports(known, _edges(spark, d), _nodes(spark, d))


QUERIES = {
    "deps_up_d3": _dependencies(REGION, False, 3, star=True),
    "deps_down_d3": _dependencies("order:/w/orders:1", True, 3, star=True),
    "deps_up_d1": _dependencies(TYPE, False, 1),
    "deps_down_d1": _dependencies(None, True, 1),
    "deps_down_d2": _dependencies(None, True, 2),
    "deps_up_d2": _dependencies(TYPE, False, 2),
    "deps_pkg": _dependencies(HOT, False, 2, (None, "runtime")),
    "callers_d1": _callers(1),
    "callers_d2": _callers(2),
}
QUERIES |= {
    f.__name__: f
    for f in (
        graph_stored, path_shortest, path_labels, inspect, resolve_exact, resolve_partial, resolve_type_name, stats_totals, stats_nodes_by_type, stats_edges_by_type, stats_bars, stats_top_imported, stats_largest_files, stats_packages, tag_distribution, files_counts, files_pattern,
        search_like, search_stored, search_fts, search_scan, search_dispatch, explore_fanout, affected_files, affected_groups, affected_tests, impact_walk, impact_level, impact_buckets, impact_tests, impact_report, orphan_edges, duplicate_nodes, missing_files, documentation_audit, documentation_params, audit_all, stale_files, freshness_block, update_counters,
        delete_files, node_counts_per_file, placeholders, dedup_edges, canonical_edges, call_resolution, custom_edges_same_file, custom_edges_imported, custom_edges_all, package_owner, batch_plan, import_resolution, ingest_nodes, ingest_edges, stale_symbols, legacy_ids, legacy_fix_counts, legacy_edge_dedup, legacy_complexity, legacy_tested_by, legacy_import_recovery,
    )
}

from graphloom.plans.graph_sql import ORACLES  # noqa: E402, F401
