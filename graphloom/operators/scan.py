"""Scanning TypeScript texts into a finished graph."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import ingest
from graphloom.sources.typescript import read_file
from graphloom.workspace import Scratch

_STRINGS = ["rel", "path", "id", "type", "name", "complexity", "tags", "documentation", "source", "target", "metadata", "owner", "owner_name", "expression", "specifier", "kind", "local", "imported"]
_NUMBERS = ["nth", "line_start", "line_end", "call_start", "declaration", "binding"]
_SCHEMA = ", ".join([*(f"{c} string" for c in _STRINGS), *(f"{c} int" for c in _NUMBERS)])


def extract(sources: DataFrame) -> DataFrame:
    """One row per fact of a TypeScript file (column rel: node, edge, import, binding or call).

    sources has path and text; other extensions and null texts give nothing, a
    repeated path gives its rows again. Files are read where they lie, no shuffle.
    """
    schema = pa.schema([(c, pa.string()) for c in _STRINGS] + [(c, pa.int32()) for c in _NUMBERS])

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                rows += [r | {"nth": n} for n, r in enumerate(read_file(path, text))]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kept = sources.select("path", "text").filter(F.col("text").isNotNull() & F.lower(F.col("path")).rlike(r"\.tsx?$"))
    return kept.mapInArrow(run, _SCHEMA)


def scan(sources: DataFrame, configs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a set of texts.

    Relative imports, default and named bindings, and calls are resolved across
    files by joins; unresolved calls and wildcard targets get placeholder nodes; nodes
    are kept once by id and edges once by (source, target, type, metadata), the last
    row of each. configs (column dir) gives the package of a file; with columns base_url
    and paths also the files that specifiers without a leading dot name.
    """
    scratch = Scratch(sources.sparkSession, "scan")
    facts = scratch.save(extract(sources), "facts")
    node_cols = ["id", "type", "name", F.col("path").alias("file_path"), "line_start", "line_end", "documentation", "tags", "complexity", "nth"]
    nodes = ingest.keep_last(facts.filter("rel = 'node'").select(*node_cols), ["id"], "nth")
    paths = facts.select("path").distinct()
    imports = facts.filter("rel = 'import'").select(F.col("path").alias("importer"), "specifier", "declaration")
    found = ingest.resolve_imports(imports, paths).filter("target_path is not null")
    if configs is not None and "paths" in configs.columns:
        found = found.unionByName(ingest.resolve_aliases(imports, paths, ingest.package_owner(paths, configs), configs))
    targets = scratch.save(found, "imports")
    file_edges = imports.join(targets, ["importer", "specifier"]).select(F.concat(F.lit("file:"), "importer").alias("source"), F.concat(F.lit("file:"), "target_path").alias("target"), F.lit("imports").alias("edge_type"), F.lit(None).cast("string").alias("metadata"), "declaration")
    bound = facts.filter("rel = 'binding'").select(F.col("path").alias("importer"), "specifier", "declaration", "binding", "kind", F.col("local").alias("local_name"), F.col("imported").alias("imported_name"))
    bindings = bound.join(targets, ["importer", "specifier"]).select(F.col("importer").alias("file_path"), "declaration", "binding", F.col("target_path").alias("target_file"), "kind", "local_name", "imported_name")
    calls = facts.filter("rel = 'call'").select(F.concat_ws(":", "path", "call_start").alias("call_id"), "owner", "owner_name", F.col("path").alias("file_path"), "expression").dropDuplicates(["call_id"])
    solved = ingest.resolve_calls(calls.select("call_id", "owner_name", "file_path", "expression"), ingest.symbol_lookups(nodes), bindings)
    # a file without the symbol's class counts only by its own lookups; the owner comes back by the call
    call_edges = solved.join(calls.select("call_id", "owner", "expression"), "call_id").select(F.col("owner").alias("source"), F.col("target_id").alias("target"), F.lit("calls").alias("edge_type"), F.to_json(F.struct("resolution")).alias("metadata"), F.lit(0).alias("declaration"), "expression", "resolution")
    direct = facts.filter("rel = 'edge'").select("source", "target", F.col("type").alias("edge_type"), "metadata", F.col("nth").alias("declaration"))
    cols = ["source", "target", "edge_type", "metadata"]
    edges = direct.select(*cols).unionByName(file_edges.select(*cols)).unionByName(call_edges.select(*cols)).distinct()
    open_calls = call_edges.filter("resolution = 'unresolved'").groupBy(F.col("target").alias("id")).agg(F.min("expression").alias("name"))
    blank = lambda c: F.lit(None).cast(c)
    missing = open_calls.select("id", F.lit("function").alias("type"), "name", F.lit("").alias("file_path"), blank("int").alias("line_start"), blank("int").alias("line_end"), blank("string").alias("documentation"), F.lit('["unresolved"]').alias("tags"), F.lit("simple").alias("complexity"))
    wild = ingest.placeholders(nodes, edges).select("id", "type", "name", "file_path", blank("int").alias("line_start"), blank("int").alias("line_end"), blank("string").alias("documentation"), "tags", F.lit("simple").alias("complexity"))
    every = nodes.select(*missing.columns).unionByName(missing).unionByName(wild)
    if configs is None:
        return every.withColumn("package_id", F.when(F.col("file_path") == "", blank("string")).otherwise(F.lit("root"))), edges
    owner = ingest.package_owner(paths, configs).select(F.col("path").alias("file_path"), "package_id")
    return every.join(owner, "file_path", "left"), edges


def stale_symbols(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored symbols that their file no longer has: id, verdict stale or unaudited.

    Symbols of files without a text are stale; fields and routes are not audited.
    Only TypeScript files are judged.
    """
    base = F.regexp_replace("name", r"@\d+$", "")
    found = extract(sources).filter("rel = 'node'").select(F.col("path").alias("file_path"), "type", base.alias("b")).distinct().withColumn("there", F.lit(True))
    stored = nodes.filter(F.col("file_path").rlike(r"\.tsx?$") & (F.col("type") != "file") & (F.col("type") != "param")).select("id", "file_path", "type", base.alias("b"))
    rows = stored.join(found, ["file_path", "type", "b"], "left")
    verdict = F.when(F.col("type").isin("field", "route"), "unaudited").when(F.col("there").isNull(), "stale")
    return rows.select("id", verdict.alias("verdict")).filter("verdict is not null")


def declared_parameters(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """The parameters of functions, as their files declare them: id, params array<string>.

    Functions of files without a text have null params; functions that their file does
    not hold give no row. Destructured parameters count by their names.
    """
    facts = extract(sources)
    flow = facts.filter("rel = 'edge' and type = 'param_flow' and source like 'param:%'").select(F.col("target").alias("id"), "nth", F.element_at(F.split("source", ":"), -1).alias("param"))
    params = flow.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "param"))), lambda x: x["param"]).alias("found"))
    held = facts.filter("rel = 'node' and type = 'function'").select("id").distinct().join(params, "id", "left").select("id", F.coalesce("found", F.array().cast("array<string>")).alias("params"))
    texts = sources.filter("text is not null").select(F.col("path").alias("file_path")).distinct()
    unread = nodes.filter("type = 'function'").join(texts, "file_path", "left_anti").select("id", F.lit(None).cast("array<string>").alias("params"))
    return held.unionByName(unread)
