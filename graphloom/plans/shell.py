"""The command surface: raw SQL, canned commands and their text and JSON output."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import __version__
from graphloom.operators import affected as _affected
from graphloom.operators import impact, resolve, search, stats, traverse
from graphloom.operators.graph import clean_edges, clean_nodes
from graphloom.plans import commands
from graphloom.sources.hooks import install_hooks
from graphloom.sources.project import load_custom_edges
from graphloom.sources.store import SnapshotStore

_READS = re.compile(r"^\s*(?:--[^\n]*\n\s*|/\*[\s\S]*?\*/\s*)*(?:select|with|values|from)\b", re.IGNORECASE)


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    """A reading SQL statement over the registered views; anything else is refused.

    ``COLLATE NOCASE`` is understood as UTF8_LCASE.
    """
    if not _READS.match(sql) or ";" in sql.rstrip().rstrip(";"):
        raise ValueError("only a single reading statement is allowed")
    return spark.sql(re.sub(r"\bcollate\s+nocase\b", "COLLATE UTF8_LCASE", sql.rstrip().rstrip(";"), flags=re.IGNORECASE))


def format_table(df: DataFrame) -> str:
    """Padded columns under a rule, NULL for null; ``(no results)`` for none."""
    rows = [["NULL" if v is None else str(v) for v in r] for r in df.collect()]
    if not rows:
        return "(no results)"
    widths = [max(len(c), *(len(r[n]) for r in rows)) for n, c in enumerate(df.columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *map(line, rows)])


def format_json(df: DataFrame, indent: int | None = None) -> str:
    """The rows as a JSON array of objects."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], indent=indent, ensure_ascii=False, default=str)


def limited(df: DataFrame, limit: int | None) -> tuple[DataFrame, int | None]:
    """The first rows, and the true total if some were left out."""
    if not limit or limit < 1:
        return df, None
    if len(df.select(df.columns[:1]).limit(limit + 1).collect()) <= limit:  # one row more than asked for tells
        return df, None
    return df.limit(limit), df.count()


def to_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as lines of a DOT file (column value), to be written as text."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    head = nodes.sparkSession.createDataFrame([("digraph graph_ {",)], "value string")
    a = nodes.select(F.concat(F.lit("  "), quoted(F.col("id")), F.lit(" [label="), quoted(F.concat_ws(":", "type", "name")), F.lit("];")).alias("value"))
    b = edges.select(F.concat(F.lit("  "), quoted(F.col("source")), F.lit(" -> "), quoted(F.col("target")), F.lit(" [label="), quoted(F.col("edge_type")), F.lit("];")).alias("value"))
    return head.unionAll(a).unionAll(b).unionAll(nodes.sparkSession.createDataFrame([("}",)], "value string"))


def main(argv: list[str] | None = None) -> int:
    """Runs a command over a snapshot store; exit code 0, 1 (findings), 2 (not found) or 3 (usage)."""
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("command", choices=["init", "scan", "update", "config", "install-hooks", "query", "search", "deps", "callers", "path", "stats", "inspect", "files", "audit", "explore", "affected", "impact", "help", "version"])
    parser.add_argument("store", nargs="?")
    parser.add_argument("words", nargs="*")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--depth", type=int, default=None)
    parser.add_argument("--limit", type=int, default=None)
    parser.add_argument("--downstream", action="store_true")
    parser.add_argument("--docs", action="store_true")
    parser.add_argument("--include-internal", action="store_true")
    parser.add_argument("--tests-only", action="store_true")
    parser.add_argument("--filter")
    parser.add_argument("--root")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--type")
    parser.add_argument("--edge-type")
    parser.add_argument("--from-package")
    parser.add_argument("--to-package")
    try:
        a = parser.parse_args(argv)
    except SystemExit:
        return 3
    if a.command in ("help", "version"):
        print(parser.format_help() if a.command == "help" else __version__)
        return 0
    if not a.store or a.command in ("scan", "update", "config", "query", "search", "deps", "callers", "inspect", "impact", "explore", "affected") and not a.words or a.command == "path" and len(a.words) < 2:
        print(parser.format_usage(), file=sys.stderr)
        return 3
    if a.command == "install-hooks":  # <store> <project folder>
        root = a.words[0] if a.words else "."
        print(json.dumps(install_hooks(os.path.join(os.path.abspath(root), ".git"), os.path.abspath(root), a.store, a.force)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    store = SnapshotStore(spark, a.store)
    now = int(time.time() * 1000)
    if a.command == "init":
        print("created" if commands.init_store(store) else "exists")
        return 0
    if a.command == "config":
        with open(a.words[0], encoding="utf-8") as f:
            edges, warnings = load_custom_edges(f.read())
        print(json.dumps({"customEdges": edges, "warnings": warnings}, ensure_ascii=False))
        return 1 if warnings else 0
    if a.command in ("scan", "update"):
        run = commands.scan_project if a.command == "scan" else commands.update_project
        counts = run(spark, a.words[0], store, now)
        print(json.dumps(counts) if a.json else ", ".join(f"{k} {v}" for k, v in counts.items()))
        return 0
    store.register()
    nodes, edges = clean_nodes(store.read("nodes")), clean_edges(store.read("edges"))

    def node(text: str) -> str | None:
        found = resolve.resolve_node(nodes, text).limit(2).collect()
        if len(found) == 1:
            return found[0]["id"]
        print("ambiguous" if found else "not found", file=sys.stderr)
        return None

    command, words = a.command, a.words
    if command in ("deps", "callers", "inspect", "impact", "path") and words:
        ids = [node(w) for w in words[: 2 if command == "path" else 1]]
        if None in ids:
            return 2
    if command == "query":
        df = run_query(spark, words[0])
    elif command == "search":
        df = search.search(nodes, words[0], a.type)
    elif command == "deps":
        df = traverse.dependencies(nodes, edges, ids[0], a.downstream, a.depth or 1, a.from_package, a.to_package)
        df = df.orderBy("hops", "node_name", "edge_id") if (a.depth or 1) > 1 else df.orderBy("node_type", "node_name", "edge_id")
    elif command == "callers":
        df = traverse.callers(nodes, edges, ids[0], a.depth or 1, a.from_package, a.to_package)
        df = df.orderBy("hops", "node_name", "edge_id") if (a.depth or 1) > 1 else df.orderBy("node_type", "node_name", "edge_id")
    elif command == "path":
        df = traverse.shortest_path(edges, ids[0], ids[1])
    elif command == "stats":
        sections = commands.stats_sections(nodes, edges)
        if a.json:
            print(json.dumps({k: json.loads(format_json(v)) for k, v in sections.items()}, ensure_ascii=False))
        else:
            print("\n\n".join(f"{k}\n{format_table(v)}" for k, v in sections.items()))
        return 0
    elif command == "inspect":
        df = traverse.neighbourhood(nodes, edges, ids[0]).orderBy(F.desc("way"), "edge_type", "node_name", "edge_id")
    elif command == "files":
        df = stats.file_counts(nodes, words[0] if words else None).orderBy("file_path")
    elif command == "audit":
        df = commands.audit_store(store, a.root, a.docs, a.include_internal)
    elif command == "explore":
        df = commands.explore_store(store, nodes, edges, words[0], a.type, a.root)
    elif command == "affected":
        df = _affected.report(nodes, edges, spark.createDataFrame([(w,) for w in words], "path string"), a.depth or 3, a.tests_only, a.filter)
    else:
        df = impact.impact_report(nodes, edges, ids[0], a.depth or 3, a.edge_type, a.limit or 50, a.from_package, a.to_package)
    shown, total = limited(df, None if command == "impact" else a.limit)
    print(format_json(shown, 2 if command == "query" else None) if a.json else format_table(shown))
    if total:
        print(f"(truncated, {total} in all)", file=sys.stderr)
    return 1 if command == "audit" and not df.isEmpty() else 0


if __name__ == "__main__":
    sys.exit(main())
