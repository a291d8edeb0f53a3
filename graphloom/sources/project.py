"""Reading TypeScript projects, their configurations and other inputs from a file system."""

from __future__ import annotations

import json
import posixpath
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import glob_regex
from graphloom.workspace import Scratch

#: Directories that are never read.
SKIPPED = r"/(?:node_modules|\.git|dist|build|\.next|\.turbo|out|coverage)/"


def _clean(path):
    return F.regexp_replace(path, "^file:/+", "/")


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below root whose name fits a glob: path, content, size, modified_at (ms); skipped directories left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = rows.select(_clean(F.col("path")).alias("path"), "content", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"))
    return rows.filter(~F.col("path").rlike(SKIPPED))


def parse_tsconfig(text: str) -> dict:
    """A tsconfig with comments and trailing commas as a dict; raises ValueError if it is none."""
    plain = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text)
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", plain))


_CONFIG = "path string, dir string, include string, exclude string, parent string, base_url string, paths array<struct<pattern:string,nth:int,target:string>>"


def _config_row(path: str, text: str) -> dict | None:
    """What a configuration says, with globs as one regular expression and paths made absolute; None if unreadable."""
    try:
        config = parse_tsconfig(text)
        options = config.get("compilerOptions") or {}
        base = posixpath.dirname(path)
        whole = lambda p: posixpath.normpath(posixpath.join(base, p))

        def globs(names: list[str] | None, files: list[str] | None = None) -> str | None:
            if names is None and files is None:
                return None
            spread = [g if re.search(r"[*?]|\.[a-z]+$", g) else g.rstrip("/") + "/**" for g in names or []]
            return "|".join(glob_regex(whole(g)) for g in [*spread, *(files or [])]) or "(?!)"

        parent = config.get("extends")
        parent = whole(parent if parent.endswith(".json") else parent + ".json") if isinstance(parent, str) and parent.startswith(".") else None
        root = whole(options["baseUrl"]) if options.get("baseUrl") else None
        rules = options.get("paths")
        paths = None if rules is None else [{"pattern": k, "nth": n, "target": posixpath.normpath(posixpath.join(root or base, t))} for k, ts in rules.items() for n, t in enumerate(ts)]
        return {"path": path, "dir": base, "include": globs(config.get("include"), config.get("files")), "exclude": globs(config.get("exclude")), "parent": parent, "base_url": root, "paths": paths}
    except (ValueError, AttributeError, TypeError):
        return None


def discover_configs(spark: SparkSession, root: str, depth: int = 5) -> DataFrame:
    """The tsconfig.json files below root: path, dir, include, exclude, base_url, paths.

    include (with files) and exclude are regular expressions over absolute paths, or
    null; paths are the rules for import specifiers, each with its absolute target.
    What a configuration does not say it takes from the one it extends, up to depth
    steps. Parsed where the files are read; unreadable ones are left out.
    """
    arrow = pa.schema([(c, pa.string()) for c in ("path", "dir", "include", "exclude", "parent", "base_url")] + [("paths", pa.list_(pa.struct([("pattern", pa.string()), ("nth", pa.int32()), ("target", pa.string())])))])

    def run(batches):
        for batch in batches:
            rows = [_config_row(p, (c or b"").decode("utf-8", "replace")) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
            yield pa.RecordBatch.from_pylist([r for r in rows if r], schema=arrow)

    every = Scratch(spark, "configs").save(read_files(spark, root, "*.json").filter(F.col("path").rlike(r"/tsconfig[^/]*\.json$")).select("path", "content").mapInArrow(run, _CONFIG), "configs")
    own = every.filter(F.col("path").endswith("/tsconfig.json"))
    said = ["include", "exclude", "base_url", "paths"]
    above = every.select(F.col("path").alias("at"), F.col("parent").alias("next"), *[F.col(c).alias(f"_{c}") for c in said])
    for _ in range(depth):
        own = own.join(above, F.col("parent") == F.col("at"), "left").select("path", "dir", F.col("next").alias("parent"), *[F.coalesce(c, f"_{c}").alias(c) for c in said])
    return own.drop("parent")


def ancestors(files: DataFrame) -> DataFrame:
    """Each path with each directory above it: path, dir."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select("path").distinct().select("path", F.explode(ups).alias("dir"))


def claims(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Which configurations claim which files: path, config_dir.

    A configuration claims what lies in its directory and fits its include and not its
    exclude globs. Files meet the configurations of their own ancestors by equality.
    """
    met = ancestors(files).join(configs.select("dir", "include", "exclude"), "dir")
    fits = F.coalesce(F.rlike("path", F.col("include")), F.lit(True)) & ~F.coalesce(F.rlike("path", F.col("exclude")), F.lit(False))
    return met.filter(fits).select("path", F.col("dir").alias("config_dir"))


def load_project(spark: SparkSession, root: str) -> DataFrame:
    """The TypeScript texts of a project: path, text.

    Files of the root configuration if it has any; else of all configurations; without
    one, or where none claims a file, every .ts and .tsx file.
    """
    files = read_files(spark, root, "*.{ts,tsx}").select("path", F.decode("content", "utf-8").alias("text"))
    top = root.rstrip("/").removeprefix("file://")
    claimed = Scratch(spark, "claims").save(claims(files, discover_configs(spark, root)), "claims")
    for some in (claimed.filter(F.col("config_dir") == top), claimed):
        if not some.isEmpty():
            return files.join(some.select("path").distinct(), "path", "left_semi")
    return files


def choose_owner(claimed: DataFrame) -> DataFrame:
    """Of several configurations claiming a file the deepest, then the first path: path, config_dir."""
    rows = claimed.select("path", "config_dir").groupBy("path").agg(F.min(F.struct((-F.size(F.split("config_dir", "/"))).alias("up"), "config_dir")).alias("b"))
    return rows.select("path", F.col("b.config_dir").alias("config_dir"))


def include_files(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """Further files as bare file nodes: id, type, name, file_path, line_start, line_end, package_id."""
    wanted = "|".join(glob_regex(posixpath.join(root.rstrip("/").removeprefix("file://"), p)) for p in patterns)
    rows = read_files(spark, root).select("path").filter(F.col("path").rlike(wanted) & ~F.lower("path").rlike(r"\.tsx?$")).distinct()
    return rows.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("root").alias("package_id"))


def file_records(spark: SparkSession, root: str, nodes: DataFrame, now_ms: int) -> DataFrame:
    """Rows of the files table: hash, size and times of each file, and how many nodes it has."""
    counts = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("n"))
    rows = read_files(spark, root, "*.{ts,tsx}").join(counts, "path", "left")
    return rows.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), "size", "modified_at", F.lit(now_ms).alias("indexed_at"), F.coalesce("n", F.lit(0)).alias("node_count"), F.lit(None).cast("string").alias("errors"))


def load_custom_edges(text: str) -> tuple[list[dict], list[str]]:
    """Custom edge definitions of a configuration, and warnings about the invalid ones; raises on bad JSON."""
    found, warnings = [], []
    for n, d in enumerate(json.loads(text).get("customEdges", [])):
        if isinstance(d, dict) and all(isinstance(d.get(k), str) and d[k] for k in ("type", "sourceType", "targetType")) and d.get("scope", "all") in ("same-file", "imported", "all"):
            found.append({"scope": "all", "pattern": {}} | d)
        else:
            warnings.append(f"custom edge {n} is invalid and was skipped")
    return found, warnings


def changed_paths(lines: str, root: str, most_bytes: int = 1 << 20) -> tuple[list[str], bool]:
    """Paths of a text, one per line, resolved against root; and whether the text was cut.

    Blank lines, root itself and paths outside of it are dropped.
    """
    raw = lines.encode()
    cut = len(raw) > most_bytes
    base, out = posixpath.normpath(root), []
    for line in raw[:most_bytes].decode("utf-8", "ignore").splitlines():
        if line.strip():
            path = posixpath.normpath(posixpath.join(base, line.strip()))
            if path.startswith(base.rstrip("/") + "/"):
                out.append(path)
    return out, cut


def snippets(nodes: DataFrame, sources: DataFrame, most_lines: int = 10, most_bytes: int = 10 << 20) -> DataFrame:
    """The first lines of each node's text: id, start, code, truncated. Larger files give none."""
    texts = sources.select("path", "text").filter(F.octet_length("text") <= most_bytes).select("path", F.split("text", "\n", -1).alias("lines"))
    own = nodes.filter("line_start >= 1").select("id", "file_path", "line_start", F.coalesce("line_end", "line_start").alias("line_end"))
    rows = own.join(texts, F.col("file_path") == F.col("path")).filter(F.col("line_start") <= F.size("lines"))
    n = F.least(F.lit(most_lines), F.greatest(F.lit(1), F.col("line_end") - F.col("line_start") + 1))
    return rows.select("id", F.col("line_start").alias("start"), F.array_join(F.slice("lines", F.col("line_start"), n), "\n").alias("code"), (F.col("line_end") - F.col("line_start") + 1 > most_lines).alias("truncated"))


def read_batches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of batch-<n>.json files, in the numeric order of n (column nth); malformed files are skipped."""
    node = "struct<id:string,type:string,name:string,filePath:string,complexity:string>"
    edge = "struct<source:string,target:string,type:string,direction:string,weight:double>"
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="batch-*.json").select(F.regexp_extract(F.input_file_name(), r"batch-(\d+)\.json$", 1).try_cast("bigint").alias("batch"), F.from_json("value", f"nodes array<{node}>, edges array<{edge}>").alias("b"))
    rows = rows.filter("batch is not null and b is not null")
    nodes = rows.select("batch", F.posexplode("b.nodes").alias("at", "n")).select((F.col("batch") * 2**32 + F.col("at")).alias("nth"), "n.id", "n.type", "n.name", F.col("n.filePath").alias("file_path"), "n.complexity")
    edges = rows.select("batch", F.posexplode("b.edges").alias("at", "e")).select((F.col("batch") * 2**32 + F.col("at")).alias("edge_id"), "e.source", "e.target", F.col("e.type").alias("edge_type"), "e.direction", "e.weight")
    return nodes, edges


def fingerprint(sources: DataFrame) -> DataFrame:
    """A structural fingerprint per TypeScript file: path and a hash of what it declares and imports.

    Bodies, layout and comments do not count, the order of declarations neither.
    """
    from graphloom.operators.scan import extract

    facts = extract(sources).filter("rel in ('node', 'import')")
    told = F.array_sort(F.collect_list(F.struct("rel", "type", F.coalesce("name", "specifier").alias("name"), F.coalesce("tags", F.lit("")).alias("tags"))))
    return facts.groupBy("path").agg(F.sha2(F.to_json(told), 256).alias("fingerprint"))
