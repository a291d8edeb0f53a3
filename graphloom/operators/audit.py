"""Integrity checks of a stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.schemas import DOCUMENTATION


def orphan_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end in no node: edge_id, edge_type, missing (source, target or both).

    Missing targets that are placeholders, lie in node_modules or are marked external
    or unresolved in the metadata are exempt; unreadable metadata exempts nothing.
    Ends are looked up by equi-joins on distinct ids.
    """
    ids = nodes.select(F.col("id").alias("known")).distinct()
    rows = edges.join(ids.withColumnRenamed("known", "ks"), F.col("source") == F.col("ks"), "left").join(ids.withColumnRenamed("known", "kt"), F.col("target") == F.col("kt"), "left")
    resolution = F.from_json("metadata", "resolution string")["resolution"]
    exempt = F.col("target").contains(":*:") | F.col("target").startswith("unresolved-call:") | F.col("target").rlike("^file:.*/node_modules/") | F.coalesce(resolution.isin("external", "unresolved"), F.lit(False))
    no_source, no_target = F.col("ks").isNull(), F.col("kt").isNull()
    missing = F.when(no_source & no_target, "both").when(no_source, "source").when(no_target, "target")
    return rows.select("edge_id", "edge_type", missing.alias("missing"), (no_target & exempt).alias("exempt")).filter("missing is not null and not exempt").select("edge_id", "edge_type", "missing")


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """Names held by several ids: type, scope, name, n, first_id, last_id.

    The scope is the file; for params the id without its last part. Placeholders
    without a file are ignored. Ids of a group are counted, not collected.
    """
    scope = F.when(F.col("type") == "param", F.regexp_replace("id", ":[^:]*$", "")).otherwise(F.col("file_path"))
    rows = nodes.filter("file_path != ''").select("type", scope.alias("scope"), F.regexp_replace("name", r"@\d+$", "").alias("name"), "id")
    return rows.groupBy("type", "scope", "name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n > 1")


def missing_files(nodes: DataFrame, present: DataFrame) -> DataFrame:
    """File nodes whose path is not in present (column path): id, file_path."""
    return nodes.filter("type = 'file'").select("id", "file_path").join(present.select(F.col("path").alias("file_path")), "file_path", "left_anti").select("id", "file_path")


#: The documentation tags that are known.
KNOWN_TAGS = ["param", "arg", "argument", "returns", "return", "deprecated", "throws", "example", "see", "remarks", "since", "template", "typeParam", "public", "private", "protected"]


def documentation_issues(nodes: DataFrame, declared: DataFrame | None = None, include_internal: bool = False) -> DataFrame:
    """Issues in the documentation of functions, classes, interfaces and type aliases: id, issue, subject.

    missing_jsdoc (no readable documentation of version 1 with a comment; nothing else
    is reported then), missing_description, duplicate_tag, extra_tag (an unknown tag);
    subject is the tag. Only exported or public symbols of a file count unless
    include_internal. With ``declared`` (id, params array<string> of functions; params
    null where the file has no text) also missing_param, extra_tag (a param that is
    not declared), mismatched_param (a param without description) and
    unsupported_form; subject is the param. Return types are not known here.
    """
    kinds = nodes.filter(F.col("type").isin("function", "class", "interface", "type_alias") & (F.col("file_path") != ""))
    if not include_internal:
        kinds = kinds.filter(F.coalesce(F.arrays_overlap(F.from_json("tags", "array<string>"), F.array(F.lit("exported"), F.lit("public"))), F.lit(False)))
    rows = kinds.select("id", F.from_json("documentation", DOCUMENTATION).alias("d")).withColumn("ok", F.coalesce((F.col("d.version") == 1) & F.col("d.hasJsDoc"), F.lit(False)))
    issue = lambda name, subject=None: F.struct(F.lit(name).alias("issue"), (F.lit(None).cast("string") if subject is None else subject).alias("subject"))
    empty = F.array().cast("array<struct<issue:string,subject:string>>")
    tags = F.coalesce("d.tags", F.array().cast(DOCUMENTATION["tags"].dataType))
    identity = F.transform(tags, lambda t: F.concat_ws(":", t["name"], F.coalesce(t["subject"], t["text"], F.lit(""))))
    repeated = F.filter(F.transform(tags, lambda t, n: F.when(F.array_position(F.slice(identity, 1, n), F.get(identity, n)) > 0, issue("duplicate_tag", t["name"]))), lambda x: x.isNotNull())
    unknown = F.transform(F.filter(tags, lambda t: ~t["name"].isin(KNOWN_TAGS)), lambda t: issue("extra_tag", t["name"]))
    blank = F.when(F.coalesce("d.description", F.lit("")) == "", F.array(issue("missing_description"))).otherwise(empty)
    found = F.concat(blank, repeated, unknown)
    if declared is not None:
        known = declared.select(F.col("id").alias("known"), "params", F.lit(True).alias("met"))
        rows = rows.join(known, F.col("id") == F.col("known"), "left")
        bare = lambda x: F.regexp_replace(x, r"^\.\.\.", "")
        written = F.coalesce("d.params", F.array().cast(DOCUMENTATION["params"].dataType))
        names = F.transform(written, lambda p: bare(p["name"]))
        absent = F.transform(F.filter("params", lambda p: ~F.array_contains(names, bare(p)) & (p != "__destructured")), lambda p: issue("missing_param", p))
        beyond = F.transform(F.filter(names, lambda p: ~F.array_contains(F.transform("params", bare), p)), lambda p: issue("extra_tag", p))
        untold = F.transform(F.filter(written, lambda p: F.coalesce(p["description"], F.lit("")) == ""), lambda p: issue("mismatched_param", p["name"]))
        more = F.when(F.col("met") & F.col("params").isNull(), F.array(issue("unsupported_form"))).when(F.col("met"), F.concat(absent, beyond, untold)).otherwise(empty)
        found = F.concat(found, more)
    all_issues = F.when(~F.col("ok"), F.array(issue("missing_jsdoc"))).otherwise(found)
    return rows.select("id", F.explode(all_issues).alias("i")).select("id", "i.issue", "i.subject")


def audit_report(nodes: DataFrame, edges: DataFrame, sources: DataFrame, symbols: DataFrame, documentation: DataFrame | None = None) -> DataFrame:
    """All checks in one result: check, id, detail.

    symbols is the result of ``stale_symbols`` (id, verdict), documentation that of
    ``documentation_issues``, left out if not asked for. An empty result means a clean
    graph. Edges are named by their number, groups of duplicate nodes by their least id.
    """
    blank = F.lit(None).cast("string")
    parts = [
        missing_files(nodes, sources).select(F.lit("missing_files").alias("check"), "id", F.col("file_path").alias("detail")),
        orphan_edges(nodes, edges).select(F.lit("orphan_edges").alias("check"), F.col("edge_id").cast("string").alias("id"), F.col("missing").alias("detail")),
        duplicate_nodes(nodes).select(F.lit("duplicate_nodes").alias("check"), F.col("first_id").alias("id"), F.col("n").cast("string").alias("detail")),
        symbols.select(F.concat(F.col("verdict"), F.lit("_symbols")).alias("check"), "id", blank.alias("detail")),
    ]
    if documentation is not None:
        parts.append(documentation.select(F.lit("documentation_issues").alias("check"), "id", F.concat_ws(" ", "issue", "subject").alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
