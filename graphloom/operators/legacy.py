"""Merging graphs that were extracted in batches, and linking tests to what they test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.workspace import Scratch

#: The id prefixes of merged batches, and the other spellings of complexity.
PREFIXES = ["file", "func", "function", "class", "module", "concept", "config", "document", "service", "table", "endpoint", "pipeline", "schema", "resource", "domain", "flow", "step", "article", "entity", "topic", "claim", "source"]
SIMPLE, MODERATE, COMPLEX = ["simple", "low", "easy"], ["moderate", "medium", "intermediate"], ["complex", "high", "hard", "difficult"]
#: How tests are named, by extension.
SCRIPT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue"]
MIRRORED_ROOTS = ["src", "app", "lib", ""]
_TEST = (
    r"\.(?:test|spec)\.(?:ts|tsx|js|jsx|mjs|cjs|vue)$|_test\.(?:go|py|c|cpp|cc)$|(?:^|/)test_[^/]*\.(?:py|c|cpp|cc)$"
    r"|Tests?\.(?:java|kt|cs)$|IT\.java$"
)


def normalized_id(node_id: Column, node_type: Column, file_path: Column, name: Column) -> Column:
    """An id with one known prefix: doubled prefixes and ``func:`` repaired, a bare id completed."""
    known = "|".join(PREFIXES)
    once = F.regexp_replace(node_id, rf"^({known}):\1:", "$1:")
    foreign = once.rlike(rf"^[^:]+:(?:{known}):.") & ~once.rlike(rf"^(?:{known}):")
    once = F.when(foreign, F.regexp_replace(once, "^[^:]+:", "")).otherwise(once)
    once = F.regexp_replace(once, "^func:", "function:")
    kind = F.when(node_type == "func", "function").when(node_type.isin(PREFIXES), node_type).otherwise("file")
    symbol = F.concat_ws(":", kind, F.when(F.coalesce(file_path, F.lit("")) != "", file_path).otherwise("__nofilepath__"), F.coalesce(name, once))
    bare = F.when(node_type.isin("function", "class"), symbol).otherwise(F.concat_ws(":", kind, once))
    return F.when(once.rlike(f"^(?:{known}):"), once).otherwise(bare)


def normalized_complexity(value: Column) -> Column:
    """simple, moderate or complex; whole numbers to 3 and to 6; anything else is moderate."""
    text, number = F.lower(F.trim(value)), F.floor(F.trim(value).try_cast("double"))
    return F.when(text.isin(SIMPLE) | (number <= 3), "simple").when(text.isin(COMPLEX) | (number > 6), "complex").otherwise("moderate")


def normalized_direction(value: Column) -> Column:
    """forward, backward or bidirectional; anything else is forward."""
    text = F.lower(F.trim(value))
    return F.when(text.isin("both", "mutual", "bidirectional"), "bidirectional").when(text == "backward", "backward").otherwise("forward")


def id_fix(original: Column, fixed: Column) -> Column:
    """What was corrected in an id: unchanged, double_prefix, renamed_prefix or added_prefix."""
    known = "|".join(PREFIXES)
    return F.when(original == fixed, "unchanged").when(original.rlike(rf"^({known}):\1:"), "double_prefix").when(original.startswith("func:"), "renamed_prefix").otherwise("added_prefix")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes under their normalized ids, the last row (column nth) of each: id, type, name, file_path, complexity."""
    new = normalized_id(F.col("id"), F.col("type"), F.col("file_path"), F.col("name"))
    rows = nodes.filter("id is not null").select(new.alias("id"), "nth", "type", "name", "file_path", normalized_complexity(F.col("complexity")).alias("complexity"))
    best = rows.groupBy("id").agg(F.max(F.struct("nth", "type", "name", "file_path", "complexity")).alias("r"))
    return best.select("id", "r.type", "r.name", "r.file_path", "r.complexity")


def merge_edges(edges: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges rewritten to new ids (old_id, new_id), one per (source, target, type, direction).

    The greatest weight wins, the earliest among equals; edges with an end in no node
    are dropped. Columns: source, target, edge_type, direction, weight, edge_id.
    """
    a = ids.select(F.col("old_id").alias("source"), F.col("new_id").alias("ns"))
    b = ids.select(F.col("old_id").alias("target"), F.col("new_id").alias("nt"))
    rows = edges.join(a, "source", "left").join(b, "target", "left")
    rows = rows.select("edge_id", F.coalesce("ns", "source").alias("source"), F.coalesce("nt", "target").alias("target"), "edge_type", normalized_direction(F.coalesce("direction", F.lit(""))).alias("direction"), F.coalesce("weight", F.lit(0.5)).alias("weight"))
    known = nodes.select(F.col("id").alias("k")).distinct()
    rows = rows.join(known, F.col("source") == F.col("k"), "left_semi").join(known, F.col("target") == F.col("k"), "left_semi")
    best = rows.groupBy("source", "target", "edge_type", "direction").agg(F.max(F.struct("weight", (-F.col("edge_id")).alias("late"))).alias("r"))
    return best.select("source", "target", "edge_type", "direction", "r.weight", (-F.col("r.late")).alias("edge_id"))


def is_test_path(path: Column) -> Column:
    """Whether a path follows the naming of tests of its language."""
    return path.rlike(_TEST)


def production_candidates(path: Column) -> Column:
    """Paths a test file may belong to, in order, as array<string>.

    The mark of a test is taken off its name; the file may stand beside the test, in
    the parent of a ``__tests__`` folder, or, for a test below ``tests``, ``test`` or
    ``spec``, at the same place below one of the mirrored roots. A script's test may
    test any script extension.
    """
    folder, base = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    script = F.regexp_extract(base, r"^(.*)\.(?:test|spec)\.[A-Za-z]+$", 1)
    other = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"_test(\.[a-z]+)$", "$1"), r"^test_(.*\.(?:py|c|cpp|cc))$", "$1"), r"(?:Tests?|IT)(\.(?:java|kt|cs))$", "$1")
    names = F.when(script != "", F.array(*[F.concat(script, F.lit(e)) for e in SCRIPT_EXTENSIONS])).otherwise(F.array(other))
    marked = r"(^|/)(?:__tests__|tests?|spec)/"
    mirrored = [F.regexp_replace(folder, marked, f"$1{r}/" if r else "$1") for r in MIRRORED_ROOTS]
    java = F.regexp_replace(folder, "(^|/)src/test/", "$1src/main/")
    folders = F.array_distinct(F.array(folder, F.regexp_replace(folder, "(^|/)__tests__/", "$1"), java, *mirrored))
    each = F.flatten(F.transform(folders, lambda d: F.transform(names, lambda n: F.concat(d, n))))
    return F.filter(F.array_distinct(each), lambda x: x != path)


def link_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """tested_by edges from production file to test file: source, target, origin.

    Stored ones are kept, or turned round if they run the other way, and dropped
    between two tests or two production files; test files without any get the first
    of their candidate paths that exists (origin kept, flipped or path).
    """
    files = nodes.filter("type = 'file'").select("id", "file_path")
    a = nodes.select(F.col("id").alias("source"), is_test_path(F.coalesce("file_path", F.lit(""))).alias("st"))
    b = nodes.select(F.col("id").alias("target"), is_test_path(F.coalesce("file_path", F.lit(""))).alias("tt"))
    stored = edges.filter("edge_type = 'tested_by'").join(a, "source").join(b, "target").filter("st != tt")
    kept = stored.select(F.when(F.col("tt"), F.col("source")).otherwise(F.col("target")).alias("source"), F.when(F.col("tt"), F.col("target")).otherwise(F.col("source")).alias("target"), F.when(F.col("tt"), "kept").otherwise("flipped").alias("origin"))
    kept = kept.groupBy("source", "target").agg(F.max("origin").alias("origin"))
    tests = files.filter(is_test_path(F.col("file_path"))).join(kept.select(F.col("target").alias("id")), "id", "left_anti")
    tries = tests.select(F.col("id").alias("target"), F.posexplode(production_candidates(F.col("file_path"))).alias("nth", "file_path"))
    met = tries.join(files.select(F.col("id").alias("source"), "file_path"), "file_path").groupBy("target").agg(F.min(F.struct("nth", "source")).alias("b"))
    return kept.unionByName(met.select(F.col("b.source").alias("source"), "target", F.lit("path").alias("origin")))


def tested_tags(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """File nodes with tags as an array, ``tested`` added where a link starts: id, tags."""
    own = F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>"))
    tested = links.select(F.col("source").alias("id")).distinct().withColumn("t", F.array(F.lit("tested")))
    rows = nodes.filter("type = 'file'").select("id", own.alias("own")).join(tested, "id", "left")
    return rows.select("id", F.when(F.col("t").isNotNull(), F.array_union("own", "t")).otherwise(F.col("own")).alias("tags"))


def recover_imports(imported: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Import edges that a scan knew (importer, imported paths) and the graph lacks: source, target, weight."""
    ids = nodes.filter("type = 'file'").select("id", "file_path")
    pairs = imported.join(ids.select(F.col("file_path").alias("importer"), F.col("id").alias("source")), "importer").join(ids.select(F.col("file_path").alias("imported"), F.col("id").alias("target")), "imported")
    have = edges.filter("edge_type = 'imports'").select("source", "target").distinct()
    return pairs.select("source", "target").distinct().join(have, ["source", "target"], "left_anti").withColumn("weight", F.lit(0.7))


def merge_batches(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The merged graph of batches, and a report of what was corrected: nodes, edges, report.

    nodes and edges are those of ``read_batches``. Ids are normalized, the last node of
    each id and the heaviest edge of each link kept, edges without both ends dropped,
    tests linked to what they test. report has section, item and n: input and output
    counts, fixes by kind, links made, and what could not be fixed by kind.
    """
    scratch = Scratch(nodes.sparkSession, "batches")
    new = normalized_id(F.col("id"), F.col("type"), F.col("file_path"), F.col("name"))
    named = scratch.save(nodes.filter("id is not null").select("*", new.alias("new_id")), "named")
    ids = named.select(F.col("id").alias("old_id"), "new_id").groupBy("old_id").agg(F.max("new_id").alias("new_id"))
    merged = scratch.save(merge_nodes(nodes), "nodes")
    rewritten = scratch.save(merge_edges(edges, ids, merged), "edges")
    linked = scratch.save(link_tests(merged, rewritten), "linked")
    tested = linked.select("source", "target", F.lit("tested_by").alias("edge_type"), F.lit("forward").alias("direction"), F.lit(0.5).alias("weight"), F.lit(None).cast("bigint").alias("edge_id"))
    out = rewritten.filter("edge_type != 'tested_by'").unionByName(tested)

    def told(rows: DataFrame, section: str, item) -> DataFrame:
        return rows.groupBy(item.alias("item")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "item", "n")

    ends = edges.join(ids.select(F.col("old_id").alias("source"), F.col("new_id").alias("ns")), "source", "left").join(ids.select(F.col("old_id").alias("target"), F.col("new_id").alias("nt")), "target", "left")
    moved = (F.coalesce("ns", "source") != F.col("source")) | (F.coalesce("nt", "target") != F.col("target"))
    known = merged.select(F.col("id").alias("k"))
    a, b = ends.select(F.coalesce("ns", "source").alias("k")), ends.select(F.coalesce("nt", "target").alias("k"))
    usual = F.lower(F.trim("complexity")).isin("simple", "moderate", "complex")
    parts = [
        told(nodes, "input", F.lit("nodes")),
        told(edges, "input", F.lit("edges")),
        told(named.select(id_fix(F.col("id"), F.col("new_id")).alias("fix")).filter("fix != 'unchanged'"), "fixed", F.concat(F.lit("id: "), F.col("fix"))),
        told(named.filter(~usual), "fixed", F.concat(F.lit("complexity: "), F.col("complexity"))),
        told(ends.filter(moved), "fixed", F.lit("edges rewritten")),
        told(linked.filter("origin = 'flipped'"), "fixed", F.lit("tested_by turned round")),
        told(linked.filter("origin = 'path'"), "linked", F.lit("tested_by by path")),
        told(linked.select("source").distinct(), "linked", F.lit("nodes tagged tested")),
        told(named.filter(~F.coalesce(F.col("type").isin(*PREFIXES), F.lit(False))), "unfixed", F.concat(F.lit("node type: "), F.coalesce("type", F.lit("null")))),
        told(a.join(known, "k", "left_anti"), "unfixed", F.lit("edges without source")),
        told(b.join(known, "k", "left_anti"), "unfixed", F.lit("edges without target")),
        told(merged, "output", F.lit("nodes")),
        told(out, "output", F.lit("edges")),
    ]
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return merged, out, report
