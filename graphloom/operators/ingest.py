"""The relational half of ingest: from extracted fragments to a finished graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.paths import loose_glob
from graphloom.workspace import Scratch

#: The suffixes tried for a relative import, in order.
IMPORT_SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]

#: Blocks of either side when every node meets every other, and the tasks they are spread over.
BLOCKS, BLOCK_TASKS = 16, 64


def first_targets(lookups: DataFrame) -> DataFrame:
    """The least target id per (file_path, lookup_name)."""
    return lookups.groupBy(F.col("file_path").alias("lf"), F.col("lookup_name").alias("ln")).agg(F.min("target_id").alias("lt"))


def symbol_lookups(nodes: DataFrame) -> DataFrame:
    """Names a file's symbols can be called by: the base name and the unique name."""
    base = F.regexp_replace("name", r"@\d+$", "")
    rows = nodes.filter("type in ('function', 'class', 'interface', 'type_alias')")
    return rows.select("file_path", F.explode(F.array_distinct(F.array(base, F.col("name")))).alias("lookup_name"), F.col("id").alias("target_id"))


def resolve_calls(calls: DataFrame, lookups: DataFrame, bindings: DataFrame) -> DataFrame:
    """Targets of deferred calls: call_id, target_id, resolution.

    calls: call_id, owner_name, file_path, expression. lookups: file_path,
    lookup_name, target_id. bindings: file_path, declaration, binding, target_file,
    kind, local_name, imported_name. In order: the bare or ``this`` name in the own
    file; qualifier.name there; Class.name for ``this``; then the imports, of which
    the first declaration that matches decides, even if its lookup misses. A miss
    gets the placeholder ``unresolved-call:file:call`` and resolution ``unresolved``.

    Five left equi-joins against one aggregated lookup; no loop over calls.
    """
    table = first_targets(lookups)
    parts = F.split("expression", r"\.")
    c = calls.select("call_id", "owner_name", "file_path", F.element_at(parts, -1).alias("called"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("qualifier"))
    owner_class = F.when(F.col("owner_name").contains("."), F.substring_index("owner_name", ".", 1))
    plain = F.col("qualifier").isNull() | (F.col("qualifier") == "this")
    c = c.withColumn("k1", F.when(plain, F.col("called"))).withColumn("k2", F.when(F.col("qualifier").isNotNull(), F.concat_ws(".", "qualifier", "called"))).withColumn("k3", F.when(F.col("qualifier") == "this", F.concat_ws(".", owner_class, F.col("called"))))
    for n in (1, 2, 3):
        side = table.select(F.col("lf").alias(f"f{n}"), F.col("ln").alias(f"n{n}"), F.col("lt").alias(f"t{n}"))
        c = c.join(side, (F.col("file_path") == F.col(f"f{n}")) & (F.col(f"k{n}") == F.col(f"n{n}")), "left")
    asked = c.select("call_id", "file_path", "called", F.coalesce("qualifier", "called").alias("requested"))
    b = bindings.select(F.col("file_path").alias("bf"), "declaration", "binding", "target_file", "kind", "local_name", "imported_name")
    met = asked.join(b, (F.col("file_path") == F.col("bf")) & (F.col("requested") == F.col("local_name")))
    order = ["declaration", "binding", "target_file", "kind", "imported_name"]
    chosen = met.groupBy("call_id").agg(F.min(F.struct(*order, "local_name")).alias("b")).select("call_id", "b.*")
    named = F.when(F.col("kind") == "named", F.col("imported_name")).otherwise(F.lit("default"))
    chosen = chosen.withColumn("k4", named).withColumn("k5", F.when(F.col("kind") == "default", F.col("local_name")))
    for n in (4, 5):
        side = table.select(F.col("lf").alias(f"f{n}"), F.col("ln").alias(f"n{n}"), F.col("lt").alias(f"t{n}"))
        chosen = chosen.join(side, (F.col("target_file") == F.col(f"f{n}")) & (F.col(f"k{n}") == F.col(f"n{n}")), "left")
    by_import = chosen.select("call_id", F.coalesce("t4", "t5").alias("ti"))
    rows = c.join(by_import, "call_id", "left")
    target = F.coalesce("t1", "t2", "t3", "ti")
    missing = F.concat_ws(":", F.lit("unresolved-call"), "file_path", F.col("call_id").cast("string"))
    return rows.select("call_id", F.coalesce(target, missing).alias("target_id"), F.when(target.isNull(), "unresolved").when(F.col("t1").isNotNull() | F.col("t2").isNotNull() | F.col("t3").isNotNull(), "resolved").otherwise("import").alias("resolution"))


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes for edge targets with ``:*:`` that have none: id, type, name, file_path, tags."""
    wanted = edges.filter(F.col("target").contains(":*:")).select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    parts = F.split("id", ":")
    return wanted.select("id", parts[0].alias("type"), F.array_join(F.slice(parts, 3, F.size(parts)), ":").alias("name"), F.lit("").alias("file_path"), F.lit('["unresolved"]').alias("tags"))


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order; ties keep the greatest row. One aggregation, no window."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def deduplicate_edges(edges: DataFrame) -> DataFrame:
    """Edges by (source, target, type, metadata), the last row of each: the columns and edge_id."""
    rows = edges.select("source", "target", "edge_type", "metadata", "edge_id", "weight", "direction").withColumn("nth", F.col("edge_id"))
    return keep_last(rows, ["source", "target", "edge_type", "metadata"], "nth")


def canonical_order(edges: DataFrame) -> DataFrame:
    """Edges numbered in their canonical order of source, target, type and metadata.

    The numbers follow a range partitioning: partitions are counted, and a row's
    number is its place in its partition after all earlier ones.
    """
    keys = ["source", "target", "edge_type", "metadata"]
    scratch = Scratch(edges.sparkSession, "order")
    # saved, so that both readings below see the same partitions
    placed = scratch.save(edges.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "placed")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    return placed.withColumn("within", within).join(F.broadcast(before), "part").withColumn("edge_number", F.col("before") + F.col("within")).drop("part", "within", "before")


def custom_edges(nodes: DataFrame, edges: DataFrame, source_type: str, target_type: str, scope: str, target_name: str | None = None) -> DataFrame:
    """Declared edges between nodes of two types: source, target.

    scope ``same-file`` pairs within a file, ``imported`` also along distinct import
    pairs of files (a pair met both ways comes twice), ``all`` every node of the one
    type with every one of the other, which is what that declaration asks for. Its rows
    grow with the square of the input; they are made block by block, each side copied
    once per block of the other, so that no task meets a whole side.
    target_name is a glob in which only * is special.
    """
    a = nodes.filter(F.col("type") == source_type).select(F.col("id").alias("source"), F.col("file_path").alias("sf"))
    b = nodes.filter(F.col("type") == target_type).select(F.col("id").alias("target"), F.col("file_path").alias("tf"), F.col("name").alias("tn"))
    if target_name:
        b = b.filter(F.col("tn").rlike(loose_glob(target_name)))
    same = a.join(b, F.col("sf") == F.col("tf")).filter("source != target").select("source", "target")
    if scope == "same-file":
        return same
    if scope == "imported":
        own = nodes.filter("type = 'file'").select("id", "file_path")
        pairs = edges.filter("edge_type = 'imports'").join(own.select(F.col("id").alias("source"), F.col("file_path").alias("pf")), "source").join(own.select(F.col("id").alias("target"), F.col("file_path").alias("qf")), "target").select("pf", "qf").distinct()
        far = a.join(pairs, F.col("sf") == F.col("pf")).join(b, F.col("qf") == F.col("tf")).filter("source != target").select("source", "target")
        return same.unionAll(far)
    block, every = lambda c: F.pmod(F.xxhash64(c), F.lit(BLOCKS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    left = a.select("source", block("source").alias("i"), every.alias("j")).repartition(BLOCK_TASKS, "i", "j")
    right = b.select("target", every.alias("i"), block("target").alias("j")).repartition(BLOCK_TASKS, "i", "j")
    return left.join(right, ["i", "j"]).filter("source != target").select("source", "target")


def package_owner(files: DataFrame, configs: DataFrame) -> DataFrame:
    """The package of each file (column path): path, package_id, config_dir.

    configs has a column dir. The deepest directory that holds the file wins, without
    one the package is ``root``. Each file is exploded to its own ancestor directories
    and joined by equality, so no file meets every configuration.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = files.select("path").distinct().select("path", F.explode(ups).alias("dir"))
    met = each.join(configs.select("dir").distinct(), "dir").groupBy("path").agg(F.max(F.struct(F.length("dir").alias("n"), F.col("dir"))).alias("b"))
    rows = files.select("path").distinct().join(met, "path", "left")
    return rows.select("path", F.coalesce(F.element_at(F.split("b.dir", "/"), -1), F.lit("root")).alias("package_id"), F.col("b.dir").alias("config_dir"))


def plan_batches(owned: DataFrame, size: int = 32) -> DataFrame:
    """Files cut into batches of at most size per configuration, by path: path, config_dir, batch.

    A configuration may own a third of all files, so files are numbered by blocks: a
    range of paths within a configuration is one block, blocks are counted, and a
    file's number is its place in its block after all earlier ones.
    """
    keys = ["config_dir", "path"]
    scratch = Scratch(owned.sparkSession, "batches")
    placed = scratch.save(owned.select(*keys).repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "placed")
    counts = placed.groupBy("config_dir", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("config_dir").orderBy("part")) - F.col("n")).select(F.col("config_dir").alias("cd"), F.col("part").alias("pt"), "before")
    nth = F.row_number().over(Window.partitionBy("config_dir", "part").orderBy("path"))
    rows = placed.withColumn("nth", nth).join(before, F.col("config_dir").eqNullSafe(F.col("cd")) & (F.col("part") == F.col("pt")))
    return rows.select("path", "config_dir", F.floor((F.col("before") + F.col("nth") - 1) / size).cast("int").alias("batch"))


def _folded(path):
    """A path with its . and .. segments resolved."""
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.array_append(acc, x)))
    return F.array_join(parts, "/")


def _tried(stems: DataFrame, files: DataFrame, *rank: str) -> DataFrame:
    """The first existing file of each (importer, specifier) among its stems with the known suffixes."""
    tries = F.array(*[F.struct(F.lit(n).alias("nth"), F.lit(s).alias("suffix")) for n, s in enumerate(IMPORT_SUFFIXES)])
    each = stems.withColumn("t", F.explode(tries)).select("importer", "specifier", *rank, "t.nth", F.concat("stem", "t.suffix").alias("candidate"))
    met = each.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return met.groupBy("importer", "specifier").agg(F.min(F.struct(*rank, "nth", "candidate")).alias("b")).select("importer", "specifier", F.col("b.candidate").alias("target_path"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The file each relative specifier names: importer, specifier, target_path (null if none).

    ``.`` and ``..`` segments are resolved, then the known suffixes are tried in order.
    """
    rows = imports.select("importer", "specifier").distinct().filter(F.col("specifier").startswith("."))
    stems = rows.withColumn("stem", _folded(F.concat_ws("/", F.regexp_replace("importer", "/[^/]*$", ""), "specifier")))
    return rows.join(_tried(stems, files), ["importer", "specifier"], "left").select("importer", "specifier", "target_path")


def resolve_aliases(imports: DataFrame, files: DataFrame, owned: DataFrame, configs: DataFrame) -> DataFrame:
    """The file each other specifier names by its configuration: importer, specifier, target_path.

    owned gives config_dir of a path, configs has dir, base_url and paths. A rule
    matches exactly or by one *; of several the longest prefix that leads to a file
    wins, its targets in order; then the base directory is tried. Packages give no row.
    """
    rows = imports.select("importer", "specifier").distinct().filter(~F.col("specifier").startswith("."))
    own = rows.join(owned.select(F.col("path").alias("importer"), F.col("config_dir").alias("dir")), "importer").join(configs.select("dir", "base_url", "paths"), "dir")
    rules = own.select("importer", "specifier", F.explode("paths").alias("r")).select("importer", "specifier", "r.*")
    before, after = F.substring_index("pattern", "*", 1), F.substring_index("pattern", "*", -1)
    star = F.col("pattern").contains("*")
    fits = F.when(star, F.startswith("specifier", before) & F.endswith("specifier", after) & (F.length("specifier") >= F.length("pattern") - 1)).otherwise(F.col("specifier") == F.col("pattern"))
    middle = F.expr("substring(specifier, length(substring_index(pattern, '*', 1)) + 1, length(specifier) - length(pattern) + 1)")
    ruled = rules.filter(fits).select("importer", "specifier", F.when(star, -F.length(before)).otherwise(-(2**30)).alias("place"), F.col("nth").alias("turn"), F.when(star, F.replace("target", F.lit("*"), middle)).otherwise(F.col("target")).alias("stem"))
    based = own.filter("base_url is not null").select("importer", "specifier", F.lit(1).alias("place"), F.lit(0).alias("turn"), F.concat_ws("/", "base_url", "specifier").alias("stem"))
    stems = ruled.unionByName(based).withColumn("stem", _folded(F.col("stem")))
    return _tried(stems, files, "place", "turn")
