"""Parent-child links of unknown depth, resolved by tree contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import key128
from graphloom.workspace import Scratch


def graph_links(edges: DataFrame) -> DataFrame:
    """``contains`` and ``extends`` edges as (type, child, parent).

    A forward ``contains`` runs parent -> child, a forward ``extends`` child ->
    parent; ``backward`` rows are stored the other way round. Any other direction
    counts as forward. Rows with a null end give no link.
    """
    rows = edges.select("type", "source", "target", "direction").filter(F.col("type").isin("contains", "extends"))
    child_is_target = (F.col("type") == "contains") != (F.coalesce("direction", F.lit("forward")) == "backward")
    return rows.select(
        "type",
        F.when(child_is_target, F.col("target")).otherwise(F.col("source")).alias("child"),
        F.when(child_is_target, F.col("source")).otherwise(F.col("target")).alias("parent"),
    ).filter("child is not null and parent is not null")


def _priority(key: Column, step: int) -> Column:
    return F.struct(F.xxhash64(key, F.lit(step)), key)


def resolve_hierarchy(links: DataFrame, with_paths: bool = False) -> DataFrame:
    """Root and depth of every child in links (type, child, parent).

    Result: type, node_id, root_id, depth int, on_cycle boolean and, with_paths,
    path array<string> from the root down to the node and turn int. The root is the
    topmost ancestor and depth the number of steps up to it. Where the way up enters
    a loop (also of one node), root_id is the smallest id of that loop, depth is -1
    and path starts at the loop's node that is met first (a node of the loop has
    itself as path). turn is the place of a loop's node on its loop, counted from 0
    downwards, and null for all other nodes. Links stored several times
    count once; if a node has several parents, the smallest id is taken. Null types
    or ids give no row, an empty input gives an empty result, further columns of
    links are ignored.

    Method: tree contraction. Rounds alternate raking (nodes without children
    leave, noting their parent) and compressing (an independent set of nodes with
    one child is spliced out of its chain, noting parent, child and distance), so
    the remaining links fall by a constant factor whatever the depth. Then the
    recorded contractions are reversed, last first, to hand down root, depth and
    path. What never leaves is a loop, by then shrunk to one node that is its own
    parent. Rounds move 16-byte keys, not ids. No step groups unboundedly many
    rows: a parent with a third of all children is met by partial aggregates and
    by equi-joins that split skewed partitions.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    base = scratch.save(
        links.select("type", "child", "parent")
        .filter("type is not null and child is not null and parent is not null")
        .groupBy("type", "child")
        .agg(F.min("parent").alias("parent"))
        .select("type", "child", "parent", key128("type", "child").alias("c"), key128("type", "parent").alias("p")),
        "links",
    )
    key = "struct<a:bigint,b:bigint>"
    mid = F.array().cast(f"array<{key}>") if with_paths else F.lit(None).cast(f"array<{key}>")
    live = base.select("c", "p", F.lit(1).alias("d"), mid.alias("mid"))
    records: list[tuple[str, DataFrame]] = []
    step, loops, kept = 0, None, None
    while True:
        step += 1
        parents = live.select(F.col("p").alias("q")).distinct()
        seen = scratch.save(live.join(parents, F.col("c") == F.col("q"), "left").select("c", "p", "d", "mid", F.col("q").isNull().alias("leaf")), "rake")
        records.append(("rake", seen.filter("leaf").select("c", "p", "d", "mid", F.lit(None).cast(key).alias("o"))))
        live = seen.filter("not leaf").select("c", "p", "d", "mid")
        if live.filter("c != p").isEmpty():
            loops = live
            break
        step += 1
        only = live.groupBy("p").agg(F.count("*").alias("n"), F.min(F.struct("c", "d", "mid")).alias("o"))
        with_child = live.join(only.filter("n = 1").select(F.col("p").alias("q"), "o"), F.col("c") == F.col("q"), "left")
        mine = _priority(F.col("c"), step)
        chosen = F.col("o").isNotNull() & (F.col("c") != F.col("p")) & (F.col("o.c") != F.col("c")) & (mine > _priority(F.col("p"), step)) & (mine > _priority(F.col("o.c"), step))
        seen = scratch.save(with_child.withColumn("chosen", F.coalesce(chosen, F.lit(False))).select("c", "p", "d", "mid", "o", "chosen"), "compress")
        out = seen.filter("chosen")
        records.append(("compress", out.select("c", "p", "d", "mid", F.col("o.c").alias("o"))))
        joined = F.concat("mid", F.array("c"), "o.mid") if with_paths else F.lit(None).cast(f"array<{key}>")
        spliced = out.select(F.col("o.c").alias("c"), "p", (F.col("d") + F.col("o.d")).alias("d"), joined.alias("mid"))
        live = seen.filter("not chosen").select("c", "p", "d", "mid").join(spliced.select(F.col("c").alias("x")), F.col("c") == F.col("x"), "left_anti").unionByName(spliced)
        older, kept = kept, scratch.save(live, "live")
        scratch.drop(older)
        live = kept
    path = F.array("c") if with_paths else F.lit(None).cast(f"array<{key}>")
    done = scratch.save(loops.select("c", F.col("c").alias("root"), F.lit(-1).alias("depth"), F.lit(True).alias("loop"), F.lit(1).alias("entry"), path.alias("path")), "done")
    for kind, rec in reversed(records):
        up = done.select(F.col("c").alias("uc"), "root", "depth", "entry", F.col("path").alias("upath"))
        found = rec.join(up, F.col("p") == F.col("uc"), "left")
        if kind == "compress":
            found = found.join(done.select(F.col("c").alias("oc"), F.col("loop").alias("oloop")), F.col("o") == F.col("oc"), "left")
        else:
            found = found.withColumn("oloop", F.lit(False))
        whole = F.concat(F.coalesce("upath", F.array("p")), "mid", F.array("c")) if with_paths else F.lit(None).cast(f"array<{key}>")
        found = found.select(
            "c",
            F.coalesce("root", "p").alias("root"),
            F.when(F.col("depth") == -1, F.lit(-1)).otherwise(F.coalesce("depth", F.lit(0)) + F.col("d")).alias("depth"),
            F.coalesce("oloop", F.lit(False)).alias("loop"),
            # how many of the path's first steps lie on a loop
            F.when(F.col("oloop") & F.lit(with_paths), F.size(whole)).otherwise(F.coalesce("entry", F.lit(0))).alias("entry"),
            whole.alias("path"),
        )
        if rec is records[0][1]:
            done = done.unionByName(found)
        else:
            older, done = done, scratch.save(done.unionByName(found), "done")
            scratch.drop(older)
    named = base.select("type", F.col("child").alias("node_id"), "c").join(done, "c")
    names = base.select(F.col("p").alias("k"), F.col("parent").alias("name")).distinct()
    tops = named.filter("depth >= 0").join(names, F.col("root") == F.col("k"))
    cols = ["type", "node_id", F.col("name").alias("root_id"), F.col("depth").cast("int"), F.col("loop").alias("on_cycle")]
    looped = named.filter("depth < 0")
    least = looped.filter("loop").groupBy(F.col("root").alias("k")).agg(F.min("node_id").alias("name"))
    rows = tops.unionByName(looped.join(least, F.col("root") == F.col("k")))
    if not with_paths:
        return rows.select(*cols)
    # until the steps are gathered, a loop's node bears its turn in depth: -1 - turn
    kept = F.when(F.col("depth") < 0, F.slice("path", F.col("entry"), F.size("path"))).otherwise(F.col("path"))
    place = F.when(F.col("loop"), -F.col("entry")).otherwise(F.col("depth")).cast("int").alias("depth")
    at = rows.select("type", "node_id", F.col("name").alias("root_id"), place, F.col("loop").alias("on_cycle"), F.posexplode(kept).alias("pos", "s"))
    every = names.unionByName(base.select(F.col("c").alias("k"), F.col("child").alias("name"))).dropDuplicates(["k"])
    return (
        at.join(every.select("k", F.col("name").alias("step_id")), F.col("s") == F.col("k"))
        .groupBy("type", "node_id", "root_id", "depth", "on_cycle")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "step_id"))), lambda x: x["step_id"]).alias("path"))
        .select("type", "node_id", "root_id", F.greatest("depth", F.lit(-1)).alias("depth"), "on_cycle", "path", F.when(F.col("on_cycle"), -1 - F.col("depth")).alias("turn"))
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """All (type, ancestor_id, node_id, distance) of a result with paths.

    The output has one row per node and ancestor, as asked. Every node of a loop is an
    ancestor of all others of the loop and of what hangs below it, once each, at the
    least distance; no node is its own ancestor.
    """
    rows = resolved.select("type", "node_id", F.size("path").alias("n"), F.posexplode("path").alias("pos", "ancestor_id"))
    above = rows.filter("pos < n - 1").select("type", "ancestor_id", "node_id", (F.col("n") - 1 - F.col("pos")).alias("distance"))
    looped = Scratch(resolved.sparkSession, "descendants").save(resolved.filter("depth < 0"), "looped")
    ring = looped.filter("on_cycle").select("type", "root_id", F.col("node_id").alias("ancestor_id"), "turn")
    sizes = ring.groupBy("type", "root_id").agg(F.count("*").alias("size"))
    entries = ring.join(sizes, ["type", "root_id"]).select("type", "root_id", F.col("ancestor_id").alias("entry_id"), F.col("turn").alias("entry_turn"), "size")
    below = looped.select("type", "root_id", "node_id", F.col("path")[0].alias("entry_id"), F.size("path").alias("n"))
    round_ = below.join(entries, ["type", "root_id", "entry_id"]).join(ring, ["type", "root_id"]).filter("ancestor_id != entry_id")
    steps = F.col("n") - 1 + F.pmod(F.col("entry_turn") - F.col("turn"), F.col("size"))
    return above.unionByName(round_.select("type", "ancestor_id", "node_id", steps.cast("int").alias("distance")))
