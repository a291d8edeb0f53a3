"""Filling containers of fixed capacity with documents."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.binpacking import evolve
from graphloom.llm.tokenizing import BYTE_BPE_50K, count_tokens
from graphloom.workspace import Scratch

_OUT = "container_kind string, capacity int, shard bigint, island int, bin int, item_id bigint, doc_id bigint, part int, tokens int"


def _island(generations: int, population: int):
    """The step of one island: evolve its items from the packings that came to it, if any."""

    def run(rows: pa.Table) -> pa.Table:
        # one row per item and packing; items in the order of their ids, packings in that of their islands
        own = rows["island"].to_numpy()
        islands = np.unique(own)
        order = np.lexsort((rows["item_id"].to_numpy(), own))
        items = rows.take(order[: len(order) // len(islands)])
        sizes, (capacity, shard, home) = items["tokens"].to_pylist(), (items[c][0].as_py() for c in ("capacity", "shard", "home"))
        start = []
        for bins in np.split(rows["bin"].to_numpy()[order], len(islands)):
            if bins[0] >= 0:
                members = np.argsort(bins, kind="stable")
                start.append([m.tolist() for m in np.split(members, np.flatnonzero(np.diff(bins[members])) + 1)])
        best = evolve(sizes, capacity, start, shard * 31 + home, generations, max(population, len(start)))
        where = np.empty(len(items), np.int32)
        where[list(chain.from_iterable(best))] = np.repeat(np.arange(len(best), dtype=np.int32), [len(members) for members in best])
        new = {"bin": pa.array(where), "island": pa.array(np.full(len(items), home, np.int32))}
        return pa.table({c: new[c] if c in new else items[c] for c in (c.split()[0] for c in _OUT.split(", "))})

    return run


def pack_documents(documents: DataFrame, containers: DataFrame, vocabulary: str = BYTE_BPE_50K, shard_items: int = 2000, islands: int = 2, migrations: int = 2, generations: int = 6, population: int = 4, closed: float = 0.97) -> DataFrame:
    """Every document in containers of each kind: who is in which container.

    Columns: container_kind, container_id string, doc_id, part int (from 0), tokens
    int. The tokens of a container sum to its capacity at most. A document is
    divided only if it is longer than the capacity, then into full containers and
    one rest; documents without tokens (null or empty text) take no room and stand
    in the container named kind/empty. Rows with a repeated doc_id count as parts
    of their own; rows without doc_id and containers with a null or non-positive
    capacity are left out; containers of the same kind and capacity count once.
    Empty tables give an empty result.

    Grouping genetic algorithm on islands: items are spread over shards of about
    shard_items; of each shard several islands evolve a packing (crossover injects
    whole well-filled bins, removes duplicates and best-fits what is displaced).
    Then their elites migrate to one place, where crossover among them goes on. Bins
    filled to the share ``closed`` are final; the items of all others migrate to a
    fewer shards and are evolved again, level after level, until one shard holds
    them or a level no longer halves the number of shards. Sizes are counted once; only ids and sizes are shuffled; a
    group never exceeds a shard, whatever the number of documents.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    counted = scratch.save(count_tokens(documents.filter("doc_id is not null"), vocabulary), "sizes")
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity")).filter("container_kind is not null and capacity > 0").distinct()
    each = counted.crossJoin(F.broadcast(kinds))  # the kinds are a fixed, small parameter table
    item = F.xxhash64("container_kind", "doc_id", "copy", "part")
    whole = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int"))).alias("part")
    repeats = counted.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    each = each.withColumn("copy", F.monotonically_increasing_id() if repeats else F.lit(0))
    parts = each.filter("n_tokens > 0").select("*", whole).withColumn("tokens", F.least(F.col("capacity"), F.col("n_tokens") - F.col("part") * F.col("capacity")).cast("int"))
    parts = scratch.save(parts.select("container_kind", "capacity", "doc_id", "part", "tokens", item.alias("item_id")), "parts")
    id_of = F.concat_ws("/", "container_kind", "level", F.hex("shard"), "bin")
    out = ["container_kind", id_of.alias("container_id"), "doc_id", "part", "tokens"]
    full = parts.filter("tokens = capacity").select("container_kind", F.concat_ws("/", "container_kind", F.lit("full"), F.hex("item_id")).alias("container_id"), "doc_id", "part", "tokens")
    empty = each.filter("n_tokens = 0").select("container_kind", F.concat_ws("/", "container_kind", F.lit("empty")).alias("container_id"), "doc_id", F.lit(0).alias("part"), F.lit(0).alias("tokens"))
    loose, level, found = parts.filter("tokens < capacity"), 0, [full, empty]
    shards: dict[str, int] = {}
    cols = [c.split()[0] for c in _OUT.split(", ")]
    keys = ["container_kind", "capacity", "shard", "bin"]
    while True:
        left = {r["container_kind"]: -(-r["count"] // shard_items) for r in loose.groupBy("container_kind").count().collect()}
        # a kind whose open items would not fit half as many shards gains nothing from another level
        shards = {k: n for k, n in left.items() if not level or n <= shards[k] // 2}
        if level:
            over = F.col("container_kind").isin(list(shards))
            found.append(rest.filter(~over).withColumn("level", F.lit(level)).select(*out))
            loose = loose.filter(over)
        if not shards:
            break
        level += 1
        count = F.create_map(*[F.lit(x) for kn in shards.items() for x in kn])
        spread = F.pmod(F.xxhash64("item_id", F.lit(level)), count[F.col("container_kind")])
        seeds = loose.withColumn("shard", spread).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("bin", F.lit(-1))
        groups = ["container_kind", "capacity", "shard", "home"]
        step = lambda rows, home: rows.withColumn("home", home).groupBy(*groups).applyInArrow(_island(generations, population), _OUT)
        elites = step(seeds.select(*cols), F.col("island"))
        for _ in range(migrations - 1):
            elites = step(elites, F.explode(F.array("island", (F.col("island") + 1) % islands)))
        packed = step(elites, F.lit(-1))
        packed = scratch.save(packed, "packed")
        last = count[F.col("container_kind")] == 1
        fill = packed.groupBy(*keys).agg(F.sum("tokens").alias("used"))
        open_bins = fill.filter(~last & (F.col("used") < F.col("capacity") * closed)).select(*keys)
        found.append(packed.join(open_bins, keys, "left_anti").withColumn("level", F.lit(level)).select(*out))
        rest = packed.join(open_bins, keys, "left_semi")
        loose = rest.select("container_kind", "capacity", "doc_id", "part", "tokens", "item_id")
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result


def packing_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: container_kind, n_containers, tokens, least_possible, fill."""
    rooms = containers.select("container_kind", F.col("capacity_tokens").alias("capacity")).distinct()
    used = packed.filter("tokens > 0").groupBy("container_kind").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(rooms), "container_kind").select(
        "container_kind", "n_containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_possible"), F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity")), 4).alias("fill")
    )


def packing_faults(packed: DataFrame, counted: DataFrame, containers: DataFrame) -> DataFrame:
    """What a packing lost or broke, per kind: container_kind, n_docs, lost, overfull, divided.

    n_docs is the number of distinct documents placed, lost those whose parts do not
    sum to their tokens, overfull the containers above capacity, divided the
    documents in several parts that would fit one container.
    """
    rooms = F.broadcast(containers.select("container_kind", F.col("capacity_tokens").alias("capacity")).filter("container_kind is not null and capacity > 0").distinct())
    wanted = counted.filter("doc_id is not null").groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest"), F.count("*").alias("copies"))
    parts = packed.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"))
    both = wanted.crossJoin(rooms).join(parts, ["container_kind", "doc_id"], "left")
    placed = F.col("tokens").eqNullSafe(F.col("n_tokens"))
    cut = (F.col("parts") > F.col("copies")) & (F.col("longest") <= F.col("capacity"))
    docs = both.groupBy("container_kind").agg(F.count("parts").alias("n_docs"), F.count_if(~placed).alias("lost"), F.count_if(cut).alias("divided"))
    used = packed.filter("tokens > 0").groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("used")).join(rooms, "container_kind")
    over = used.groupBy("container_kind").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"))
    return docs.join(over, "container_kind", "left").select("container_kind", "n_docs", "lost", F.coalesce("overfull", F.lit(0)).alias("overfull"), "divided")
