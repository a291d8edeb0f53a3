"""From a name a user typed to nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import fold


def _least_tier(rows: DataFrame) -> DataFrame:
    """The rows of the least tier, with how many they are; only one row is broadcast."""
    sizes = rows.filter("tier is not null").groupBy("tier").agg(F.count("*").alias("n"))
    best = sizes.agg(F.min(F.struct("tier", "n")).alias("b")).select(F.col("b.tier").alias("best"), F.col("b.n").alias("n"))
    return rows.crossJoin(F.broadcast(best)).filter("tier = best")


def resolve_node(nodes: DataFrame, wanted: str) -> DataFrame:
    """Matches of the best kind: id exactly, else name, else a part of a name.

    Columns id, type, name, tier (0, 1 or 2), verdict (``single`` or ``ambiguous``).
    Names compare without regard to ASCII case. No match gives an empty result, a
    null name matches nothing, an empty string every name as a part.
    """
    name, text = fold(F.col("name")), fold(F.lit(wanted))
    tier = F.when(F.col("id") == wanted, 0).when(name == text, 1).when(name.contains(text), 2)
    rows = _least_tier(nodes.select("id", "type", "name", tier.alias("tier")))
    return rows.select("id", "type", "name", "tier", F.when((F.col("n") > 1) & (F.col("tier") > 0), "ambiguous").otherwise("single").alias("verdict"))


def resolve_root(nodes: DataFrame, target: str, root: str = "") -> DataFrame:
    """The root of an impact walk: id, type, name, tier.

    Tiers: 0 the file at that path, 1 ``type:name`` exactly, 2 to 4 as resolve_node.
    A text that looks like a path and names no known file is a file of its own, as a
    synthetic row of tier 0.
    """
    path = target if target.startswith("/") else f"{root.rstrip('/')}/{target.removeprefix('./')}"
    looks = "/" in target or target.rsplit(".", 1)[-1] in ("ts", "tsx", "js", "jsx", "mjs", "py", "json")
    kind, _, rest = target.partition(":")
    name, text = fold(F.col("name")), fold(F.lit(target))
    tier = F.when((F.col("type") == "file") & (F.col("file_path") == path), 0).when((F.col("type") == kind) & (F.col("name") == rest), 1).when(F.col("id") == target, 2).when(name == text, 3).when(name.contains(text), 4)
    rows = nodes.select("id", "type", "name", tier.alias("tier"))
    if looks:
        own = nodes.sparkSession.createDataFrame([(f"file:{path}", "file", path.rsplit("/", 1)[-1], 0)], "id string, type string, name string, tier int")
        known = rows.filter("tier = 0")
        return known.unionByName(own.join(known.select("tier").distinct(), "tier", "left_anti"))
    return _least_tier(rows).select("id", "type", "name", "tier")
