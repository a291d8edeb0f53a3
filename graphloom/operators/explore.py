"""What the graph knows about a keyword, in one report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.traverse import explore_relationships
from graphloom.sources.project import snippets


def explore_report(nodes: DataFrame, edges: DataFrame, matches: DataFrame, sources: DataFrame, stale: DataFrame, fanout: int = 50, most_snippets: int = 10) -> DataFrame:
    """Matches with their relationships, code and freshness: section, pos, id, way, edge_type, other, value.

    matches (id, type, name, in order of a column pos) are a top list, so all sections
    are bounded. match: value is type:name; out and in: the far end as other, its
    type:name as value; snippet: the first lines of the first distinct matches and
    far ends that have a text, each node once; stale: matches whose file is in stale
    (path, reason), value is the reason.
    """
    blank = F.lit(None).cast("string")
    own = matches.select("pos", "id").join(nodes.select("id", "type", "name", "file_path"), "id")
    label = lambda t, n: F.concat_ws(":", t, n)
    first = own.select(F.lit("match").alias("section"), "pos", "id", blank.alias("way"), blank.alias("edge_type"), blank.alias("other"), label("type", "name").alias("value"))
    links = explore_relationships(nodes, edges, matches, fanout)
    second = links.select(F.lit("relationship").alias("section"), F.col("nth").alias("pos"), "id", "way", "edge_type", "other", label("other_type", "other_name").alias("value"))
    ends = own.select("id", F.lit(0).alias("rank"), "pos").unionByName(links.select(F.col("other").alias("id"), F.lit(1).alias("rank"), F.col("nth").alias("pos")))
    wanted = ends.groupBy("id").agg(F.min(F.struct("rank", "pos")).alias("r"))  # a node that is met twice gives one snippet
    code = snippets(nodes.join(wanted.select("id"), "id", "left_semi"), sources).join(wanted, "id")
    best = code.withColumn("pos", F.row_number().over(Window.orderBy("r", "id"))).filter(F.col("pos") <= most_snippets)
    third = best.select(F.lit("snippet").alias("section"), "pos", "id", blank.alias("way"), blank.alias("edge_type"), blank.alias("other"), F.col("code").alias("value"))
    old = own.join(stale.select(F.col("path").alias("file_path"), "reason"), "file_path")
    fourth = old.select(F.lit("stale").alias("section"), "pos", "id", blank.alias("way"), blank.alias("edge_type"), F.col("file_path").alias("other"), F.col("reason").alias("value"))
    return first.unionByName(second).unionByName(third).unionByName(fourth)
