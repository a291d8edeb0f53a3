"""A stored inverted index over the text of nodes, and phrase search through it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.search import TEXT_COLUMNS, ranked, tokens
from graphloom.workspace import Scratch


def postings(nodes: DataFrame) -> DataFrame:
    """Where each token stands: token, id, col (number of the text column), pos. Null and empty texts give none."""
    own = [F.struct(F.lit(n).alias("col"), F.filter(F.split(tokens(F.col(c)), " "), lambda x: x != "").alias("words")) for n, c in enumerate(TEXT_COLUMNS)]
    each = nodes.select("id", F.explode(F.array(*own)).alias("t"))
    return each.select("id", "t.col", F.posexplode("t.words").alias("pos", "token")).select("token", "id", "col", "pos")


class SearchIndex:
    """Postings sorted by token, and the number of tokens of each node.

    A search reads only the row groups that hold its words; a change of some nodes
    replaces their postings and leaves the rest as they are.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame, lengths: DataFrame) -> None:
        scratch = Scratch(spark, "index")
        self.spark = spark
        self.postings = scratch.save(rows.repartitionByRange("token", "id").sortWithinPartitions("token", "id"), "postings")
        self.lengths = scratch.save(lengths, "lengths")
        self.corpus = scratch.save(self.lengths.agg(F.count("*").alias("all"), F.avg("len").alias("avg_len")), "corpus")

    @classmethod
    def build(cls, nodes: DataFrame) -> SearchIndex:
        """The index of nodes with distinct ids."""
        rows = Scratch(nodes.sparkSession, "index").save(postings(nodes), "raw")
        counted = rows.groupBy("id").agg(F.count("*").alias("len"))
        lengths = nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("len", F.lit(0)).alias("len"))
        return cls(nodes.sparkSession, rows, lengths)

    def replaced(self, gone: DataFrame, fresh: DataFrame) -> SearchIndex:
        """The index after nodes (column id) went and others came; a changed node is in both."""
        new = SearchIndex.build(fresh)
        out = gone.select("id").unionByName(fresh.select("id")).distinct()
        return SearchIndex(self.spark, self.postings.join(out, "id", "left_anti").select("token", "id", "col", "pos").unionByName(new.postings), self.lengths.join(out, "id", "left_anti").unionByName(new.lengths))

    def hits(self, words: list[str]) -> DataFrame:
        """How often the words stand in a row in one column, the last as a prefix: id, f."""
        found = None
        for n, w in enumerate(words):
            match = F.col("token").startswith(w) if n == len(words) - 1 else F.col("token") == w
            own = self.postings.filter(match).select("id", "col", (F.col("pos") - n).alias("start"))
            found = own if found is None else found.join(own, ["id", "col", "start"])
        return found.groupBy("id").agg(F.count("*").alias("f"))


def indexed_search(index: SearchIndex, nodes: DataFrame, keyword: str, node_type: str | None = None, inner: int = 50, most: int = 20) -> DataFrame:
    """phrase_search with the same result, by the postings of the keyword's words."""
    words = "".join(ch if ch.isalnum() else " " for ch in keyword.lower()).split()
    if not words:
        return nodes.limit(0).select("id", "type", "name", F.lit(0).alias("bucket"), F.lit(0.0).alias("score"))
    hits = Scratch(index.spark, "hits").save(index.hits(words), "hits")
    corpus = index.corpus.crossJoin(F.broadcast(hits.agg(F.count("*").alias("with"))))
    rows = nodes.select("id", "type", "name", "file_path", "summary").join(hits, "id").join(index.lengths, "id")
    return ranked(rows, corpus, keyword, node_type, inner, most)
