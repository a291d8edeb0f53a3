"""Keyword search: substring search and ranked phrase-prefix search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import fold

TEXT_COLUMNS = ["id", "name", "file_path", "summary", "documentation", "tags"]


def like_search(nodes: DataFrame, keyword: str, node_type: str | None = None, most: int = 20) -> DataFrame:
    """Nodes with the keyword in name, summary, tags or documentation, by type and name.

    Compared without regard to ASCII case; % and _ in the keyword are wild.
    """
    word = F.lit("%" + keyword + "%")
    hit = F.lit(False)
    for c in ("name", "summary", "tags", "documentation"):
        hit = hit | F.coalesce(F.call_function("like", fold(F.col(c)), fold(word)), F.lit(False))
    rows = nodes.filter(hit)
    if node_type:
        rows = rows.filter(F.col("type") == node_type)
    return rows.select("id", "type", "name", "file_path").orderBy("type", "name", "id").limit(most)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, as one text with single blanks around each."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.concat(F.lit(" "), F.trim(plain), F.lit(" "))


def phrase_search(nodes: DataFrame, keyword: str, node_type: str | None = None, inner: int = 50, most: int = 20) -> DataFrame:
    """Nodes with the keyword's tokens in a row in one column, the last as a prefix.

    Ranked by BM25 (k1 1.2, b 0.75, over all columns), the best ``inner`` are put
    into buckets (name equals, path contains, summary contains, rest) and the first
    ``most`` come out: id, type, name, bucket, score. A keyword without letters or
    digits finds nothing.

    A row's tokens are counted where it is read; only the three corpus totals are
    broadcast, and the two top lists are ordered limits.
    """
    words = [w for w in "".join(ch if ch.isalnum() else " " for ch in keyword.lower()).split()]
    if not words:
        return nodes.limit(0).select("id", "type", "name", F.lit(0).alias("bucket"), F.lit(0.0).alias("score"))
    # an overlapping count: each token boundary is kept by doubling the blanks
    spaced = [F.regexp_replace(tokens(F.col(c)), " ", "  ") for c in TEXT_COLUMNS]
    phrase = " " + "  ".join(words)
    hits = sum((F.expr("0"), *[F.regexp_count(s, F.lit(f"(?={phrase})")) for s in spaced]), F.lit(0))
    length = sum((*[F.size(F.filter(F.split(s, " "), lambda x: x != "")) for s in spaced],), F.lit(0))
    rows = nodes.select("id", "type", "name", "file_path", "summary", hits.alias("f"), length.alias("len"))
    corpus = rows.agg(F.count("*").alias("all"), F.avg("len").alias("avg_len"), F.count_if(F.col("f") > 0).alias("with"))
    return ranked(rows.filter("f > 0"), corpus, keyword, node_type, inner, most)


def ranked(rows: DataFrame, corpus: DataFrame, keyword: str, node_type: str | None, inner: int, most: int) -> DataFrame:
    """The top list of matching rows (id, type, name, file_path, summary, f, len) of a corpus (all, avg_len, with; one row)."""
    if node_type:
        rows = rows.filter(F.col("type") == node_type)
    idf = F.greatest(F.log((F.col("all") - F.col("with") + 0.5) / (F.col("with") + 0.5)), F.lit(1e-6))
    norm = F.col("f") + 1.2 * (1 - 0.75 + 0.75 * F.col("len") / F.col("avg_len"))
    scored = rows.crossJoin(F.broadcast(corpus)).withColumn("score", F.round(idf * F.col("f") * 2.2 / norm, 9))
    best = scored.orderBy(F.desc("score"), "id").limit(inner)
    word = keyword.lower()
    bucket = F.when(F.lower("name") == word, 0).when(F.lower("file_path").contains(word), 1).when(F.lower(F.coalesce("summary", F.lit(""))).contains(word), 2).otherwise(3)
    return best.select("id", "type", "name", bucket.alias("bucket"), "score").orderBy("bucket", F.desc("score"), "id").limit(most)


def search(nodes: DataFrame, keyword: str, node_type: str | None = None, most: int = 20) -> DataFrame:
    """Ranked search, or substring search where that finds nothing: id, type, name."""
    ranked = phrase_search(nodes, keyword, node_type, most=most).select("id", "type", "name")
    return ranked if not ranked.isEmpty() else like_search(nodes, keyword, node_type, most).select("id", "type", "name")
