"""Queries of the text operators, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import docpairs, handwritten, packing, spans, syntax, tokenizing
from graphloom.sources.tables import table


def p1_found(spark, d):
    return syntax.syntax_errors(table(spark, d, "sources")).filter("not valid").select("path").distinct()


def p1_rates(spark, d):
    return syntax.error_rates(syntax.syntax_errors(table(spark, d, "sources")))


def p1_unreliable(spark, d):
    return syntax.unreliable_notes(syntax.syntax_errors(table(spark, d, "sources")), table(spark, d, "files"))


def p4_found(spark, d):
    return handwritten.not_handwritten(table(spark, d, "sources")).select("path")


def p4_reasons(spark, d):
    found = handwritten.not_handwritten(table(spark, d, "sources"))
    return found.groupBy(syntax.repository(F.col("path")).alias("repository"), "reason").agg(F.count("*").alias("n_files"))


def p7_pairs(spark, d):
    nodes = table(spark, d, "nodes", "id", "type", "name", "file_path", "line_start", "line_end", "documentation")
    return docpairs.documented_functions(nodes, table(spark, d, "sources", "path", "text"))


def p7_code(spark, d):
    return p7_pairs(spark, d).select("node_id", "name", "description", "code").distinct()


def p7_found(spark, d):
    return p7_pairs(spark, d).select("node_id").distinct()


def p8_ids(spark, d):
    return tokenizing.encode_documents(table(spark, d, "documents", "doc_id", "text"))


def p8_round_trip(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    back = tokenizing.decode_documents(tokenizing.encode_documents(docs)).select(F.col("doc_id").alias("id"), F.col("text").alias("decoded"))
    same = docs.join(back, F.col("doc_id") == F.col("id")).select(F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded")).alias("same"))
    return same.groupBy("same").agg(F.count("*").alias("n_docs"))


def p9_pack(spark, d):
    return packing.pack_documents(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "containers"))


def p9_fill(spark, d):
    return packing.packing_report(p9_pack(spark, d), table(spark, d, "containers"))


def p9_kept(spark, d):
    docs, kinds = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "containers")
    return packing.packing_faults(packing.pack_documents(docs, kinds), tokenizing.count_tokens(docs), kinds)


def p10_found(spark, d):
    return spans.shared_passages(table(spark, d, "documents", "doc_id", "text")).filter("size(a_runs) > 0").select("doc_a", "doc_b")


def p10_passages(spark, d):
    rows = spans.shared_passages(table(spark, d, "documents", "doc_id", "text")).select("doc_a", "doc_b", F.explode("passages").alias("p"))
    return rows.select("doc_a", "doc_b", "p.a_start", "p.a_end", "p.b_start", "p.b_end", F.round("p.identity", 6).alias("identity"))


def p10_share(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return spans.shared_share(docs, spans.shared_passages(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p1_unreliable, p4_found, p4_reasons, p7_found, p7_pairs, p7_code, p8_ids, p8_round_trip, p9_pack, p9_fill, p9_kept, p10_found, p10_passages, p10_share)}

_TELLING = r"""
WITH docs AS (
  SELECT id, name, file_path, line_start, line_end, json_extract_string(documentation, '$.description') AS description
  FROM (SELECT * FROM nodes WHERE type = 'function' AND json_valid(documentation)) v
  WHERE json_type(documentation, '$.version') IN ('UBIGINT', 'BIGINT') AND json_extract_string(documentation, '$.version') = '1'),
worded AS (
  SELECT *, list_distinct(regexp_extract_all(lower(description), '[\p{L}\p{N}]+')) AS dw,
    list_concat(regexp_extract_all(lower(name), '[\p{L}\p{N}]+'), regexp_extract_all(lower(regexp_replace(name, '([A-Z])', ' \1', 'g')), '[\p{L}\p{N}]+')) AS nw
  FROM docs WHERE description IS NOT NULL),
lined AS (SELECT path, any_value(string_split(text, chr(10))) AS lines FROM sources WHERE text IS NOT NULL GROUP BY path),
found AS (
  SELECT DISTINCT w.id AS node_id, w.name, w.description, array_to_string(l.lines[w.line_start:w.line_end], chr(10)) AS code
  FROM worded w JOIN lined l ON l.path = w.file_path
  WHERE len(list_filter(dw, lambda x: NOT list_contains(nw, x))) >= 3 AND line_start >= 1 AND line_start <= line_end AND line_end <= len(l.lines))
"""

_WINDOWS = """
WITH texts AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200 AND doc_id IS NOT NULL),
windows AS (SELECT doc_id, CAST(i AS INTEGER) AS i, hash(substring(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM texts) t),
common AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
met AS (SELECT w.* FROM windows w JOIN common USING (h))
"""

ORACLES = {
    "p7_found": f"{_TELLING} SELECT DISTINCT node_id FROM found",
    "p7_code": f"{_TELLING} SELECT DISTINCT node_id, name, description, code FROM found",
    "p9_kept": """SELECT container_kind, CAST((SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS BIGINT) AS n_docs, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS divided
FROM (SELECT DISTINCT container_kind FROM containers WHERE container_kind IS NOT NULL AND capacity_tokens > 0) k""",
    "p10_found": f"{_WINDOWS} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM met a JOIN met b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_share": f"""{_WINDOWS},
starts AS (SELECT DISTINCT doc_id, i FROM met),
fresh AS (SELECT doc_id, least(200, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -200)) AS n FROM starts),
pairs AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM met a JOIN met b ON a.h = b.h AND a.doc_id <> b.doc_id)
SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS INTEGER) AS n_chars, CAST(coalesce(s.n, 0) AS BIGINT) AS shared_chars, CAST(coalesce(p.n, 0) AS BIGINT) AS n_partners
FROM documents d LEFT JOIN (SELECT doc_id, sum(n) AS n FROM fresh GROUP BY doc_id) s USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS n FROM pairs GROUP BY x) p USING (doc_id)
WHERE d.doc_id IS NOT NULL""",
    "p8_round_trip": "SELECT true AS same, count(*) AS n_docs FROM documents HAVING count(*) > 0",
}
