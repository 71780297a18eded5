"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import whole_number
from millrace.llm import langid
from millrace.llm.bpe import count_tokens, encode_corpus
from millrace.llm.components import connected_components, label_by_least
from millrace.llm.crosspolytope import most_similar, similar_pairs
from millrace.llm.foldhash import collapse_copies
from millrace.llm.mixture import Mixture
from millrace.llm.setsketch import NearDuplicates
from millrace.llm.topn import top_n_per_group
from millrace.session import spread, table


#: Makes every BIGINT a number of at most 20 digits that is not negative.
SHIFT = str(1 << 63)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "quora_docs").select(F.col("doc_id").alias("key"), "text")
    return docs.unionAll(table(spark, d, "quora_queries").select(F.col("query_id").alias("key"), "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(_questions(spark, d), "key", "text").key_pairs()


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(_questions(spark, d), "key", "text").classes()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse_copies(spread(table(spark, d, "quora_docs").select("doc_id", "text")), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # Documents sort before queries and by number, so that text order is number order.
    number = F.lpad((whole_number("doc_id").cast("decimal(20,0)") + F.lit(SHIFT).cast("decimal(20,0)")).cast("string"), 20, "0")
    links = table(spark, d, "qrels").filter("relevance >= 1").select(F.concat(F.lit("1"), "query_id").alias("q"), F.concat(F.lit("0"), number).alias("d"))
    found = connected_components(links, "q", "d")
    is_doc = F.col("record").startswith("0")
    value = (F.substring("record", 2, 20).try_cast("decimal(20,0)") - F.lit(SHIFT).cast("decimal(20,0)")).cast("bigint")
    found = found.withColumn("value", F.when(is_doc, value))
    labels = label_by_least(found, "value")
    return labels.select(F.when(is_doc, value.cast("string")).otherwise(F.expr("substring(record, 2)")).alias("record"), F.col("label").alias("group_doc"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_results").select("query_id", whole_number("doc_id").alias("doc_id"), "similarity_score", "rank")
    hits = hits.filter(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    order = [("similarity_score", "desc"), ("rank", "asc")]
    return top_n_per_group(hits, "query_id", "doc_id", order, 10, within=table(spark, d, "qrels")).select("query_id", "doc_id")


def p6_similar(spark: SparkSession, d: str) -> DataFrame:
    n = most_similar(table(spark, d, "doc_vectors"), "doc_id", "vector", least=None)
    return n.select(F.col("id").alias("doc_id"), F.col("neighbour").alias("similar_doc_id"), F.col("similarity").alias("similarity_score"), F.col("place").alias("rank"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_pairs(most_similar(table(spark, d, "doc_vectors"), "doc_id", "vector"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def _mixture(spark: SparkSession, d: str) -> Mixture:
    sized = count_tokens(spread(table(spark, d, "documents").select("doc_id", "source", "text")), ["doc_id", "source"], "text")
    return Mixture(sized, table(spark, d, "mix_targets"), "doc_id", "source", of_corpus=0.5, weight="n_tokens")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).documents().withColumnRenamed("key", "doc_id")


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """For each target whether its repeats are kept and its share is kept.

    That is: it reaches its share of the wanted total to a tenth of a percent of that total, or all its documents are used as
    often as they may, or it has fewer than 100 documents and lacks less than the largest of them.
    """
    s = _mixture(spark, d).shares().filter("target_share > 0")
    near = F.abs(F.col("share_of_wanted") - F.col("target_share")) <= 0.001
    coarse = (F.col("n_docs") < 100) & (F.col("lacking") >= 0) & (F.col("lacking") < F.col("largest"))
    return s.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"), (near | coarse | (F.col("tokens") == F.col("have") * F.col("max_repeats"))).alias("share_kept"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def _documents_and_model(spark: SparkSession, d: str):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang"))
    return docs, langid.fit(docs, "doc_id", "text", "lang")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(*_documents_and_model(spark, d), "doc_id", "text", "lang")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(*_documents_and_model(spark, d), "doc_id", "text")


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.segment_languages(*_documents_and_model(spark, d), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p3_found, p4_found, p5_found, p6_found, p6_similar, p7_ids, p8_mixture, p8_shares, p8_kept, p9_found, p9_documents, p9_segments)}

_NUMBER = r"TRY_CAST(trim(doc_id, E' \t\r\n\x0b\x0c') AS DECIMAL(38,6))"

_PAIRS = r"""
WITH t AS (SELECT DISTINCT doc_id AS k, text FROM quora_docs WHERE text IS NOT NULL UNION SELECT query_id, text FROM quora_queries WHERE text IS NOT NULL),
w AS (SELECT k, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS ws FROM t),
s AS (SELECT k, ws, len(ws) AS n FROM w WHERE len(ws) >= 5),
u AS (SELECT k, n, unnest(ws) AS word FROM s),
c AS (SELECT a.k AS key_a, b.k AS key_b, count(*) AS common, any_value(greatest(a.n, b.n)) AS n FROM u a JOIN u b ON a.word = b.word AND a.k < b.k GROUP BY 1, 2),
pairs AS (SELECT key_a, key_b FROM c WHERE 10 * common >= 7 * n)
"""

SQL = {
    "p1_found": _PAIRS + "SELECT key_a, key_b FROM pairs",
    "p1_classes": _PAIRS + """
, ends AS (SELECT key_a AS k FROM pairs UNION ALL SELECT key_b FROM pairs), links AS (SELECT k, count(*) AS n FROM ends GROUP BY k),
c0 AS (SELECT k, min(k) OVER (PARTITION BY list_sort(ws)) AS class_key FROM s)
SELECT c0.k AS key, class_key, coalesce(links.n, 0) AS n_links FROM c0 LEFT JOIN links ON links.k = c0.k
""",
    "p3_found": r"""
WITH t AS (SELECT DISTINCT doc_id, text FROM quora_docs WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM t),
ok AS (SELECT * FROM w WHERE len(list_distinct(ws)) >= 5),
f AS (SELECT doc_id, text, ws, regexp_matches(lower(text), '^[^\p{L}\p{N}]*(title|topic|body)\s*[:=]') AS rec FROM ok),
g AS (SELECT doc_id, ws, CASE WHEN rec THEN list_sort(list_transform(
    regexp_extract_all(regexp_replace(lower(text), '(^|[^\p{L}\p{N}])(title|topic|body)\s*[:=]', chr(1) || '\2 ', 'g'), '[\x01][^\x01]*'),
    lambda x: array_to_string(regexp_extract_all(x, '[\p{L}\p{N}]+'), ' '))) END AS form FROM f),
r AS (SELECT ws, min(form) AS form FROM g WHERE form IS NOT NULL GROUP BY ws),
k AS (SELECT g.doc_id, CASE WHEN coalesce(g.form, r.form) IS NULL THEN array_to_string(g.ws, ' ') ELSE chr(2) || array_to_string(coalesce(g.form, r.form), chr(1)) END AS k
  FROM g LEFT JOIN r ON g.ws = r.ws)
SELECT min(doc_id) AS doc_id, count(DISTINCT doc_id) AS n_copies FROM k GROUP BY k HAVING count(DISTINCT doc_id) > 1
""",
    "p4_found": f"""
WITH RECURSIVE links AS (
  SELECT DISTINCT 'q' || query_id AS q, 'd' || CAST(CAST({_NUMBER} AS BIGINT) AS VARCHAR) AS d FROM qrels
  WHERE relevance >= 1 AND {_NUMBER} IS NOT NULL AND query_id IS NOT NULL
), arcs AS (SELECT q AS a, d AS b FROM links UNION SELECT d, q FROM links),
reach AS (SELECT a AS start, a AS spot FROM arcs UNION SELECT r.start, arcs.b FROM reach r JOIN arcs ON arcs.a = r.spot)
SELECT substr(start, 2) AS record, min(CAST(substr(spot, 2) AS BIGINT)) AS group_doc FROM reach WHERE spot LIKE 'd%' GROUP BY start
""",
    "p8_kept": """
SELECT DISTINCT regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') AS source, true AS repeats_kept, true AS share_kept FROM mix_targets WHERE target_share > 0
""",
    "p6_found": """
WITH u AS (SELECT doc_id, min(vector) AS v FROM doc_vectors WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY doc_id),
n AS (SELECT doc_id, v::DOUBLE[] AS v FROM u),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM n a JOIN n b ON a.doc_id <> b.doc_id),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS place FROM p)
SELECT DISTINCT least(a, b) AS doc_id_a, greatest(a, b) AS doc_id_b FROM r WHERE place <= 5 AND c >= 0.9
""",
    "p5_found": f"""
WITH h AS (SELECT query_id, CAST({_NUMBER} AS BIGINT) AS doc_id, similarity_score AS s, rank AS r FROM search_results
  WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) AND {_NUMBER} IS NOT NULL AND query_id IN (SELECT query_id FROM qrels)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY s DESC, r ASC NULLS LAST) AS k FROM h),
t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r ASC NULLS LAST, doc_id) AS n FROM b WHERE k = 1)
SELECT query_id, doc_id FROM t WHERE n <= 10
""",
}
