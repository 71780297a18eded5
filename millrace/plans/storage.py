"""Queries on sources, sinks, catalogs and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import cleaning as cl
from millrace.operators import catalog
from millrace.plans import lexical as lx
from millrace.plans import sqltext as sq
from millrace.sources import readers, sinks
from millrace.streaming import batches
from millrace.session import table

TABLES = ("documents", "quora_docs", "quora_queries", "qrels", "search_results", "doc_vectors")


def last_wins_hits(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "search_results").select("id", "query_id", "doc_id", "rank", "similarity_score")
    return sinks.last_wins(t, ["query_id", "doc_id"], "id").select("query_id", "doc_id", "id", "rank")


def upsert_judgments(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "qrels").select("id", "query_id", "doc_id", "relevance").filter("doc_id IS NOT NULL")
    old = sinks.last_wins(t.filter("relevance <= 0"), ["query_id", "doc_id"], "id")
    return sinks.upsert(old, t.filter("relevance > 0"), ["query_id", "doc_id"], "id")


def batch_stats(spark: SparkSession, d: str) -> DataFrame:
    return sinks.batch_stats(table(spark, d, "documents"), "source")


def column_added(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "title")
    new = t.filter("title IS NOT NULL").select("doc_id", cl.clean("title", cl.safe()).alias("processed_text"))
    return sinks.set_column(t, "doc_id", "processed_text", new)


def dataset_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.dataset_catalog(table(spark, d, "documents").select("doc_id", "lang"), "lang", table(spark, d, "doc_vectors"))


def database_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.database_stats({n: table(spark, d, n) for n in TABLES})


def text_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.text_stats(table(spark, d, "quora_docs"), "doc_id", "text").withColumn("mean_chars", F.round("mean_chars", 6))


def index_validation(spark: SparkSession, d: str) -> DataFrame:
    docs, model, w = lx._fitted(spark, d, lx.DEFAULT)
    return catalog.validate_index(w, model.vocabulary, docs)


def fields_normalised(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    fields = F.map_filter(F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("body"), F.col("text"), F.lit("title"), F.col("title")), lambda k, v: v.isNotNull())
    n = readers.normalise(t.select(fields.alias("fields"), F.col("doc_id").alias("position")))
    return n.select("id", "text", F.try_element_at("metadata", F.lit("title")).alias("title"))


def documents_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.scan(table(spark, d, "documents"), not_null="text", order="doc_id", columns=("doc_id", "n_chars"))


def document_positions(spark: SparkSession, d: str) -> DataFrame:
    return readers.positions(table(spark, d, "documents").select("doc_id"), "doc_id")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return batches.sessions(table(spark, d, "events"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return batches.counts_by_window(table(spark, d, "events"))


FUNCTIONS = (
    last_wins_hits, upsert_judgments, batch_stats, column_added, dataset_catalog, database_stats, text_stats, index_validation, fields_normalised, documents_scan,
    document_positions, event_sessions, event_windows,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_STRIPPED = sq.clean("text", [("strip",)])
_NOT_EMPTY = f"coalesce(text, '') NOT IN ('', '0', 'false') AND {_STRIPPED} <> ''"
SQL = {
    "last_wins_hits": "SELECT query_id, doc_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY id DESC) AS n FROM search_results) WHERE n = 1",
    "upsert_judgments": """WITH t AS (SELECT id, query_id, doc_id, relevance FROM qrels WHERE doc_id IS NOT NULL),
o AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY id DESC) AS n FROM t WHERE relevance <= 0) WHERE n = 1),
b AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY id DESC) AS n FROM t WHERE relevance > 0) WHERE n = 1)
SELECT * FROM b UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = o.query_id AND b.doc_id = o.doc_id)""",
    "batch_stats": "SELECT source AS name, count(*) AS document_count FROM documents GROUP BY 1",
    "column_added": f"SELECT doc_id, title, CASE WHEN title IS NULL THEN NULL ELSE {sq.clean('title', cl.safe())} END AS processed_text FROM documents",
    "dataset_catalog": "SELECT lang AS dataset, count(*) AS document_count, count(*) FILTER (i) AS indexed_count, count(*) FILTER (i) > 0 AS indexed FROM (SELECT lang, doc_id IN (SELECT doc_id FROM doc_vectors) AS i FROM documents) GROUP BY 1",
    "database_stats": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLES),
    "text_stats": """SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, count(text) AS n_texts, count(*) FILTER (coalesce(trim(text), '') = '') AS n_blank,
 round(avg(length(text)), 6) AS mean_chars, max(length(text)) AS max_chars, min(length(text)) AS min_chars FROM quora_docs""",
    "index_validation": f"""WITH {sq.tfidf(lx.DEFAULT)} SELECT (SELECT count(DISTINCT term) FROM w) AS n_terms, (SELECT count(*) FROM v) AS n_vocabulary, (SELECT count(DISTINCT doc_id) FROM w) AS n_indexed,
 (SELECT n FROM nd) AS n_docs, 0 AS unknown_terms, 0 AS unknown_docs, 0 AS off_length, TRUE AS ok""",
    "fields_normalised": f"SELECT CAST(doc_id AS VARCHAR) AS id, {_STRIPPED} AS text, title FROM documents WHERE {_NOT_EMPTY}",
    "documents_scan": "SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL",
    "document_positions": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n_events FROM s GROUP BY user_id, k""",
    "event_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n_events FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
