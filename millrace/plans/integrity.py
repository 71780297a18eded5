"""Queries on referential integrity (problem 2) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import stripped, whole_number
from millrace.operators.references import orphan_references, orphan_report
from millrace.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = None
    for name in ("qrels", "search_results"):
        t = table(spark, d, name).select(
            F.lit(name).alias("ref_table"),
            F.col("id").alias("ref_id"),
            F.nullif(stripped("doc_id"), F.lit("")).alias("written"),
            F.col("created_at").alias("ref_at"),
        )
        refs = t if refs is None else refs.unionByName(t)
    # What is no whole number names no document: of the key's two columns, whether it is a number and which, no document
    # has the first false.
    refs = refs.withColumn("doc", whole_number("written"))
    refs = refs.select("ref_table", "ref_id", "ref_at", F.when(F.col("written").isNotNull(), F.col("doc").isNotNull()).alias("is_number"), F.when(F.col("written").isNotNull(), F.coalesce("doc", F.lit(0))).alias("doc"))
    documents = table(spark, d, "documents").select(F.lit(True).alias("numbered"), "doc_id", "created_at", "deleted_at")
    return orphan_references(refs, documents, [("is_number", "numbered"), ("doc", "doc_id")], "simple", "ref_at", "created_at", "deleted_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d), "ref_table", "ref_at")


def _pairs(spark: SparkSession, d: str, match: str) -> DataFrame:
    """Judgments as references to hits by query and document, either of which may be null."""
    own = table(spark, d, "qrels").select(F.col("id").alias("ref_id"), F.col("query_id").alias("ref_query"), whole_number("doc_id").alias("ref_doc"))
    hits = table(spark, d, "search_results").select("query_id", whole_number("doc_id").alias("doc")).filter("query_id IS NOT NULL AND doc IS NOT NULL").distinct()
    return orphan_references(own, hits, [("ref_query", "query_id"), ("ref_doc", "doc")], match).select("ref_id", "null_mask")


def p2_pairs_simple(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "simple")


def p2_pairs_partial(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "partial")


def p2_pairs_full(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "full")


_REFS = r"""
WITH r0 AS (
  SELECT 'qrels' AS ref_table, id AS ref_id, trim(doc_id, E' \t\r\n\x0b\x0c') AS doc_text, created_at FROM qrels
  UNION ALL
  SELECT 'search_results', id, trim(doc_id, E' \t\r\n\x0b\x0c'), created_at FROM search_results
), r AS (
  SELECT ref_table, ref_id, created_at, TRY_CAST(doc_text AS DECIMAL(38,6)) AS num FROM r0 WHERE doc_text <> ''
), o AS (
  SELECT r.* FROM r WHERE NOT EXISTS (
    SELECT 1 FROM documents d WHERE d.doc_id = r.num
      AND (r.created_at IS NULL OR d.created_at IS NULL OR d.created_at <= r.created_at)
      AND (r.created_at IS NULL OR d.deleted_at IS NULL OR d.deleted_at > r.created_at))
)
"""

_PAIRS = r"""
WITH r AS (SELECT id AS ref_id, query_id AS q, CAST(TRY_CAST(trim(doc_id, E' \t\r\n\x0b\x0c') AS DECIMAL(38,6)) AS BIGINT) AS d FROM qrels),
h AS (SELECT DISTINCT query_id AS q, CAST(TRY_CAST(trim(doc_id, E' \t\r\n\x0b\x0c') AS DECIMAL(38,6)) AS BIGINT) AS d FROM search_results),
hh AS (SELECT * FROM h WHERE q IS NOT NULL AND d IS NOT NULL),
m AS (SELECT *, (q IS NULL)::INT + 2 * (d IS NULL)::INT AS null_mask FROM r),
s AS (SELECT ref_id, null_mask FROM m WHERE null_mask = 0 AND NOT EXISTS (SELECT 1 FROM hh WHERE hh.q = m.q AND hh.d = m.d)),
p AS (SELECT ref_id, null_mask FROM m WHERE (null_mask = 1 AND d NOT IN (SELECT d FROM hh)) OR (null_mask = 2 AND q NOT IN (SELECT q FROM hh))),
f AS (SELECT ref_id, null_mask FROM m WHERE null_mask IN (1, 2))
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_pairs_simple, p2_pairs_partial, p2_pairs_full)}
SQL = {
    "p2_found": _REFS + "SELECT ref_table, ref_id FROM o",
    "p2_report": _REFS + "SELECT ref_table, strftime(created_at, '%Y-%m') AS month, count(*) AS n_orphans FROM o GROUP BY 1, 2",
    "p2_pairs_simple": _PAIRS + "SELECT * FROM s",
    "p2_pairs_partial": _PAIRS + "SELECT * FROM s UNION ALL SELECT * FROM p",
    "p2_pairs_full": _PAIRS + "SELECT * FROM s UNION ALL SELECT * FROM f",
}
