"""Queries on ranking quality: all of search_results (best row of a document, first hundred) against all of qrels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.keys import whole_number
from millrace.operators import evaluate as ev
from millrace.plans import sqltext as sq
from millrace.session import table

DEPTH = 100


def judged(spark: SparkSession, d: str) -> DataFrame:
    return ev.judgments(table(spark, d, "qrels").select("query_id", whole_number("doc_id").alias("doc_id"), "relevance"))


def run(spark: SparkSession, d: str, score: str = "similarity_score") -> DataFrame:
    """Best row of a document first: pre-aggregated by (query, document), so repeated hits don't reach the ranking."""
    h = table(spark, d, "search_results").select("query_id", whole_number("doc_id").alias("doc_id"), F.col("similarity_score").alias("s"), F.coalesce("rank", F.lit(2**31 - 1)).alias("r"))
    h = h.filter(F.col("doc_id").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    # within the judged queries only: what is not judged is not scored
    h = h.join(judged(spark, d).select("query_id").distinct(), "query_id", "left_semi")
    if score == "similarity_score":
        best = h.groupBy("query_id", "doc_id").agg(F.max(F.struct("s", (-F.col("r")).alias("nr"))).alias("b")).select("query_id", "doc_id", "b.s", "b.nr")
        order = [F.desc("s"), F.desc("nr"), F.col("doc_id")]
    else:
        best = h.groupBy("query_id", "doc_id").agg(F.min("r").alias("r"), F.max("s").alias("s"))
        order = [F.col("r"), F.desc("s"), F.col("doc_id")]
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= DEPTH)
    return ranked.select("query_id", "rank", "doc_id")


def _both(spark: SparkSession, d: str):
    return run(spark, d), judged(spark, d)


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def eval_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.per_query(*_both(spark, d)))


def eval_map(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.mean_average_precision(*_both(spark, d)))


def eval_ap_c(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.average_precision_c(*_both(spark, d)))


def eval_interpolated_precision(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.interpolated_precision(*_both(spark, d)))


def eval_precision_where_relevant(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.precision_where_relevant(*_both(spark, d)))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.summary(ev.per_query(*_both(spark, d))))


def eval_best_worst(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.extremes(ev.per_query(*_both(spark, d), cuts=(10,))))


def eval_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.distribution(ev.per_query(*_both(spark, d), cuts=(10,))))


def eval_compare(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d)
    return _round(ev.compare(ev.per_query(run(spark, d), j, (10,)), ev.per_query(run(spark, d, "rank"), j, (10,))))


def judgment_stats(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.judgment_stats(judged(spark, d)))


FUNCTIONS = (
    eval_per_query, eval_map, eval_ap_c, eval_interpolated_precision, eval_precision_where_relevant, eval_summary, eval_best_worst, eval_distribution, eval_compare,
    judgment_stats,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_BASE = f"""WITH j0 AS (SELECT query_id, {sq.NUMBER} AS doc_id, relevance FROM qrels),
j AS MATERIALIZED (SELECT query_id, doc_id, max(relevance) AS relevance FROM j0 WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND relevance IS NOT NULL GROUP BY 1, 2),
h AS (SELECT query_id, {sq.NUMBER} AS doc_id, similarity_score AS s, coalesce(rank, 2147483647) AS r FROM search_results
  WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) AND query_id IN (SELECT query_id FROM j)),
h1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY s DESC, r) AS n FROM h WHERE doc_id IS NOT NULL),
run AS MATERIALIZED (SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r, doc_id) AS rank FROM h1 WHERE n = 1) WHERE rank <= {DEPTH}),
nr AS (SELECT query_id, count(*) AS n_relevant FROM j WHERE relevance > 0 GROUP BY 1),
hits AS MATERIALIZED (SELECT run.query_id, run.rank, CASE WHEN j.relevance > 0 THEN 1 ELSE 0 END AS rel, CASE WHEN j.doc_id IS NULL THEN 0 ELSE 1 END AS any_rel,
  sum(CASE WHEN j.relevance > 0 THEN 1 ELSE 0 END) OVER w AS found, sum(CASE WHEN j.doc_id IS NULL THEN 0 ELSE 1 END) OVER w AS any_found
  FROM run LEFT JOIN j ON j.query_id = run.query_id AND j.doc_id = run.doc_id WINDOW w AS (PARTITION BY run.query_id ORDER BY run.rank))"""


def _per_query(cuts) -> str:
    """CTEs g and pq."""
    inner, outer = [], []
    for k in cuts:
        inner += [f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) AS h{k}", f"sum(CASE WHEN rank <= {k} AND rel = 1 THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END) AS g{k}"]
        hk, pb = f"coalesce(h{k}, 0)", f"CASE WHEN coalesce(num_retrieved, 0) > 0 THEN coalesce(h{k}, 0) / least(num_retrieved, {k}) ELSE 0.0 END"
        outer += [
            f"{hk} / {k}.0 AS p_at_{k}", f"{pb} AS p_b_at_{k}", f"CASE WHEN num_retrieved >= {k} THEN {hk} / {k}.0 END AS p_c_at_{k}", f"{hk} / n_relevant AS recall_at_{k}",
            f"CASE WHEN {pb} + {hk} / n_relevant > 0 THEN 2 * ({pb}) * ({hk} / n_relevant) / ({pb} + {hk} / n_relevant) ELSE 0.0 END AS f1_at_{k}",
            f"coalesce(g{k} / (SELECT sum(1.0 / log2(i + 1.0)) FROM generate_series(1, least({k}, n_relevant)) t(i)), 0.0) AS ndcg_at_{k}",
        ]
    return f"""g AS (SELECT query_id, count(*) AS num_retrieved, sum(rel) AS num_found, sum(CASE WHEN rel = 1 THEN found / rank ELSE 0.0 END) AS ap,
  sum(CASE WHEN rel = 1 AND rank <= 100 THEN found / rank ELSE 0.0 END) AS apb, sum(CASE WHEN rank <= 100 THEN rel ELSE 0 END) AS nb,
  min(CASE WHEN rel = 1 THEN rank END) AS first, {", ".join(inner)} FROM hits GROUP BY 1),
pq AS MATERIALIZED (SELECT nr.query_id, n_relevant AS num_relevant, coalesce(num_retrieved, 0) AS num_retrieved, CAST(coalesce(num_found, 0) AS BIGINT) AS num_found, coalesce(ap / n_relevant, 0.0) AS ap,
  coalesce(CASE WHEN nb > 0 THEN apb / nb END, 0.0) AS ap_b, coalesce(1.0 / first, 0.0) AS rr, {", ".join(outer)} FROM nr LEFT JOIN g ON g.query_id = nr.query_id)"""


def _rounded(columns) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_M = [f"{m}_{k}" for k in ev.CUTS for m in ("p_at", "p_b_at", "p_c_at", "recall_at", "f1_at", "ndcg_at")]
_MEANS = [f"{m}_{k}" for k in ev.CUTS for m in ("p_at", "recall_at", "f1_at", "ndcg_at")]
_APC = "apc AS (SELECT hits.query_id, sum(any_found / rank) / any_value(n) AS ap FROM hits JOIN (SELECT query_id, count(*) AS n FROM j GROUP BY 1) a ON a.query_id = hits.query_id WHERE any_rel = 1 GROUP BY 1)"
_BY_RANK = _BASE.replace(
    "h1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY s DESC, r) AS n FROM h WHERE doc_id IS NOT NULL)",
    "h1 AS (SELECT query_id, doc_id, min(r) AS r, max(s) AS s, 1 AS n FROM h WHERE doc_id IS NOT NULL GROUP BY 1, 2)",
).replace("ORDER BY s DESC, r, doc_id", "ORDER BY r, s DESC, doc_id")

SQL = {
    "eval_per_query": f"{_BASE}, {_per_query(ev.CUTS)} SELECT query_id, num_relevant, num_retrieved, num_found, {_rounded(['ap', 'ap_b', 'rr', *_M])} FROM pq",
    "eval_map": f"""{_BASE}, {_per_query((10,))}, {_APC} SELECT count(*) AS n_queries, round(avg(ap), 6) AS map, round(avg(ap) FILTER (num_retrieved > 0), 6) AS map_answered, round(avg(ap_b), 6) AS map_b,
  (SELECT round(avg(ap), 6) FROM apc) AS map_c FROM pq""",
    "eval_ap_c": f"{_BASE}, {_APC} SELECT query_id, round(ap, 6) AS ap FROM apc",
    "eval_interpolated_precision": f"""{_BASE}, lv AS (SELECT round(i * 0.1, 1) AS level FROM generate_series(1, 10) t(i)),
m AS (SELECT level, hits.query_id, max(found / rank) AS p FROM hits JOIN nr ON nr.query_id = hits.query_id, lv WHERE found / n_relevant >= level - 1e-12 GROUP BY 1, 2)
SELECT CAST(lv.level AS DOUBLE) AS level, round((SELECT coalesce(sum(p), 0) FROM m WHERE m.level = lv.level) / (SELECT count(*) FROM nr), 6) AS precision FROM lv""",
    "eval_precision_where_relevant": f"{_BASE} SELECT rank AS cut, round(avg(any_found / rank), 6) AS precision, count(*) AS n FROM hits WHERE any_rel = 1 AND rank IN (5, 10, 20, 50, 100) GROUP BY 1",
    "eval_summary": f"""{_BASE}, {_per_query(ev.CUTS)} SELECT count(*) AS n_queries, count(*) FILTER (num_retrieved > 0) AS n_answered, round(avg(num_relevant), 6) AS mean_relevant,
  round(avg(num_retrieved), 6) AS mean_retrieved, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, {", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in _MEANS)},
  avg(ap) >= 0.2 AS map_reaches_0_2, avg(ap) >= 0.3 AS map_reaches_0_3, avg(ap) >= 0.4 AS map_reaches_0_4 FROM pq""",
    "eval_best_worst": f"""{_BASE}, {_per_query((10,))} (SELECT 'best' AS "end", query_id, round(ap, 6) AS ap FROM pq ORDER BY round(pq.ap, 9) DESC, query_id LIMIT 10)
UNION ALL (SELECT 'worst', query_id, round(ap, 6) FROM pq ORDER BY round(pq.ap, 9), query_id LIMIT 10)""",
    "eval_distribution": f"""{_BASE}, {_per_query((10,))} SELECT round(avg(ap), 6) AS mean, round(quantile_cont(ap, 0.5), 6) AS median, round(stddev_pop(ap), 6) AS std, round(min(ap), 6) AS min, round(max(ap), 6) AS max,
  count(*) FILTER (ap >= 0.5) AS good, count(*) FILTER (ap >= 0.2 AND ap < 0.5) AS fair, count(*) FILTER (ap > 0 AND ap < 0.2) AS poor, count(*) FILTER (ap = 0) AS none,
  count(*) FILTER (ap > 0.5) AS above_0_5, count(*) FILTER (ap > 0.3) AS above_0_3, count(*) FILTER (ap > 0.1) AS above_0_1 FROM pq""",
    "judgment_stats": f"{_BASE} SELECT count(*) AS n_queries, round(avg(n_relevant), 6) AS mean, min(n_relevant) AS min, max(n_relevant) AS max FROM nr",
}
SQL["eval_compare"] = (
    f"WITH one AS ({_BASE}, {_per_query((10,))} SELECT * FROM pq), two AS ({_BY_RANK}, {_per_query((10,))} SELECT * FROM pq), m AS (SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS metric, avg(one.{c}) AS a, avg(two.{c}) AS b FROM one JOIN two ON one.query_id = two.query_id" for c in ("ap", "rr", "p_at_10", "recall_at_10"))
    + ")) SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM m"
)
