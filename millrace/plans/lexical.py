"""Queries on TF-IDF and lexical retrieval over all documents.

The query set of searches: the titles of all documents whose id is divisible by 100, against all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tokens as tk
from millrace.functions import wordlists as wl
from millrace.operators import retrieve as rt
from millrace.operators import tfidf as tf
from millrace.plans import sqltext as sq
from millrace.session import spread, table

UNI = tf.Config(None, 1, 1.0, 1, 1, False)
QUORA, ANTIQUE, DEFAULT = tf.CONFIGS["quora"], tf.CONFIGS["antique"], tf.CONFIGS["default"]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", tk.simple("text").alias("tokens"))


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("doc_id % 100 = 0")
    return t.select(F.col("doc_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("text"), tk.simple("title").alias("tokens"))


def store(spark: SparkSession, d: str) -> DataFrame:
    """Documents that exist: not deleted."""
    return table(spark, d, "documents").filter("deleted_at IS NULL").select("doc_id")


def _fitted(spark: SparkSession, d: str, config: tf.Config):
    docs = documents(spark, d)
    model = tf.fit(docs, "tokens", config)
    return docs, model, tf.weights(docs, "tokens", model)


def _scores(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def tfidf_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    v = tf.vocabulary(tf.term_counts(docs, "tokens", ANTIQUE), docs.count(), ANTIQUE)
    return v.select("term", "df", "cf", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    _, _, w = _fitted(spark, d, UNI)
    return w.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def inverted_index_stats(spark: SparkSession, d: str) -> DataFrame:
    _, _, w = _fitted(spark, d, QUORA)
    return tf.index_stats(w)


def inverted_index_most_frequent(spark: SparkSession, d: str) -> DataFrame:
    _, _, w = _fitted(spark, d, UNI)
    return tf.most_frequent_terms(w, 20)


def inverted_index_postings(spark: SparkSession, d: str) -> DataFrame:
    _, _, w = _fitted(spark, d, UNI)
    i = tf.inverted_index(w, most=5)
    return i.select("term", F.array_join(F.transform("postings", lambda p: p["doc_id"].cast("string")), " ").alias("doc_ids"))


def matrix_sparsity(spark: SparkSession, d: str) -> DataFrame:
    _, model, w = _fitted(spark, d, QUORA)
    return tf.sparsity(w, model).withColumn("sparsity", F.round("sparsity", 9))


def tfidf_topk_simple(spark: SparkSession, d: str) -> DataFrame:
    _, model, w = _fitted(spark, d, UNI)
    return _scores(rt.cosine_search(search_queries(spark, d), "tokens", w, model, 10))


def tfidf_topk_ngram(spark: SparkSession, d: str) -> DataFrame:
    _, model, w = _fitted(spark, d, QUORA)
    return _scores(rt.cosine_search(search_queries(spark, d), "tokens", w, model, 10))


def tfidf_topk_antique(spark: SparkSession, d: str) -> DataFrame:
    _, model, w = _fitted(spark, d, ANTIQUE)
    return _scores(rt.cosine_search(search_queries(spark, d), "tokens", w, model, 10))


def tfidf_topk_store_filtered(spark: SparkSession, d: str) -> DataFrame:
    _, model, w = _fitted(spark, d, UNI)
    return _scores(rt.cosine_search(search_queries(spark, d), "tokens", w, model, 10, store(spark, d)))


def inverted_index_search(spark: SparkSession, d: str) -> DataFrame:
    _, _, w = _fitted(spark, d, UNI)
    return _scores(rt.index_search(search_queries(spark, d), "tokens", w, UNI, 10))


def inverted_index_search_store(spark: SparkSession, d: str) -> DataFrame:
    _, _, w = _fitted(spark, d, UNI)
    return _scores(rt.index_search(search_queries(spark, d), "tokens", w, UNI, 10, store(spark, d), weighted=False))


def expansion_blend(spark: SparkSession, d: str) -> DataFrame:
    _, model, w = _fitted(spark, d, UNI)
    q = search_queries(spark, d)
    more = q.withColumn("tokens", rt.expand_terms(F.col("tokens"), wl.EXPANSIONS_MEDICAL | wl.EXPANSIONS_ENHANCED, 3, 3))
    changed = q.join(more.select("query_id", F.col("tokens").alias("t2")), "query_id").filter(F.col("tokens") != F.col("t2")).select("query_id")
    s = rt.blend(rt.cosine_scores(q, "tokens", w, model), rt.cosine_scores(more, "tokens", w, model), 0.7, changed)
    return _scores(rt._ranked(s.filter("score > 0"), 10))


def feedback_rerank(spark: SparkSession, d: str) -> DataFrame:
    docs, model, w = _fitted(spark, d, UNI)
    return _scores(rt.feedback_search(search_queries(spark, d), docs, "tokens", w, model, 10))


def fallback_search(spark: SparkSession, d: str) -> DataFrame:
    docs, model, w = _fitted(spark, d, UNI)
    return _scores(rt.fallback_search(search_queries(spark, d), "text", docs, w, model, lambda c: F.regexp_replace(c, "(?U)[^a-zA-Z]+", " "), tk.simple, 10))


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), tk.simple("title").alias("tokens"))
    return q.select("query_id", F.array_join(rt.expand_terms(F.col("tokens"), wl.EXPANSIONS_ENHANCED), " ").alias("tokens"))


def enriched_results(spark: SparkSession, d: str) -> DataFrame:
    _, model, w = _fitted(spark, d, UNI)
    r = rt.cosine_search(search_queries(spark, d), "tokens", w, model, 3)
    return rt.enrich(r, table(spark, d, "documents"), "title", "n_chars").select("query_id", "rank", "doc_id", "title", "n_chars")


def score_stats(spark: SparkSession, d: str) -> DataFrame:
    _, model, w = _fitted(spark, d, UNI)
    s = rt.similarity_stats(rt.cosine_scores(search_queries(spark, d), "tokens", w, model))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "max", "min")])


FUNCTIONS = (
    tfidf_vocabulary, tfidf_weights, inverted_index_stats, inverted_index_most_frequent, inverted_index_postings, matrix_sparsity, tfidf_topk_simple, tfidf_topk_ngram,
    tfidf_topk_antique, tfidf_topk_store_filtered, inverted_index_search, inverted_index_search_store, expansion_blend, feedback_rerank, fallback_search, query_expansion,
    enriched_results, score_stats,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

Q = f"q AS MATERIALIZED (SELECT doc_id AS query_id, coalesce(title, '') AS text, {sq.simple_tokens('title')} AS toks FROM documents WHERE doc_id % 100 = 0)"
STORE = "st AS (SELECT doc_id FROM documents WHERE deleted_at IS NULL)"


def cosine_sql(config: tf.Config, k: int, where: str = "") -> str:
    """CTEs up to s (query_id, doc_id, score)."""
    return f"""WITH {sq.tfidf(config)}, {Q}, {STORE}, {sq.query_weights(config, "qw", "q", "toks")},
s AS (SELECT qw.query_id, w.doc_id, sum(qw.weight * w.weight) AS score FROM qw JOIN w ON qw.term = w.term {where} GROUP BY 1, 2),
r AS ({sq.ranked("s", k)})"""


_OUT = " SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r"
_INDEX = f"""WITH {sq.tfidf(UNI)}, {Q}, {STORE}, qc AS (SELECT query_id, unnest(toks) AS term FROM q),"""
_TABLE = wl.EXPANSIONS_MEDICAL | wl.EXPANSIONS_ENHANCED


def _expanded(table_: dict, most: int | None, least: int) -> str:
    m = "MAP {" + ", ".join(f"{sq.lit(k)}: {sq.words(v[:most])}" for k, v in table_.items()) + "}"
    both = f"list_concat(toks, flatten(list_transform(toks, lambda t: coalesce({m}[t], []))))"
    return f"(SELECT query_id, text, list_filter(a, lambda t, i: list_position(a, t) = i AND length(t) >= {least}) AS toks FROM (SELECT query_id, text, {both} AS a FROM q))"


SQL = {
    "tfidf_vocabulary": f"WITH {sq.tfidf(ANTIQUE)} SELECT term, df, cf, round(idf, 6) AS idf FROM v",
    "tfidf_weights": f"WITH {sq.tfidf(UNI)} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM w",
    "inverted_index_stats": f"WITH {sq.tfidf(QUORA)}, p AS (SELECT term, count(*) AS n FROM w GROUP BY 1) SELECT count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n_postings, avg(n) AS mean_postings, max(n) AS longest FROM p",
    "inverted_index_most_frequent": f"WITH {sq.tfidf(UNI)} SELECT term, count(*) AS n_docs FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "inverted_index_postings": f"""WITH {sq.tfidf(UNI)}, p AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY round(weight, 9) DESC, doc_id) AS n FROM w)
SELECT term, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY n) AS doc_ids FROM p WHERE n <= 5 GROUP BY 1""",
    "matrix_sparsity": f"""WITH {sq.tfidf(QUORA)}, a AS (SELECT count(*) AS nonzero FROM w), b AS (SELECT count(*) AS n_terms FROM v)
SELECT nonzero, n AS n_docs, n_terms, round(1 - nonzero / (CAST(n AS DOUBLE) * n_terms), 9) AS sparsity FROM a, b, nd""",
    "tfidf_topk_simple": cosine_sql(UNI, 10) + _OUT,
    "tfidf_topk_ngram": cosine_sql(QUORA, 10) + _OUT,
    "tfidf_topk_antique": cosine_sql(ANTIQUE, 10) + _OUT,
    "tfidf_topk_store_filtered": cosine_sql(UNI, 10, "JOIN st ON st.doc_id = w.doc_id") + _OUT,
    "inverted_index_search": f"{_INDEX} s AS (SELECT qc.query_id, w.doc_id, sum(w.weight) AS score FROM qc JOIN w ON qc.term = w.term GROUP BY 1, 2), r AS ({sq.ranked('s', 10)})" + _OUT,
    "inverted_index_search_store": f"{_INDEX} s AS (SELECT qc.query_id, w.doc_id, CAST(count(*) AS DOUBLE) AS score FROM qc JOIN w ON qc.term = w.term JOIN st ON st.doc_id = w.doc_id GROUP BY 1, 2), r AS ({sq.ranked('s', 10)})" + _OUT,
    "expansion_blend": f"""WITH {sq.tfidf(UNI)}, {Q}, x AS {_expanded(_TABLE, 3, 3)}, {sq.query_weights(UNI, "qw", "q", "toks")}, {sq.query_weights(UNI, "xw", "x", "toks")},
s1 AS (SELECT qw.query_id, w.doc_id, sum(qw.weight * w.weight) AS score FROM qw JOIN w ON qw.term = w.term GROUP BY 1, 2),
s2 AS (SELECT xw.query_id, w.doc_id, sum(xw.weight * w.weight) AS score FROM xw JOIN w ON xw.term = w.term GROUP BY 1, 2),
use AS (SELECT q.query_id FROM q JOIN x ON q.query_id = x.query_id WHERE q.toks <> x.toks AND q.query_id IN (SELECT query_id FROM s1 WHERE score > 0)),
p AS (SELECT query_id, doc_id, CASE WHEN query_id IN (SELECT query_id FROM use) THEN 0.7 ELSE 1.0 END * score AS part FROM s1
  UNION ALL SELECT query_id, doc_id, (1 - 0.7) * score FROM s2 WHERE query_id IN (SELECT query_id FROM use)),
s AS (SELECT query_id, doc_id, sum(part) AS score FROM p GROUP BY 1, 2), r AS ({sq.ranked("s", 10)})""" + _OUT,
    "feedback_rerank": f"""WITH {sq.tfidf(UNI)}, {Q}, {sq.query_weights(UNI, "qw", "q", "toks")},
s1 AS (SELECT qw.query_id, w.doc_id, sum(qw.weight * w.weight) AS score FROM qw JOIN w ON qw.term = w.term GROUP BY 1, 2),
b AS ({sq.ranked("s1", 5)}), f AS (SELECT b.query_id, unnest(t.toks) AS term FROM b JOIN toks t ON t.doc_id = b.doc_id UNION ALL SELECT query_id, unnest(toks) FROM q),
xl AS (SELECT query_id, list(term) AS toks FROM f GROUP BY 1), {sq.query_weights(UNI, "xw", "xl", "toks")},
s2 AS (SELECT xw.query_id, w.doc_id, sum(xw.weight * w.weight) AS score FROM xw JOIN w ON xw.term = w.term GROUP BY 1, 2),
p AS (SELECT query_id, doc_id, 0.7 * score AS part FROM s1 UNION ALL SELECT query_id, doc_id, (1 - 0.7) * score FROM s2),
s AS (SELECT query_id, doc_id, sum(part) AS score FROM p GROUP BY 1, 2), r AS ({sq.ranked("s", 10)})""" + _OUT,
    "fallback_search": f"""WITH {sq.tfidf(UNI)}, {Q},
q0 AS (SELECT query_id, {sq.simple_tokens("regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')")} AS toks FROM q), q1 AS (SELECT query_id, {sq.simple_tokens("text")} AS toks FROM q),
q3 AS (SELECT query_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda t: t <> '') AS toks FROM q), q2 AS (SELECT query_id, list_filter(toks, lambda t: length(t) > 2) AS toks FROM q3),
{", ".join(sq.query_weights(UNI, f"w{i}q", f"q{i}", "toks") for i in range(4))},
{", ".join(f"s{i} AS (SELECT x.query_id, w.doc_id, sum(x.weight * w.weight) AS score FROM w{i}q x JOIN w ON x.term = w.term GROUP BY 1, 2 HAVING sum(x.weight * w.weight) > 0)" for i in range(4))},
a AS ({" UNION ALL ".join(f"SELECT query_id, rank, doc_id, score, {i} AS strategy FROM ({sq.ranked(f's{i}', 10)})" for i in range(4))}
  UNION ALL SELECT query_id, n.rank, n.doc_id, 0.001, 4 FROM q, (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 10) n)
SELECT query_id, rank, doc_id, round(score, 6) AS score, strategy FROM a QUALIFY strategy = min(strategy) OVER (PARTITION BY query_id)""",
    "query_expansion": f"WITH {Q.replace(' WHERE doc_id % 100 = 0', '')} SELECT query_id, array_to_string(toks, ' ') AS tokens FROM {_expanded(wl.EXPANSIONS_ENHANCED, None, 1)}",
    "enriched_results": cosine_sql(UNI, 3) + " SELECT r.query_id, r.rank, r.doc_id, d.title, d.n_chars FROM r LEFT JOIN documents d ON d.doc_id = r.doc_id",
    "score_stats": cosine_sql(UNI, 1) + " SELECT count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(max(score), 6) AS max, round(min(score), 6) AS min FROM s",
}
