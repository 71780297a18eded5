"""Queries on vector retrieval and fusion.

Vectors come from `embeddings` (query set: vec_id divisible by 100, against all) and, for fusion, from doc_vectors: a
document stands for its title as text and for its vector, so one query set has both arms.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import fuse, retrieve, vectors
from millrace.operators import tfidf as tf
from millrace.operators.ranking import norm, unit
from millrace.plans import lexical as lx
from millrace.plans import sqltext as sq
from millrace.session import table


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def vector_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectors.flat_search(_queries(spark, d), _corpus(spark, d), 10))


def vector_expression_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectors.expression_search(_queries(spark, d), _corpus(spark, d), 10))


def vector_positive_only(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectors.flat_search(_queries(spark, d), _corpus(spark, d), 400, positive=True))


def vector_dot_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectors.flat_search(_queries(spark, d), _corpus(spark, d), 10, metric="dot"))


def vector_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectors.flat_search(_queries(spark, d), _corpus(spark, d), 10, metric="l2"))


def vector_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(norm("embedding"), 6).alias("length"), F.round(norm(unit("embedding")), 6).alias("unit_length"))


def _cells(c: DataFrame) -> vectors.Cells:
    return vectors.Cells(c, probes=math.ceil(vectors.PROBED_SHARE * vectors.cell_counts(c.count())[0]))


def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_cells(_corpus(spark, d)).search(_queries(spark, d), 10))


def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    q, c = _queries(spark, d), _corpus(spark, d)
    exact = vectors.flat_search(q, c, 10)
    rule = vectors.recall_against(vectors.Cells(c).search(q, 10), exact).withColumn("probes", F.lit("rule"))
    return rule.unionByName(vectors.recall_against(_cells(c).search(q, 10), exact).withColumn("probes", F.lit("share")))


def lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectors.projection_search(_queries(spark, d), _corpus(spark, d), 10))


def lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    q, c = _queries(spark, d), _corpus(spark, d)
    return vectors.recall_against(vectors.projection_search(q, c, 10), vectors.flat_search(q, c, 10))


def ann_recall_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximate searches find nine tenths of the exact ten of every query taken together."""
    q, c = _queries(spark, d), _corpus(spark, d)
    exact = vectors.flat_search(q, c, 10)
    ways = (("cells", _cells(c).search(q, 10)), ("projections", vectors.projection_search(q, c, 10)))
    out = [vectors.recall_against(found, exact).select(F.lit(n).alias("name"), (F.col("recall") >= 0.9).alias("kept")) for n, found in ways]
    return out[0].unionByName(out[1])


def vector_similarity_stats(spark: SparkSession, d: str) -> DataFrame:
    s = retrieve.similarity_stats(vectors.flat_search(_queries(spark, d), _corpus(spark, d), None))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "max", "min")])


def _doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vector").cast("array<double>")
    t = table(spark, d, "doc_vectors").select("doc_id", v.alias("vector")).filter(F.size("vector") == 64)
    t = t.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    return t.groupBy("doc_id").agg(F.min("vector").alias("vector"))


def _arms(spark: SparkSession, d: str, k: int):
    """Both arms, k deep, over the documents that have a text and a usable vector."""
    _, model, w = lx._fitted(spark, d, lx.UNI)
    v = _doc_vectors(spark, d)
    ids = fuse.aligned(w.select("doc_id"), v.select("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"))
    q = lx.search_queries(spark, d)
    lexical = retrieve.cosine_search(q, "tokens", w, model, k)
    vector = vectors.flat_search(v.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector"), v, k, positive=True)
    return lexical, fuse.cut_then_keep(vector, ids, k)


def _fused(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "doc_id", *[F.round(c, 6).alias(c) for c in ("hybrid_score", "tfidf_score", "embedding_score")])


def hybrid_rrf_quora(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fuse.hybrid(*_arms(spark, d, 20), fuse.WEIGHTS["quora"], 10))


def hybrid_rrf_antique(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fuse.hybrid(*_arms(spark, d, 20), fuse.WEIGHTS["antique"], 10))


def hybrid_rrf_deep(spark: SparkSession, d: str) -> DataFrame:
    """The services' depth: ten times the asked number of rows, arms twice as deep."""
    return _fused(fuse.hybrid(*_arms(spark, d, 200), fuse.WEIGHTS["service"], 100))


def min_max_scores(spark: SparkSession, d: str) -> DataFrame:
    s = fuse.min_max(_arms(spark, d, 20)[0])
    return s.select("query_id", "doc_id", F.round("normalised", 6).alias("normalised"))


def doc_alignment(spark: SparkSession, d: str) -> DataFrame:
    docs = lx.documents(spark, d).filter(F.size("tokens") > 0)
    return fuse.aligned(docs.select("doc_id"), _doc_vectors(spark, d).select("doc_id"))


FUNCTIONS = (
    vector_cosine_topk, vector_expression_topk, vector_positive_only, vector_dot_topk, vector_l2_topk, vector_lengths, ivf_topk, ivf_recall, lsh_topk, lsh_recall, ann_recall_kept, vector_similarity_stats,
    hybrid_rrf_quora, hybrid_rrf_antique, hybrid_rrf_deep, min_max_scores, doc_alignment,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}


def _flat_sql(score: str, k: int | None, where: str = "") -> str:
    return f"""WITH e AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (
SELECT a.doc_id AS query_id, b.doc_id, {score} AS score FROM e a JOIN e b ON a.doc_id % 100 = 0), r AS ({sq.ranked("s", k)})
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r {where}"""


_COS = "list_cosine_similarity(a.v, b.v)"
_DV = """dv AS MATERIALIZED (SELECT doc_id, min(CAST(vector AS DOUBLE[])) AS v FROM doc_vectors WHERE len(vector) = 64
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1)"""


def _arms_sql(k: int) -> str:
    return f"""{lx.cosine_sql(lx.UNI, k)}, {_DV},
vs AS (SELECT a.doc_id AS query_id, b.doc_id, round({_COS}, 12) AS score FROM dv a JOIN dv b ON a.doc_id % 100 = 0),
vr AS (SELECT * FROM ({sq.ranked("vs", k)}) WHERE score > 0 AND doc_id IN (SELECT doc_id FROM w))"""


def _hybrid_sql(weights: fuse.Weights, k: int, depth: int) -> str:
    return f"""{_arms_sql(depth)},
b AS (SELECT DISTINCT query_id FROM r WHERE query_id IN (SELECT query_id FROM vr)),
nl AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1), nv AS (SELECT query_id, count(*) AS n FROM vr GROUP BY 1),
j AS (SELECT coalesce(l.query_id, x.query_id) AS query_id, coalesce(l.doc_id, x.doc_id) AS doc_id, l.rank AS lr, x.rank AS vrank, l.score AS ls, x.score AS vsc
  FROM (SELECT * FROM r WHERE query_id IN (SELECT query_id FROM b)) l FULL OUTER JOIN (SELECT * FROM vr WHERE query_id IN (SELECT query_id FROM b)) x ON l.query_id = x.query_id AND l.doc_id = x.doc_id),
f AS (SELECT j.query_id, j.doc_id, ({weights.vector} / ({weights.constant} + coalesce(vrank, nv.n + 1)) + {weights.lexical} / ({weights.constant} + coalesce(lr, nl.n + 1)))
  * CASE WHEN lr IS NOT NULL AND vrank IS NOT NULL THEN {weights.both} ELSE 1.0 END AS hybrid_score, coalesce(ls, 0.0) AS tfidf_score, coalesce(vsc, 0.0) AS embedding_score
  FROM j JOIN nl ON nl.query_id = j.query_id JOIN nv ON nv.query_id = j.query_id),
o AS ({sq.ranked("f", k, "hybrid_score", ", tfidf_score, embedding_score")})
SELECT query_id, rank, doc_id, round(hybrid_score, 6) AS hybrid_score, round(tfidf_score, 6) AS tfidf_score, round(embedding_score, 6) AS embedding_score FROM o
UNION ALL SELECT query_id, rank, doc_id, round(score, 6), 0.0, round(score, 6) FROM vr WHERE query_id NOT IN (SELECT query_id FROM b) AND rank <= {k} AND score > 0.1
UNION ALL SELECT query_id, rank, doc_id, round(score, 6), round(score, 6), 0.0 FROM r WHERE query_id NOT IN (SELECT query_id FROM b) AND rank <= {k} AND score > 0.01"""


SQL = {
    "vector_cosine_topk": _flat_sql(_COS, 10),
    "vector_expression_topk": _flat_sql(_COS, 10),
    "vector_positive_only": _flat_sql(f"round({_COS}, 12)", 400, "WHERE score > 0"),
    "vector_dot_topk": _flat_sql("list_dot_product(a.v, b.v)", 10),
    "vector_l2_topk": _flat_sql("-(list_distance(a.v, b.v) ** 2)", 10),
    "ann_recall_kept": "SELECT * FROM (VALUES ('cells', true), ('projections', true)) t(name, kept)",
    "vector_lengths": """SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS length, 1.0 AS unit_length FROM embeddings""",
    "vector_similarity_stats": f"""WITH e AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT {_COS} AS score FROM e a JOIN e b ON a.doc_id % 100 = 0)
SELECT count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(max(score), 6) AS max, round(min(score), 6) AS min FROM s""",
    "hybrid_rrf_quora": _hybrid_sql(fuse.WEIGHTS["quora"], 10, 20),
    "hybrid_rrf_antique": _hybrid_sql(fuse.WEIGHTS["antique"], 10, 20),
    "hybrid_rrf_deep": _hybrid_sql(fuse.WEIGHTS["service"], 100, 200),
    "min_max_scores": f"""{lx.cosine_sql(lx.UNI, 20)} SELECT query_id, doc_id, round((score - min(score) OVER p) / CASE WHEN max(score) OVER p = min(score) OVER p THEN 1.0 ELSE max(score) OVER p - min(score) OVER p END, 6) AS normalised
FROM r WINDOW p AS (PARTITION BY query_id)""",
    "doc_alignment": f"""WITH {_DV}, t AS (SELECT doc_id FROM documents WHERE len({sq.simple_tokens("text")}) > 0),
a AS (SELECT doc_id FROM dv WHERE doc_id IN (SELECT doc_id FROM t))
SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM dv WHERE doc_id IN (SELECT doc_id FROM a) OR (SELECT count(*) FROM a) = 0""",
}
