"""Fusing two ranked lists of each query by weighted reciprocal ranks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import top_k


@dataclass(frozen=True)
class Weights:
    lexical: float
    vector: float
    constant: int = 60
    both: float = 1.3


WEIGHTS = {"quora": Weights(0.25, 0.75), "antique": Weights(0.35, 0.65), "service": Weights(0.25, 0.75)}


def arm_sizes(arm: DataFrame, name: str) -> DataFrame:
    return arm.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))


def _joined(lexical: DataFrame, vector: DataFrame, weights: Weights) -> DataFrame:
    """Both arms in one join, with the arms' sizes of each query (nl, nv) and the fused score."""
    l = lexical.select("query_id", "doc_id", F.col("rank").alias("lr"), F.col("score").alias("tfidf_score"))
    v = vector.select("query_id", "doc_id", F.col("rank").alias("vr"), F.col("score").alias("embedding_score"))
    w = Window.partitionBy("query_id")
    j = l.join(v, ["query_id", "doc_id"], "full_outer")
    j = j.withColumn("nl", F.count("lr").over(w)).withColumn("nv", F.count("vr").over(w))
    rank_l, rank_v = F.coalesce("lr", F.col("nl") + 1), F.coalesce("vr", F.col("nv") + 1)
    score = weights.vector / (weights.constant + rank_v) + weights.lexical / (weights.constant + rank_l)
    score = score * F.when(F.col("lr").isNotNull() & F.col("vr").isNotNull(), F.lit(weights.both)).otherwise(1.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return j.select("query_id", "doc_id", score.alias("hybrid_score"), zero("tfidf_score"), zero("embedding_score"), "lr", "vr", "nl", "nv")


_COLUMNS = ("query_id", "rank", "doc_id", "hybrid_score", "tfidf_score", "embedding_score")


def reciprocal_ranks(lexical: DataFrame, vector: DataFrame, weights: Weights, k: int | None) -> DataFrame:
    """w_v / (c + rank_v) + w_l / (c + rank_l), more for documents in both arms.

    A document that one arm lacks has there the rank after that arm's last for this query (1 if the arm is empty).
    Input arms are ranked results; output has both original scores, 0 where a document is missing.
    """
    return top_k(_joined(lexical, vector, weights), k, score="hybrid_score").select(*_COLUMNS)


def hybrid(lexical: DataFrame, vector: DataFrame, weights: Weights, k: int, least_vector: float = 0.1, least_lexical: float = 0.01) -> DataFrame:
    """Queries with one empty arm keep the other arm's first k above a least score, ranks with gaps.

    One join and one pass over each query's rows: which arm is empty follows from the arms' sizes.
    """
    j = _joined(lexical, vector, weights)
    only_v, only_l = F.col("nl") == 0, F.col("nv") == 0
    own = F.when(only_v, F.col("embedding_score")).when(only_l, F.col("tfidf_score"))
    j = j.withColumn("hybrid_score", F.coalesce(own, "hybrid_score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("hybrid_score", 9)), "doc_id"))
    j = j.withColumn("rank", F.when(only_v, F.col("vr")).when(only_l, F.col("lr")).otherwise(best))
    least = F.when(only_v, F.lit(least_vector)).when(only_l, F.lit(least_lexical))
    return j.filter((F.col("rank") <= k) & (least.isNull() | (F.col("hybrid_score") > least))).select(*_COLUMNS)


def answered(queries: DataFrame, results: DataFrame) -> DataFrame:
    """the queries that no arm answered, to be refused at the edge."""
    return queries.select("query_id").join(results.select("query_id").distinct(), "query_id", "left_anti")


def min_max(arm: DataFrame, score: str = "score") -> DataFrame:
    """scores of each query brought to 0 .. 1; where all are equal, 0."""
    w = Window.partitionBy("query_id")
    span = F.max(score).over(w) - F.min(score).over(w)
    return arm.withColumn("normalised", (F.col(score) - F.min(score).over(w)) / F.when(span == 0, 1.0).otherwise(span))


def aligned(lexical_ids: DataFrame, vector_ids: DataFrame) -> DataFrame:
    """Documents that both sides know; if there are none, those of the vector side."""
    a = lexical_ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    v = vector_ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    common = v.join(a, "doc_id", "left_semi")
    any_ = common.agg(F.count(F.lit(1)).alias("__n"))
    return v.join(a.withColumn("__both", F.lit(True)), "doc_id", "left").crossJoin(F.broadcast(any_)).filter("__both OR __n = 0").select("doc_id")  # one row


def cut_then_keep(arm: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The arm is cut first, then restricted, so it may be short."""
    return arm.filter(F.col("rank") <= k).join(ids, "doc_id", "left_semi")


def lifted(arm: DataFrame, least: float = 0.001) -> DataFrame:
    """Where all scores of a query are 0, all become a small score, so that fusion has something to work with."""
    w = Window.partitionBy("query_id")
    return arm.withColumn("score", F.when((F.max("score").over(w) == 0) & (F.min("score").over(w) == 0), F.lit(least)).otherwise(F.col("score")))
