"""Ranks within queries, always the same for the same scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are compared to this many decimals, so that the order of summing doesn't decide ranks.
DIGITS = 9


def top_k(scored: DataFrame, k: int | None, query: str = "query_id", doc: str = "doc_id", score: str = "score", rank: str = "rank") -> DataFrame:
    """Rank rows of each query by score (rounded, descending), then doc; keep the first k.

    Spark plans a partial limit below the shuffle (WindowGroupLimit), so at most k rows of a query leave a partition.
    Rows with a null score rank last.
    """
    w = Window.partitionBy(query).orderBy(F.round(score, DIGITS).desc_nulls_last(), F.col(doc))
    ranked = scored.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in doubles, staying in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column | str) -> Column:
    """The vector over its length; null for a vector of length 0."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))
