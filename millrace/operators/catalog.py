"""Tables about tables: validation, statistics, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_index(weighted: DataFrame, vocabulary: DataFrame, docs: DataFrame) -> DataFrame:
    """V1: one row: counts, terms outside the vocabulary, documents outside the store, rows of a length other than 1."""
    terms = weighted.select("term").distinct()
    ids = weighted.select("doc_id").distinct()
    lengths = weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("l"))
    parts = [
        terms.agg(F.count(F.lit(1)).alias("n_terms")),
        vocabulary.agg(F.count(F.lit(1)).alias("n_vocabulary")),
        ids.agg(F.count(F.lit(1)).alias("n_indexed")),
        docs.agg(F.count(F.lit(1)).alias("n_docs")),
        terms.join(vocabulary.select("term"), "term", "left_anti").agg(F.count(F.lit(1)).alias("unknown_terms")),
        ids.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_docs")),
        lengths.filter(F.abs(F.col("l") - 1) > 1e-6).agg(F.count(F.lit(1)).alias("off_length")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out.withColumn("ok", F.expr("unknown_terms = 0 AND unknown_docs = 0 AND off_length = 0"))


def text_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """V4: one row about a text collection."""
    n = F.length(text)
    return docs.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.count(text).alias("n_texts"),
        F.sum(F.when(F.coalesce(F.trim(text), F.lit("")) == "", 1).otherwise(0)).alias("n_blank"),
        F.avg(n).alias("mean_chars"), F.max(n).alias("max_chars"), F.min(n).alias("min_chars"),
    )


def database_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """V3: (name, n_rows) of each table."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def dataset_catalog(docs: DataFrame, dataset: str, indexed: DataFrame | None = None) -> DataFrame:
    """V5, V7: (dataset, document_count, indexed_count, indexed) of each data set."""
    n = docs.groupBy(F.col(dataset).alias("dataset")).agg(F.count(F.lit(1)).alias("document_count"))
    if indexed is None:
        return n.select("dataset", "document_count", F.lit(0).cast("long").alias("indexed_count"), F.lit(False).alias("indexed"))
    hit = docs.join(indexed.select("doc_id").distinct(), "doc_id", "left_semi").groupBy(F.col(dataset).alias("dataset")).agg(F.count(F.lit(1)).alias("indexed_count"))
    j = n.join(hit, n["dataset"].eqNullSafe(hit["dataset"]), "left").select(n["dataset"], "document_count", F.coalesce("indexed_count", F.lit(0)).alias("indexed_count"))
    return j.withColumn("indexed", F.col("indexed_count") > 0)


def is_current(index: DataFrame, docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether a stored index (or cache) has a row for as many keys as the documents have."""
    return index.select(key).distinct().count() == docs.select(key).distinct().count()
