"""Writing and changing stored tables, as transformations from old and new rows to the table's next state."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last by order, other columns breaking ties. Combined before the shuffle, so hot keys cost little."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    plain = [c for c in rest if not dict(rows.dtypes)[c].startswith("map")]
    best = F.max_by(F.struct(*rest, order), F.struct(F.col(order), *plain))
    return rows.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*").select(*rows.columns)


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the batch replace those of the same key; within the batch the last wins.

    The table side isn't reshuffled for its own sake: one anti-join by key and a union.
    """
    new = last_wins(batch, keys, order)
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def append(table: DataFrame, batch: DataFrame) -> DataFrame:
    """K3: no key, nothing replaced."""
    return table.unionByName(batch, allowMissingColumns=True)


def refresh(path: str, rows: DataFrame, keys: list[str], order: str) -> None:
    """K4, K5: the whole table from new rows, the last of each key."""
    last_wins(rows, keys, order).write.mode("overwrite").parquet(path)


def load_all(spark: SparkSession, folder: str, out: str) -> dict[str, int]:
    """K6: documents, queries and judgments of a folder into stored tables, the last row of each key; gives their sizes."""
    from millrace.sources import readers

    sizes = {}
    for name, rows, keys in zip(("docs", "queries", "qrels"), readers.collection(spark, folder), (["doc_id"], ["query_id"], ["query_id", "doc_id"])):
        refresh(f"{out}/{name}", rows.withColumn("seq", F.monotonically_increasing_id()), keys, "seq")
        sizes[name] = spark.read.parquet(f"{out}/{name}").count()
    return sizes


def set_column(table: DataFrame, key: str, name: str, values: DataFrame) -> DataFrame:
    """K7: add a column or update it by key where there is a new value."""
    new = values.select(key, F.col(name).alias("__new"))
    old = F.col(name) if name in table.columns else F.lit(None).cast(dict(values.dtypes)[name])
    j = table.join(new, key, "left")
    return j.select(*[c for c in table.columns if c != name], F.coalesce("__new", old).alias(name))


def batch_stats(batch: DataFrame, dataset: str) -> DataFrame:
    """K2: (name, document_count) of each data set in this batch; the count is the batch's, not the table's."""
    return batch.groupBy(F.col(dataset).alias("name")).agg(F.count(F.lit(1)).alias("document_count"))


def clean_and_store(docs: DataFrame, text: str, cleaner: Column, path: str) -> None:
    """K8: one pass, no batches."""
    docs.withColumn("processed_text", cleaner).write.mode("overwrite").parquet(path)


def save_dataset(docs: DataFrame, queries: DataFrame, judged: DataFrame, folder: str, name: str) -> dict:
    """K9: JSON lines of each table, and a small metadata file's content as a value (and a one-row table)."""
    docs.write.mode("overwrite").json(f"{folder}/docs")
    queries.write.mode("overwrite").json(f"{folder}/queries")
    judged.write.mode("overwrite").json(f"{folder}/qrels")
    meta = {"name": name, "documents": docs.count(), "queries": queries.count(), "judgments": judged.count()}
    docs.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")
    return meta


def save_index(weighted: DataFrame, vocabulary: DataFrame, folder: str) -> None:
    """The model as Parquet, weights laid out by term so that a query reads few files."""
    vocabulary.write.mode("overwrite").parquet(f"{folder}/vocabulary")
    weighted.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/weights")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and weights; refuses a model whose weights use terms that the vocabulary lacks."""
    v, w = spark.read.parquet(f"{folder}/vocabulary"), spark.read.parquet(f"{folder}/weights")
    if not w.select("term").distinct().join(v, "term", "left_anti").isEmpty():
        raise ValueError("the index has terms that its vocabulary lacks")
    return v, w


def save_results(scored: DataFrame, path: str) -> None:
    """K11."""
    scored.write.mode("overwrite").json(path)


def export_tsv(rows: DataFrame, path: str) -> None:
    """Tabs, a header; tabs and line ends within texts become spaces."""
    flat = [F.regexp_replace(c, r"[\t\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
