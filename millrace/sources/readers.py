"""Reading document collections, queries and judgments from files.

Files are read by Spark with a declared or inferred schema; what is done on the driver is the choice of a format.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cleaning import clean
from millrace.session import cut

# The columns that may hold a text or an identifier, in order of preference.
TEXT_FIELDS = ("text", "content", "body", "document", "passage", "answer")
ID_FIELDS = ("id", "doc_id", "document_id", "qid", "pid")
FILE_NAMES = ("docs.tsv", "documents.tsv", "corpus.tsv", "collection.tsv")
REGISTRY = (
    ("msmarco-passage", 8_841_823),
    ("trec-covid", 171_332),
    ("robust04", 528_155),
    ("clueweb09b", 50_220_423),
)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or an object of objects by identifier (which becomes the column id where there is none)."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    row = T.MapType(T.StringType(), T.StringType())
    listed = text.filter(F.col("value").startswith("[")).select(F.posexplode(F.from_json("value", T.ArrayType(row))).alias("pos", "m"))
    keyed = text.filter(F.col("value").startswith("{")).select(F.posexplode(F.from_json("value", T.MapType(T.StringType(), row))).alias("pos", "k", "m"))
    keyed = keyed.select("pos", F.when(F.map_contains_key("m", "id"), F.col("m")).otherwise(F.map_concat(F.create_map(F.lit("id"), "k"), "m")).alias("m"))
    return listed.unionByName(keyed).select(F.col("m").alias("fields"), F.col("pos").cast("long").alias("position"))


def read_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One object a line; blank and malformed lines are skipped; a limit counts documents: rows with a text."""
    m = F.from_json("value", T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})
    rows = spark.read.text(path).filter(F.trim("value") != "").select(m.alias("fields")).filter("fields IS NOT NULL AND size(fields) > 0")
    rows = rows.select("fields", F.monotonically_increasing_id().alias("position"))
    return rows if limit is None else rows.filter(accepted()).limit(limit)


def accepted() -> Column:
    """Whether fields have a text: the first that isn't empty, not blank."""
    return F.coalesce(clean(_first(TEXT_FIELDS), [("strip",)]) != "", F.lit(False))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """S3: with a header; tabs if the name says so, else commas."""
    sep = "\t" if path.rstrip("/").endswith((".tsv", ".txt")) else ","
    t = spark.read.option("header", True).option("sep", sep).option("multiLine", sep == ",").option("quote", '"' if sep == "," else "").csv(path)
    pairs = [x for c in t.columns for x in (F.lit(c), F.col(f"`{c}`"))]
    fields = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return t.select(fields.alias("fields"), F.monotonically_increasing_id().alias("position"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; without one, JSON, then JSON lines, then delimited, whichever gives rows."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path)
    if path.endswith((".csv", ".tsv", ".txt")):
        return read_delimited(spark, path)
    for way in (read_json, read_jsonl, read_delimited):
        rows = way(spark, path)
        if not rows.filter("fields IS NOT NULL").isEmpty():
            return rows
    return read_delimited(spark, path)


def _first(fields: Sequence[str], c: str = "fields") -> Column:
    """The first field that is there and not empty; '0' counts as empty, as does 'false'."""
    return F.coalesce(*[F.when(~F.coalesce(F.try_element_at(c, F.lit(f)), F.lit("")).isin("", "0", "false"), F.try_element_at(c, F.lit(f))) for f in fields])


def normalise(rows: DataFrame) -> DataFrame:
    """(id, text, metadata): text trimmed after it is chosen, rows without text dropped, the rest of the fields kept."""
    text_name = F.coalesce(*[F.when(~F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit("")).isin("", "0", "false"), F.lit(f)) for f in TEXT_FIELDS])
    id_name = F.coalesce(*[F.when(~F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit("")).isin("", "0", "false"), F.lit(f)) for f in ID_FIELDS])
    out = rows.select("fields", "position", text_name.alias("tn"), id_name.alias("in"))
    text = clean(F.try_element_at("fields", F.col("tn")), [("strip",)])
    key = F.coalesce(F.try_element_at("fields", F.col("in")), F.col("position").cast("string"))
    rest = F.map_filter("fields", lambda k, v: (k != F.col("tn")) & F.coalesce(k != F.col("in"), F.lit(True)))
    return out.filter("tn IS NOT NULL").select(key.alias("id"), text.alias("text"), rest.alias("metadata")).filter("text <> ''")


def probe(folder: str, names: Sequence[str] = FILE_NAMES) -> str | None:
    """The first of the known file names that the folder has."""
    return next((os.path.join(folder, n) for n in names if os.path.exists(os.path.join(folder, n))), None)


def registry(spark: SparkSession) -> DataFrame:
    """Known public collections with their published sizes."""
    return spark.createDataFrame(list(REGISTRY), "name string, documents long")


def collection(spark: SparkSession, folder: str, docs_limit: int | None = None, queries_limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, queries and judgments of a local folder (docs.tsv, queries.tsv, qrels.tsv), with limits."""
    d = read_table(spark, f"{folder}/docs.tsv", "doc_id string, text string")
    q = read_table(spark, f"{folder}/queries.tsv", "query_id string, text string")
    r = read_judgments(spark, f"{folder}/qrels.tsv")
    return d.limit(docs_limit) if docs_limit is not None else d, q.limit(queries_limit) if queries_limit is not None else q, r


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated with a header and a declared schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("sep", "\t").option("quote", "").csv(path)


def read_judgments(spark: SparkSession, path: str, positive: bool = False) -> DataFrame:
    """(query_id, doc_id, relevance); rows whose relevance is no whole number are dropped."""
    r = read_table(spark, path, "query_id string, doc_id string, relevance string")
    r = r.select("query_id", "doc_id", F.col("relevance").try_cast("int").alias("relevance")).filter("relevance IS NOT NULL")
    return r.filter("relevance > 0") if positive else r


def scan(store: DataFrame, dataset: str | None = None, limit: int | None = None, order: str | None = None, columns: Sequence[str] = ("*",), not_null: str | None = None) -> DataFrame:
    """A filtered, pruned, optionally ordered and limited read of a stored table."""
    t = store if dataset is None else store.filter(F.col("dataset_name") == dataset)
    if not_null:
        t = t.filter(F.col(not_null).isNotNull())
    if order:
        t = t.orderBy(order)
    t = t.select(*columns)
    return t if limit is None else t.limit(limit)


def with_constant_metadata(docs: DataFrame, dataset: str, source: str) -> DataFrame:
    """S13."""
    return docs.withColumn("metadata", F.create_map(F.lit("dataset"), F.lit(dataset), F.lit("source"), F.lit(source)))


def positions(docs: DataFrame, order: str) -> DataFrame:
    """Identifiers from 0 by an explicit order, numbered partition by partition without one global sort task."""
    # cut, so that both branches see the same partitions
    ranged = cut(docs.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    before = sizes.withColumn("__b", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).select("__p", "__b")
    w = Window.partitionBy("__p").orderBy(order)
    return ranged.join(F.broadcast(before), "__p").withColumn("position", F.col("__b") + F.row_number().over(w) - 1).drop("__p", "__b")


def decoded(store: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that hold JSON text, by the type they are to have; what doesn't parse becomes null."""
    return store.withColumns({c: F.from_json(c, t) for c, t in columns.items()})
