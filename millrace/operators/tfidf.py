"""TF-IDF as long tables.

A vocabulary is (term, df, cf, idf); weights are (doc_id, term, tf, weight), one row a term of a document, normalised by
document. An inverted index is the same table read by term. Null texts count as documents without terms: they are part
of the document number, as is any document all of whose terms are pruned.

A row of docs is a document. Terms are counted within the row, on its sorted terms, so texts are never shuffled. Shuffles:
one by term for the vocabulary (term, df, cf, combined before it), one by document for the norms, of what the vocabulary
has left. The vocabulary joins by broadcast if its measured number of rows is at most BROADCAST_TERMS, else by term.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.tokens import ngrams
from millrace.operators.ranking import top_k
from millrace.session import broadcast_below

BROADCAST_TERMS = 500_000


@dataclass(frozen=True)
class Config:
    """max_df is a share of documents, min_df a number of documents, max_features the most frequent terms kept."""

    max_features: int | None = 10_000
    min_df: int = 1
    max_df: float = 1.0
    low: int = 1
    high: int = 2
    sublinear: bool = False

    def but(self, **changes) -> Config:
        return replace(self, **changes)


#: The parameter sets in use, by name.
CONFIGS = {
    "default": Config(),
    "quora": Config(12_000, 1, 0.85, 1, 2, True),
    "quora_retuned": Config(15_000, 1, 0.8, 1, 3, True),
    "antique": Config(200_000, 2, 0.4, 1, 2, True),
}


@dataclass
class Model:
    config: Config
    n_docs: int
    vocabulary: DataFrame
    n_terms: int

    def side(self) -> DataFrame:
        return broadcast_below(self.vocabulary, self.n_terms, BROADCAST_TERMS)


def term_counts(docs: DataFrame, tokens: str, config: Config, key: str = "doc_id") -> DataFrame:
    """(key, term, tf) of each row of docs.

    The terms are sorted; where a run begins is a term, and where the next begins gives its number. An outer explode: from
    an inner one the optimizer infers a filter on the array's size and tokenizes twice.
    """
    d = docs.select(key, F.array_sort(F.filter(ngrams(F.col(tokens), config.low, config.high), lambda t: t.isNotNull())).alias("__s"))
    begins = F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda i: (i == 0) | (F.get("__s", i) != F.get("__s", i - 1)))
    d = d.select(key, "__s", F.when(F.size("__s") > 0, begins).alias("__b"))
    runs = F.transform("__b", lambda p, i: F.struct(F.get("__s", p).alias("term"), (F.coalesce(F.get("__b", i + 1), F.size("__s")) - p).cast("long").alias("tf")))
    return d.select(key, F.explode_outer(runs).alias("__r")).filter("__r IS NOT NULL").select(key, "__r.term", "__r.tf")


def vocabulary(counts: DataFrame, n_docs: int, config: Config) -> DataFrame:
    """(term, df, cf, idf) after pruning; of equally frequent terms the first in order are kept."""
    v = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    v = v.filter((F.col("df") >= config.min_df) & (F.col("df") <= config.max_df * n_docs))
    if config.max_features is not None:
        v = v.orderBy(F.desc("cf"), "term").limit(config.max_features)
    return v.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def fit(docs: DataFrame, tokens: str, config: Config, key: str = "doc_id") -> Model:
    """Learn the vocabulary. One job counts documents, one builds the vocabulary, which is kept in the checkpoint folder."""
    from millrace.session import cut

    n = docs.count()
    v = cut(vocabulary(term_counts(docs, tokens, config, key), n, config))
    return Model(config, n, v, v.count())


def raw_weight(config: Config, tf: Column) -> Column:
    return (1.0 + F.log(tf) if config.sublinear else tf.cast("double")) * F.col("idf")


def weights(docs: DataFrame, tokens: str, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, term, tf, weight), weights of unit length by key; terms outside the vocabulary are ignored."""
    w = term_counts(docs, tokens, model.config, key).join(model.side(), "term").withColumn("w", raw_weight(model.config, F.col("tf")))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", "tf", (F.col("w") / length).alias("weight"))


def inverted_index(weighted: DataFrame, key: str = "doc_id", most: int | None = None) -> DataFrame:
    """(term, df, postings): postings sorted by weight; with `most`, the best so many of each term."""
    w = weighted
    if most is not None:
        w = top_k(weighted, most, "term", key, "weight")
    postings = F.transform(F.array_sort(F.collect_list(F.struct((-F.round("weight", 9)).alias("o"), F.col(key).alias(key), "weight"))), lambda p: F.struct(p[key].alias(key), p["weight"].alias("weight")))
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("df"), postings.alias("postings"))


def index_stats(weighted: DataFrame) -> DataFrame:
    """One row: terms, postings, mean postings of a term."""
    per = weighted.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_postings"), F.avg("n").alias("mean_postings"), F.max("n").alias("longest"))


def most_frequent_terms(weighted: DataFrame, k: int) -> DataFrame:
    return weighted.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs")).orderBy(F.desc("n_docs"), "term").limit(k)


def sparsity(weighted: DataFrame, model: Model) -> DataFrame:
    """One row: 1 - nonzero entries / (documents x terms)."""
    cells = float(max(model.n_docs * model.n_terms, 1))
    return weighted.agg(F.count(F.lit(1)).alias("nonzero")).select("nonzero", F.lit(model.n_docs).cast("long").alias("n_docs"), F.lit(model.n_terms).cast("long").alias("n_terms"), (1 - F.col("nonzero") / cells).alias("sparsity"))
