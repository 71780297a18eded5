"""Lexical retrieval for batches of queries.

Queries are (query_id, tokens), results (query_id, rank, doc_id, score). Scores come from an equi-join on terms; the
query side is computed once and counted; it is broadcast if it has at most BROADCAST_ROWS rows, otherwise both sides are
shuffled by term and adaptive execution splits the frequent ones. Partial sums are combined before the shuffle by query and document.
Long queries (feedback) go through `blocks` instead, which has no row for each query and document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import tfidf
from millrace.operators.blocks import best_documents
from millrace.operators.ranking import top_k
from millrace.session import broadcast_below, cut

BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """Computed once, counted, and broadcast if small."""
    df = cut(df)
    return broadcast_below(df, df.count(), BROADCAST_ROWS)


def cosine_scores(queries: DataFrame, tokens: str, index: DataFrame, model: tfidf.Model) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a term; both sides have unit length, so the sum is the cosine."""
    q = tfidf.weights(queries, tokens, model, "query_id").select("query_id", "term", F.col("weight").alias("qw"))
    j = index.join(_small(q), "term")
    return j.groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))


def cosine_search(queries: DataFrame, tokens: str, index: DataFrame, model: tfidf.Model, k: int = 10, store: DataFrame | None = None) -> DataFrame:
    """R1, R2, R4; with a store (doc_id), R3: documents outside it are left out before the cut."""
    if store is not None:
        index = index.join(store.select("doc_id").distinct(), "doc_id", "left_semi")
    return _ranked(cosine_scores(queries, tokens, index, model).filter("score > 0"), k)


def _ranked(scored: DataFrame, k: int | None) -> DataFrame:
    return top_k(scored, k).select("query_id", "rank", "doc_id", "score")


def index_search(queries: DataFrame, tokens: str, index: DataFrame, config: tfidf.Config, k: int = 10, store: DataFrame | None = None, weighted: bool = True) -> DataFrame:
    """Sum of document weights over every occurrence of a query's terms; R6 with a store or, unweighted, 1 a hit."""
    if store is not None:
        index = index.join(store.select("doc_id").distinct(), "doc_id", "left_semi")
    q = tfidf.term_counts(queries, tokens, config, "query_id").select("query_id", "term", F.col("tf").alias("times"))
    w = F.col("weight") if weighted else F.lit(1.0)
    return _ranked(index.join(_small(q), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("times") * w).alias("score")), k)


def blend(original: DataFrame, expanded: DataFrame, share: float = 0.7, changed: DataFrame | None = None) -> DataFrame:
    """Share x original + (1 - share) x expanded, for queries that had a hit and changed; others keep their scores.

    The inputs are full scores (query_id, doc_id, score); changed holds the query_ids whose text changed.
    """
    had = original.filter("score > 0").select("query_id").distinct()
    use = had if changed is None else had.join(changed.select("query_id").distinct(), "query_id", "left_semi")
    use = use.withColumn("blended", F.lit(True))
    o = original.join(use, "query_id", "left").select("query_id", "doc_id", F.when(F.col("blended"), F.lit(share)).otherwise(1.0).alias("w") * F.col("score"))
    o = o.toDF("query_id", "doc_id", "part")
    e = expanded.join(use, "query_id", "left_semi").select("query_id", "doc_id", ((1 - share) * F.col("score")).alias("part"))
    return o.unionByName(e).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def expand_terms(tokens: Column, table: dict[str, Sequence[str]], most: int | None = None, least_length: int = 1) -> Column:
    """Each token's related terms appended, each term once."""
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v[:most]]))])
    more = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(m, t), F.array().cast("array<string>"))))
    return F.filter(F.array_distinct(F.concat(tokens, more)), lambda t: F.length(t) >= least_length)


def expand_from_table(queries: DataFrame, tokens: str, related: DataFrame, most: int = 3) -> DataFrame:
    """The `most` shortest single-word related terms (word, lemma) of more than two signs, ties in order."""
    r = related.filter((F.length("lemma") > 2) & ~F.contains("lemma", F.lit("_"))).select("word", F.lower("lemma").alias("lemma")).distinct()
    r = r.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy(F.length("lemma"), "lemma"))).filter(F.col("n") <= most)
    e = queries.select("query_id", F.explode(F.array_distinct(tokens)).alias("word")).join(r, "word").groupBy("query_id").agg(F.array_sort(F.collect_set("lemma")).alias("__more"))
    out = queries.join(e, "query_id", "left")
    return out.withColumn(tokens, F.array_distinct(F.concat(tokens, F.coalesce("__more", F.array().cast("array<string>"))))).drop("__more")


def feedback_search(queries: DataFrame, docs: DataFrame, tokens: str, index: DataFrame, model: tfidf.Model, k: int = 10, feedback: int = 5, share: float = 0.7) -> DataFrame:
    """The tokens of the best `feedback` documents are appended in rank order, scored again and blended.

    Without a score filter, as the blended list is cut by rank alone; documents that share no term have no row. The longer
    queries have terms of nearly all documents, so both searches keep the best of each query as they read. Scores are
    linear in the query's weights, so what is blended is these.
    """
    short = cut(tfidf.weights(queries, tokens, model, "query_id").select("query_id", "term", "weight"))
    best = cut(best_documents(short, docs, tokens, index, model, feedback).select("query_id", "rank", "doc_id"))
    texts = docs.select("doc_id", F.col(tokens).alias("__t")).join(broadcast_below(best, best.count(), BROADCAST_ROWS), "doc_id")
    more = texts.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "__t"))), lambda s: s["__t"])).alias("__more"))
    longer = queries.join(more, "query_id", "left").withColumn(tokens, F.concat(tokens, F.coalesce("__more", F.array().cast("array<string>")))).drop("__more")
    long = tfidf.weights(longer, tokens, model, "query_id")
    both = short.select("query_id", "term", (share * F.col("weight")).alias("p")).unionByName(long.select("query_id", "term", ((1 - share) * F.col("weight")).alias("p")))
    return best_documents(cut(both.groupBy("query_id", "term").agg(F.sum("p").alias("weight"))), docs, tokens, index, model, k)


def first_that_answers(strategies: Sequence[DataFrame]) -> DataFrame:
    """For each query the rows of the first strategy that has any; each strategy is a ranked result."""
    tagged = [s.withColumn("strategy", F.lit(i)) for i, s in enumerate(strategies)]
    all_ = reduce(DataFrame.unionByName, tagged)
    least = all_.groupBy("query_id").agg(F.min("strategy").alias("strategy"))
    return all_.join(least, ["query_id", "strategy"])


def synthetic(queries: DataFrame, docs: DataFrame, n: int, score: float = 0.001) -> DataFrame:
    """The last resort of R7: the first n documents in order of identifier, all with one small score."""
    first = docs.select("doc_id").orderBy("doc_id").limit(n).withColumn("rank", F.row_number().over(Window.orderBy("doc_id")))
    return queries.select("query_id").crossJoin(F.broadcast(first)).select("query_id", "rank", "doc_id", F.lit(score).alias("score"))  # n rows


def fallback_search(queries: DataFrame, text: str, docs: DataFrame, index: DataFrame, model: tfidf.Model, cleaner: Callable[[Column], Column], tokenizer: Callable[[Column], Column], k: int) -> DataFrame:
    """Cleaned text, then the text as it is, then its words of more than two letters, then all its words, then anything."""
    lower = F.split(F.lower(F.col(text)), r"\s+")
    forms = [tokenizer(cleaner(F.col(text))), tokenizer(F.col(text)), F.filter(lower, lambda t: F.length(t) > 2), F.filter(lower, lambda t: t != "")]
    ways = [cosine_search(queries.select("query_id", f.alias("t")), "t", index, model, k) for f in forms]
    return first_that_answers([*ways, synthetic(queries, docs, k)])


def enrich(ranked: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Columns of the documents; ids that the documents lack get nulls."""
    return ranked.join(docs.select("doc_id", *columns), "doc_id", "left").select(*ranked.columns, *columns)


def lookup(docs: DataFrame, *ids) -> DataFrame:
    """R21."""
    return docs.filter(F.col("doc_id").isin(*ids))


def capped(top_k_asked: int, most: int = 50) -> int:
    """R22."""
    return min(top_k_asked, most)


def similarity_stats(scores: DataFrame) -> DataFrame:
    """Mean, population deviation, largest and smallest score."""
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.max("score").alias("max"), F.min("score").alias("min"), F.count("score").alias("n"))
