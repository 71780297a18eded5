"""Scoring rankings against relevance judgments.

run: (query_id, rank, doc_id), one row a retrieved document, ranks from 1 without gaps.
judged: (query_id, doc_id, relevance), one row a pair.

All metrics of a query come from one join of the two on (query, document) and one aggregation by query, both keyed by
query; a query's list is never collected. Queries with judgments but without results count as 0 where it says so.

Average precision: a over all relevant, b over the relevant found within the first 100, c like a but any judged document
counts and queries without a hit are dropped. Precision at k: a over k, b over min(k, retrieved), c over k but only
where at least k were retrieved.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 5, 10, 20)
LEVELS = tuple(round(0.1 * i, 1) for i in range(1, 11))


def judgments(raw: DataFrame, query: str = "query_id", doc: str = "doc_id", relevance: str = "relevance") -> DataFrame:
    """One row a pair: its largest relevance; rows with a null query, document or relevance don't count."""
    r = raw.select(F.col(query).alias("query_id"), F.col(doc).alias("doc_id"), F.col(relevance).cast("int").alias("relevance"))
    return r.filter("query_id IS NOT NULL AND doc_id IS NOT NULL AND relevance IS NOT NULL").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))


def relevant(judged: DataFrame, any_judged: bool = False) -> DataFrame:
    return judged.select("query_id", "doc_id") if any_judged else judged.filter("relevance > 0").select("query_id", "doc_id")


def hits(run: DataFrame, judged: DataFrame, any_judged: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, rel, found): rel is 1 for relevant rows, found the number of relevant ones so far."""
    r = relevant(judged, any_judged).withColumn("__r", F.lit(1))
    j = run.select("query_id", "rank", "doc_id").join(r, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("__r", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("query_id", "rank", "doc_id", "rel", F.sum("rel").over(w).alias("found"))


def relevant_counts(judged: DataFrame, any_judged: bool = False) -> DataFrame:
    return relevant(judged, any_judged).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))


def _gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def ideal_gain(n: Column, k: int) -> Column:
    """Sum of the discounts of the first min(k, n) ranks."""
    terms = [F.when(n >= i, _gain(F.lit(float(i)))).otherwise(0.0) for i in range(1, k + 1)]
    return reduce(lambda a, b: a + b, terms)


def per_query(run: DataFrame, judged: DataFrame, cuts: Sequence[int] = CUTS, ap_cut: int = 100) -> DataFrame:
    """One row a judged query (with a relevant document) with every metric; unanswered ones are 0."""
    h = hits(run, judged)
    at = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))
    precision = F.when(F.col("rel") == 1, F.col("found") / F.col("rank")).otherwise(0.0)
    aggs = [
        F.count(F.lit(1)).alias("num_retrieved"),
        F.sum("rel").alias("num_found"),
        F.sum(precision).alias("__ap"),
        F.sum(F.when(F.col("rank") <= ap_cut, precision).otherwise(0.0)).alias("__apb"),
        at(ap_cut).alias("__nb"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("__first"),
        *[at(k).alias(f"__h{k}") for k in cuts],
        *[F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), _gain(F.col("rank"))).otherwise(0.0)).alias(f"__g{k}") for k in cuts],
    ]
    q = relevant_counts(judged).join(h.groupBy("query_id").agg(*aggs), "query_id", "left")
    n, got = F.col("n_relevant"), F.coalesce("num_retrieved", F.lit(0))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    cols = [
        F.col("query_id"),
        n.alias("num_relevant"),
        got.alias("num_retrieved"),
        F.coalesce("num_found", F.lit(0)).alias("num_found"),
        z(F.col("__ap") / n).alias("ap"),
        z(F.when(F.col("__nb") > 0, F.col("__apb") / F.col("__nb"))).alias("ap_b"),
        z(1.0 / F.col("__first")).alias("rr"),
    ]
    for k in cuts:
        hk = F.coalesce(f"__h{k}", F.lit(0))
        pb = F.when(got > 0, hk / F.least(got, F.lit(k))).otherwise(0.0)
        r = hk / n
        cols += [
            (hk / F.lit(float(k))).alias(f"p_at_{k}"),
            pb.alias(f"p_b_at_{k}"),
            F.when(got >= k, hk / F.lit(float(k))).alias(f"p_c_at_{k}"),
            r.alias(f"recall_at_{k}"),
            F.when(pb + r > 0, 2 * pb * r / (pb + r)).otherwise(0.0).alias(f"f1_at_{k}"),
            z(F.col(f"__g{k}") / ideal_gain(n, k)).alias(f"ndcg_at_{k}"),
        ]
    return q.select(*cols)


def average_precision_c(run: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, ap) of queries with a hit; any judged document counts."""
    h = hits(run, judged, any_judged=True).filter("rel = 1").groupBy("query_id").agg(F.sum(F.col("found") / F.col("rank")).alias("s"))
    return h.join(relevant_counts(judged, True), "query_id").select("query_id", (F.col("s") / F.col("n_relevant")).alias("ap"))


def mean_average_precision(run: DataFrame, judged: DataFrame) -> DataFrame:
    """One row; map counts unanswered queries as 0, map_answered leaves them out, map_c is of variant c."""
    q = per_query(run, judged, cuts=(10,))
    c = average_precision_c(run, judged).agg(F.avg("ap").alias("map_c"))
    return q.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("ap").alias("map"), F.avg(F.when(F.col("num_retrieved") > 0, F.col("ap"))).alias("map_answered"), F.avg("ap_b").alias("map_b")).crossJoin(F.broadcast(c))  # one row


def interpolated_precision(run: DataFrame, judged: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """(level, precision): mean over judged queries of the largest precision where recall reaches the level."""
    h = hits(run, judged).join(relevant_counts(judged), "query_id")
    best = lambda x: F.max(F.when(F.col("found") / F.col("n_relevant") >= x - 1e-12, F.col("found") / F.col("rank")))
    q = h.groupBy("query_id").agg(*[best(x).alias(f"l{i}") for i, x in enumerate(levels)])
    all_ = relevant_counts(judged).select("query_id").join(q, "query_id", "left")
    one = all_.agg(*[F.avg(F.coalesce(f"l{i}", F.lit(0.0))).alias(f"l{i}") for i in range(len(levels))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"l{i}").alias("precision")) for i, x in enumerate(levels)])).alias("x")).select("x.level", "x.precision")


def precision_where_relevant(run: DataFrame, judged: DataFrame, cuts: Sequence[int] = (5, 10, 20, 50, 100), any_judged: bool = True) -> DataFrame:
    """(cut, precision, n): precision at a cut, over queries whose document at that rank is relevant."""
    h = hits(run, judged, any_judged).filter((F.col("rel") == 1) & F.col("rank").isin(*cuts))
    return h.groupBy(F.col("rank").alias("cut")).agg(F.avg(F.col("found") / F.col("rank")).alias("precision"), F.count(F.lit(1)).alias("n"))


def summary(scored: DataFrame, cuts: Sequence[int] = CUTS, targets: Sequence[float] = (0.2, 0.3, 0.4)) -> DataFrame:
    """One row over per_query results."""
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    one = scored.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.sum(F.when(F.col("num_retrieved") > 0, 1).otherwise(0)).alias("n_answered"),
        F.avg("num_relevant").alias("mean_relevant"),
        F.avg("num_retrieved").alias("mean_retrieved"),
        F.avg("ap").alias("map"),
        F.avg("rr").alias("mrr"),
        *[mean(f"{m}_{k}") for k in cuts for m in ("p_at", "recall_at", "f1_at", "ndcg_at")],
    )
    return one.select("*", *[(F.col("map") >= t).alias(f"map_reaches_{str(t).replace('.', '_')}") for t in targets])


def extremes(scored: DataFrame, n: int = 10) -> DataFrame:
    """The n best and n worst queries by average precision; ties by query."""
    best = scored.orderBy(F.round("ap", 9).desc(), "query_id").limit(n).select(F.lit("best").alias("end"), "query_id", "ap")
    worst = scored.orderBy(F.round("ap", 9).asc(), "query_id").limit(n).select(F.lit("worst").alias("end"), "query_id", "ap")
    return best.unionByName(worst)


def distribution(scored: DataFrame) -> DataFrame:
    """One row: spread of average precision and buckets, both sets of bounds."""
    c = lambda x: F.sum(F.when(x, 1).otherwise(0))
    ap = F.col("ap")
    return scored.agg(
        F.avg(ap).alias("mean"), F.percentile(ap, 0.5).alias("median"), F.stddev_pop(ap).alias("std"), F.min(ap).alias("min"), F.max(ap).alias("max"),
        c(ap >= 0.5).alias("good"), c((ap >= 0.2) & (ap < 0.5)).alias("fair"), c((ap > 0) & (ap < 0.2)).alias("poor"), c(ap == 0).alias("none"),
        c(ap > 0.5).alias("above_0_5"), c(ap > 0.3).alias("above_0_3"), c(ap > 0.1).alias("above_0_1"),
    )


def compare(a: DataFrame, b: DataFrame, columns: Sequence[str] = ("ap", "rr", "p_at_10", "recall_at_10")) -> DataFrame:
    """(metric, a, b, delta) of two methods over the queries both scored."""
    j = a.select("query_id", *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select("query_id", *[F.col(c).alias(f"b_{c}") for c in columns]), "query_id")
    one = j.agg(*[F.avg(f"{s}_{c}").alias(f"{s}_{c}") for s in "ab" for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b"), (F.col(f"b_{c}") - F.col(f"a_{c}")).alias("delta")) for c in columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def judgment_stats(judged: DataFrame) -> DataFrame:
    """One row: relevant documents of a query."""
    return relevant_counts(judged).agg(F.count(F.lit(1)).alias("n_queries"), F.avg("n_relevant").alias("mean"), F.min("n_relevant").alias("min"), F.max("n_relevant").alias("max"))
