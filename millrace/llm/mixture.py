"""Mixing sources to target shares of a total size (problem 8).

A source with target T tokens and A tokens available is to be used T / A times. The whole part of that is allocated to
each of its documents as certain copies, up to max_repeats. The rest is a sample by Pareto order sampling: a document
with inclusion odds l / (1 - l) gets the ranking number (U / (1 - U)) / (l / (1 - l)), U being a uniform number made from
its identifier and the seed, and the documents with the smallest ranking numbers are taken until their tokens fill the
rest. Inclusion probabilities are proportional to the documents' weights, such that the expected tokens are what is
missing. Where that asks for more than 1, the document is certain and the others share what is left, until none asks for
more: this is solved from the tokens by source and weight, weights being rounded to eighths of a power of two.

The fill needs no global sort: tokens are summed by source and by one of SLOTS slots of the ranking number; the slot in
which a source fills up is found from these sums, and only that slot's documents are ordered one by one. No source is
ever in one task, however large. What is missing then is less than one document; FILLS times the largest document not
yet taken that still fits is added.

Result: totals and shares are reached to within the smallest documents where the source has enough; a source that is
too small is used max_repeats times whole, and what it lacks is reported, not taken from others.

Defined cases: source names count as equal without regard to case, surrounding spaces and the kind of separator; null
sources, sources without a target and texts of no tokens are not used (the first two are reported with target 0);
targets without documents are reported with nothing; null, negative or NaN shares and repeats count as 0; a repeated
identifier is used once; ties in the ranking number go to the smaller identifier; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import stripped
from millrace.session import cut

SLOTS = 4096
FILLS = 3
#: Steps of weights for each power of two.
STEPS = 8


def source_name(c: Column | str) -> Column:
    """One spelling for each source; null for blank names."""
    return F.nullif(F.regexp_replace(F.lower(stripped(c)), r"[\s\-_]+", "_"), F.lit(""))


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the key and the seed alone."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def plan_shares(sized: DataFrame, targets: DataFrame, total: Column, source: str = "source", share: str = "target_share", repeats: str = "max_repeats") -> DataFrame:
    """For each target: want, have, whole copies, the part still missing and its tokens."""
    good = lambda c: F.when(F.isnan(F.col(c).cast("double")) | (F.col(c) < 0), 0).otherwise(F.coalesce(c, F.lit(0)))
    t = targets.select(source_name(source).alias("source"), good(share).cast("double").alias("target_share"), good(repeats).cast("long").alias("max_repeats")).filter("source IS NOT NULL")
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count(F.lit(1)).alias("n_docs"), F.max("n_tokens").alias("largest"))
    all_ = have.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("corpus"))
    p = t.join(have, "source", "full_outer").crossJoin(F.broadcast(all_))  # one row
    p = p.withColumn("want", total * F.coalesce("target_share", F.lit(0.0)))
    times = F.col("want") / F.col("have")
    p = p.withColumn("whole", F.coalesce(F.least(F.floor(times), F.col("max_repeats")), F.lit(0)).cast("long"))
    p = p.withColumn("part", F.coalesce(F.when(F.col("whole") >= F.col("max_repeats"), 0.0).otherwise(times - F.col("whole")), F.lit(0.0)))
    return p.withColumn("need", F.col("part") * F.col("have"))


class Mixture:
    """documents() and shares() of one mixture; docs needs an identifier, a source and n_tokens."""

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str, source: str, total_tokens: int | None = None, of_corpus: float = 0.5, weight: str | None = None, seed: int = 1):
        w = F.coalesce(F.greatest(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
        sized = docs.select(F.col(key).alias("key"), source_name(source).alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), w.alias("weight")).filter("key IS NOT NULL")
        sized = sized.filter("n_tokens > 0").groupBy("key").agg(F.min(F.struct("source", "n_tokens", "weight")).alias("x")).select("key", "x.*")
        self.sized = cut(sized)
        total = F.lit(float(total_tokens)) if total_tokens is not None else F.col("corpus") * F.lit(of_corpus)
        self.plan = cut(plan_shares(self.sized, targets, total))
        # as many rows as there are targets and sources; checked before it is broadcast
        self.sides = self.plan.count()
        self.seed = seed

    def _small(self, df: DataFrame) -> DataFrame:
        """One row a source, or a few: broadcast if there are few sources."""
        return F.broadcast(df) if self.sides <= 100_000 else df

    def _inclusion(self, d: DataFrame) -> DataFrame:
        """(source, top, c): weights of steps above top are certain, others have the probability c times their weight."""
        sums = d.filter("part > 0 AND weight > 0").groupBy("source", "step").agg(F.sum("n_tokens").alias("t"), F.first("need").alias("need"))
        down = Window.partitionBy("source").orderBy(F.desc("step"))  # a row for each step of weights
        sums = sums.withColumn("w", F.pow(F.lit(2.0), F.col("step") / STEPS)).withColumn("above", F.sum("t").over(down) - F.col("t"))
        sums = sums.withColumn("rest", F.sum(F.col("w") * F.col("t")).over(down.rowsBetween(0, Window.unboundedFollowing)))
        c = (F.col("need") - F.col("above")) / F.col("rest")
        fits = sums.withColumn("c", c).filter("c >= 0 AND c * w <= 1 + 1e-9")
        return fits.groupBy("source").agg(F.max("step").alias("top"), F.max_by("c", "step").alias("c"))

    def documents(self) -> DataFrame:
        """(key, source, n_tokens, copies), copies at least 1."""
        p = self.plan.select("source", "whole", "part", "need").filter("source IS NOT NULL AND (whole > 0 OR part > 0)")
        d = self.sized.join(self._small(p), "source").withColumn("step", F.when(F.col("weight") > 0, F.round(F.log2("weight") * STEPS)))
        d = d.join(self._small(self._inclusion(d)), "source", "left")
        l = F.when(F.col("step") > F.col("top"), 1.0).otherwise(F.least(F.col("c") * F.pow(F.lit(2.0), F.col("step") / STEPS), F.lit(1.0)))
        d = d.withColumn("l", F.when(F.col("part") > 0, F.coalesce(l, F.lit(0.0))).otherwise(0.0))
        # the ranking number brought to (0, 1) by the source's own odds, so that slots are filled evenly
        u = uniform(F.col("key"), self.seed)
        odds = F.col("part") / (1 - F.col("part"))
        r = (u / (1 - u)) / (F.col("l") / (1 - F.col("l"))) * odds
        d = d.withColumn("r", F.when(F.col("l") >= 1, 0.0).when(F.col("l") > 0, r / (1 + r)))
        d = d.withColumn("slot", F.least(F.floor(F.col("r") * SLOTS), F.lit(SLOTS - 1)))
        sums = d.filter("slot IS NOT NULL").groupBy("source", "slot").agg(F.sum("n_tokens").alias("t"), F.first("need").alias("need"))
        w = Window.partitionBy("source").orderBy("slot")  # SLOTS rows a source at most
        sums = sums.withColumn("upto", F.sum("t").over(w)).withColumn("before", F.col("upto") - F.col("t"))
        full = sums.select("source", "slot", "before", (F.col("upto") <= F.col("need")).alias("all"), ((F.col("before") <= F.col("need")) & (F.col("upto") > F.col("need"))).alias("edge"))
        d = d.join(full.filter("all OR edge"), ["source", "slot"], "left").select("source", "key", "n_tokens", "whole", "part", "need", "r", "before", F.coalesce("all", F.lit(False)).alias("taken"), F.coalesce("edge", F.lit(False)).alias("edge"))
        order = Window.partitionBy("source").orderBy("r", "key")
        edge = d.filter("edge").withColumn("taken", F.col("before") + F.sum("n_tokens").over(order) <= F.col("need"))
        d = cut(d.filter("NOT edge").unionByName(edge).select("source", "key", "n_tokens", "whole", "part", "need", "r", "taken"))
        for _ in range(FILLS):
            gap = d.filter("part > 0").groupBy("source").agg((F.first("need") - F.sum(F.when(F.col("taken"), F.col("n_tokens")).otherwise(0))).alias("gap"))
            fits = d.filter("part > 0 AND NOT taken AND r IS NOT NULL").join(self._small(gap), "source").filter("n_tokens <= gap")
            best = fits.groupBy("source").agg(F.max_by("key", F.struct("n_tokens", -F.col("r"), "key")).alias("best"))
            d = d.join(self._small(best), "source", "left").withColumn("taken", F.col("taken") | F.coalesce(F.col("key") == F.col("best"), F.lit(False))).drop("best")
        return d.select("key", "source", "n_tokens", (F.col("whole") + F.col("taken").cast("long")).alias("copies")).filter("copies > 0")

    def shares(self) -> DataFrame:
        """For each target and source: target share, shares of the reached and the wanted total, tokens wanted and reached, documents, copies."""
        got = self.documents().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_used"), F.max("copies").alias("most_copies"))
        got = self.plan.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), "want", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("largest", F.lit(0)).alias("largest")).join(got, "source", "left")
        z = lambda c: F.coalesce(c, F.lit(0))
        got = got.select("source", "target_share", "max_repeats", "want", "n_docs", "have", "largest", z("tokens").alias("tokens"), z("n_used").alias("n_used"), z("most_copies").alias("most_copies"))
        total = got.agg(F.sum("tokens").alias("total"))
        got = got.crossJoin(F.broadcast(total))  # one row
        of_wanted = F.when(F.col("want") > 0, F.col("tokens") / F.col("want") * F.col("target_share"))
        return got.select("*", F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).alias("share"), of_wanted.alias("share_of_wanted"), (F.col("want") - F.col("tokens")).alias("lacking")).drop("total")
