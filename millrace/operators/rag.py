"""Retrieval-augmented conversation for batches of conversations.

messages: (conversation_id, turn, role, text, ts); context: (query_id, rank, document, similarity_score).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.cleaning import clean


@dataclass(frozen=True)
class Wording:
    """Fixed texts of one data set; {n} stands for a number."""

    heading: str
    nothing: str
    sure: str
    likely: str
    unsure: str
    others: str


# Fixed values.
WORDING = {
    "quora": Wording(
        "Relevant information from Quora:",
        "I couldn't find relevant information to answer your question.",
        "Based on similar questions from Quora, here's what I found:",
        "I found some related information that might help:",
        "Here's some potentially relevant information:",
        "I also found {n} other related questions that might be helpful.",
    ),
    "antique": Wording(
        "Relevant information from ANTIQUE:",
        "I couldn't find relevant information about antiques to answer your question.",
        "Based on antique documents, here's what I found:",
        "I found some related information about antiques that might help:",
        "Here's some potentially relevant information from antique documents:",
        "I also found {n} other related antique documents that might be helpful.",
    ),
}


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("turn"))
    return messages.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def live_conversations(messages: DataFrame, now: Column, ttl_seconds: int = 3600, most: int = 100) -> DataFrame:
    """conversation_ids kept: all while there are fewer than `most`, else those not older than the time to live."""
    last = messages.groupBy("conversation_id").agg(F.max("ts").alias("last_at"))
    n = last.agg(F.count(F.lit(1)).alias("__n"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_at")
    return last.crossJoin(F.broadcast(n)).filter((F.col("__n") < most) | (age <= ttl_seconds)).select("conversation_id", "last_at")  # one row


def without_conversations(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete."""
    return messages.join(ids.select("conversation_id").distinct(), "conversation_id", "left_anti")


def _lines(df: DataFrame, key: str, order: str, line: Column, name: str) -> DataFrame:
    """One text a key, lines in order; only for inputs bounded by key."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("s")))), lambda x: x["s"])
    return df.groupBy(key).agg(F.array_join(items, "\n").alias(name))


def capitalised(c: Column) -> Column:
    """First sign in upper, the rest in lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def prompts(questions: DataFrame, messages: DataFrame, context: DataFrame, dataset: str = "quora", history: int = 6, documents: int = 3, signs: int = 300) -> DataFrame:
    """(query_id, prompt). questions has query_id, conversation_id and text."""
    w = WORDING[dataset]
    recent = last_messages(messages, history)
    said = _lines(recent, "conversation_id", "turn", F.concat(capitalised(F.coalesce("role", F.lit("user"))), F.lit(": "), F.coalesce("text", F.lit(""))), "__said")
    docs = context.filter(F.col("rank") <= documents)
    read = _lines(docs, "query_id", "rank", F.concat(F.col("rank").cast("string"), F.lit(". "), F.substring(F.coalesce("document", F.lit("")), 1, signs)), "__read")
    j = questions.join(said, "conversation_id", "left").join(read, "query_id", "left")
    before = F.when(F.col("__said").isNotNull(), F.concat(F.lit("Previous conversation:\n"), "__said", F.lit("\n\n"))).otherwise("")
    body = F.when(F.col("__read").isNotNull(), F.concat(F.lit("\n"), "__read")).otherwise("")
    prompt = F.concat(before, F.lit(w.heading), body, F.lit("\n\nUser question: "), F.coalesce("text", F.lit("")), F.lit("\nAssistant:"))
    return j.select("query_id", prompt.alias("prompt"))


def template_answers(questions: DataFrame, context: DataFrame, dataset: str = "quora") -> DataFrame:
    """(query_id, answer) worded by the similarity of the best document."""
    w = WORDING[dataset]
    best = context.filter("rank = 1").select("query_id", F.coalesce("document", F.lit("")).alias("__d"), F.coalesce("similarity_score", F.lit(0.0)).alias("__s"))
    n = context.groupBy("query_id").agg(F.count(F.lit(1)).alias("__n"))
    j = questions.select("query_id").join(best, "query_id", "left").join(n, "query_id", "left")
    intro = F.when(F.col("__s") > 0.8, w.sure).when(F.col("__s") > 0.6, w.likely).otherwise(w.unsure)
    head, tail = w.others.split("{n}")
    more = F.when(F.col("__n") > 1, F.concat(F.lit("\n\n" + head), (F.col("__n") - 1).cast("string"), F.lit(tail))).otherwise("")
    return j.select("query_id", F.when(F.col("__d").isNull(), F.lit(w.nothing)).otherwise(F.concat(intro, F.lit("\n\n"), "__d", more)).alias("answer"))


def cleaned_answer(c: Column) -> Column:
    """Role labels removed, an unfinished last sentence of fewer than ten signs dropped."""
    strip = lambda x: clean(x, [("strip",)])
    t = strip(F.replace(c, F.lit("Assistant:"), F.lit("")))
    t = strip(F.replace(t, F.lit("User:"), F.lit("")))
    parts = F.split(t, r"\.")
    short = F.length(strip(F.element_at(parts, -1))) < 10
    kept = F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), "."), F.lit("."))
    return F.when((F.size(parts) > 1) & short, kept).otherwise(t)
