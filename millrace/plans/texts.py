"""Queries on cleaning and tokenizing, over all of quora_docs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import cleaning as cl
from millrace.functions import tokens as tk
from millrace.functions import wordlists as wl
from millrace.plans import sqltext as sq
from millrace.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quora_docs").select("id", "text")


def _one(name: str, make: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _docs(spark, d).select("id", make(F.col("text")).alias(name))


def _sql(name: str, expr: str) -> str:
    return f"SELECT id, {expr} AS {name} FROM quora_docs"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

for _name, _rules in cl.CLEANERS.items():
    QUERIES[f"clean_{_name}"] = _one("cleaned", lambda c, r=_rules: cl.clean(c, r()))
    if _name != "enhanced":  # NFKD isn't in SQL
        SQL[f"clean_{_name}"] = _sql("cleaned", sq.clean("text", _rules()))

for _name, _tokenizer in tk.TOKENIZERS.items():
    QUERIES[f"tokens_{_name}"] = _one("tokens", lambda c, t=_tokenizer: F.array_join(t(c), " "))


def _tokens_sql(inner: str) -> str:
    return _sql("tokens", f"array_to_string({inner}, ' ')")


_DASHES = "NOT regexp_full_match(t, '[_-]+')"
_BASE = {n: sq.split(sq.clean("text", r())) for n, r in cl.CLEANERS.items() if n != "enhanced"}
SQL["tokens_simple"] = _tokens_sql(sq.simple_tokens("text"))
SQL["tokens_unified_quora"] = _tokens_sql(sq.kept(_BASE["unified_quora"], f"length(t) >= 2 AND {sq.not_in([w for w in wl.STOP_ENGLISH if w not in wl.KEEP_QUESTION])} AND {_DASHES}"))
SQL["tokens_unified_antique"] = _tokens_sql(sq.kept(_BASE["unified_antique"], f"length(t) >= 2 AND {sq.not_in([w for w in wl.STOP_ENGLISH if w not in wl.KEEP_ANTIQUE])} AND {_DASHES}"))
SQL["tokens_question"] = _tokens_sql(sq.kept(_BASE["question"], f"length(t) >= 2 AND {sq.not_in([w for w in wl.STOP_ENGLISH if w not in wl.KEEP_QUESTION])} AND {_DASHES}"))
SQL["tokens_answer"] = _tokens_sql(sq.kept(_BASE["answer_hybrid"], f"{sq.not_in([w for w in wl.STOP_ENGLISH if w not in wl.KEEP_QUESTION])} AND {_DASHES}"))
SQL["tokens_whitespace"] = _tokens_sql(sq.split("coalesce(text, '')"))
SQL["tokens_alphanumeric"] = _tokens_sql(_BASE["evaluation"])
SQL["tokens_medical"] = _tokens_sql(sq.kept(_BASE["medical"], f"length(t) >= 2 AND regexp_full_match(t, '[a-z]+') AND {sq.not_in(wl.STOP_SERVING)}"))
SQL["tokens_medical_training"] = _tokens_sql(sq.kept(_BASE["medical_training"], f"length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+') AND {sq.not_in(wl.STOP_TRAINING)}"))

_LOWER = "lower(coalesce(text, ''))"
QUERIES["contractions"] = _one("expanded", lambda c: cl.clean(c, [("lower",), *cl.plain(wl.CONTRACTIONS_QUESTION)]))
SQL["contractions"] = _sql("expanded", sq.clean("text", [("lower",), *cl.plain(wl.CONTRACTIONS_QUESTION)]))
QUERIES["question_patterns"] = _one("normalised", lambda c: cl.clean(c, [("lower",), *cl.whole_words(wl.QUESTION_PATTERNS)]))
SQL["question_patterns"] = _sql("normalised", sq.clean("text", [("lower",), *cl.whole_words(wl.QUESTION_PATTERNS)]))
QUERIES["medical_phrases"] = _one("joined", lambda c: cl.clean(c, [("lower",), *cl.whole_words(wl.MEDICAL_PHRASES)]))
SQL["medical_phrases"] = _sql("joined", sq.clean("text", [("lower",), *cl.whole_words(wl.MEDICAL_PHRASES)]))
QUERIES["synonym_map"] = _one("tokens", lambda c: F.array_join(cl.synonyms(tk.medical(c, True), wl.SYNONYMS_TRAINING), " "))
_MAP = "MAP {" + ", ".join(f"{sq.lit(k)}: {sq.lit(v)}" for k, v in wl.SYNONYMS_TRAINING.items()) + "}"
_MED = sq.kept(_BASE["medical_training"], f"length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+') AND {sq.not_in(wl.STOP_TRAINING)}")
SQL["synonym_map"] = _tokens_sql(f"list_transform({_MED}, lambda t: coalesce({_MAP}[t], t))")
QUERIES["negation_mark"] = _one("tokens", lambda c: F.array_join(cl.mark_negations(tk.alphanumeric(c)), " "))
SQL["negation_mark"] = f"""WITH b AS (SELECT id, {_BASE["evaluation"]} AS ts FROM quora_docs)
SELECT id, array_to_string(list_transform(ts, lambda t, i: CASE WHEN i > 1 AND i < len(ts) AND NOT list_contains({sq.words(wl.NEGATORS)}, t)
  AND list_contains({sq.words(wl.NEGATORS)}, ts[i - 1]) THEN 'NOT_' || t ELSE t END), ' ') AS tokens FROM b"""
QUERIES["key_phrases"] = _one("phrases", lambda c: F.array_join(cl.key_phrases(F.lower(F.coalesce(c, F.lit("")))), " "))
SQL["key_phrases"] = _sql("phrases", f"array_to_string(list_transform({sq.kept(sq.words(wl.KEY_PHRASES), f'contains({_LOWER}, t)')}, lambda t: replace(t, ' ', '_')), ' ')")
QUERIES["distinct_tokens"] = _one("tokens", lambda c: F.array_join(F.array_distinct(tk.alphanumeric(c)), " "))
SQL["distinct_tokens"] = f"""WITH b AS (SELECT id, {_BASE["evaluation"]} AS ts FROM quora_docs)
SELECT id, array_to_string(list_filter(ts, lambda t, i: list_position(ts, t) = i), ' ') AS tokens FROM b"""
QUERIES["numeric_tokens"] = _one("tokens", lambda c: F.array_join(cl.numeric_rule(tk.alphanumeric(c)), " "))
SQL["numeric_tokens"] = _tokens_sql(sq.kept(_BASE["evaluation"], "length(t) > 1 AND (NOT regexp_full_match(t, '[0-9]+') OR (length(t) = 4 AND TRY_CAST(t AS INT) BETWEEN 1000 AND 2100))"))
QUERIES["bigrams"] = _one("grams", lambda c: F.array_join(tk.ngrams(tk.simple(c), 1, 2), "|"))
SQL["bigrams"] = f"WITH b AS (SELECT id, {sq.simple_tokens('text')} AS ts FROM quora_docs) SELECT id, array_to_string({sq.ngram_lists('ts', 1, 2)}, '|') AS grams FROM b"


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", F.size(tk.simple("text")).alias("n_tokens"))


def cleaning_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return docs.select("id", *[c.alias(n) for n, c in cl.cleaning_stats(F.col("text"), cl.clean("text", cl.medical_base())).items()])


def stemmed_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tk.composed(_docs(spark, d), "text", "serving").select("id", F.array_join("tokens", " ").alias("tokens"))


def stop_words_removed(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", F.array_join(cl.without(tk.alphanumeric("text"), wl.STOP_ENGLISH), " ").alias("tokens"))


def tokens_enhanced(spark: SparkSession, d: str) -> DataFrame:
    return tk.enhanced_tokens(_docs(spark, d), "text").select("id", F.array_join("tokens", " ").alias("tokens"))


QUERIES |= {f.__name__: f for f in (tokens_enhanced, token_counts, cleaning_stats, stemmed_tokens, stop_words_removed)}
SQL["token_counts"] = _sql("n_tokens", f"len({sq.simple_tokens('text')})")
_MEDICAL = sq.clean("text", cl.medical_base())
SQL["cleaning_stats"] = f"""SELECT id, length(coalesce(text, '')) AS original_length, length({_MEDICAL}) AS cleaned_length,
 len({sq.split("coalesce(text, '')")}) AS original_words, len({sq.split(_MEDICAL)}) AS cleaned_words FROM quora_docs"""
SQL["stop_words_removed"] = _tokens_sql(sq.kept(_BASE["evaluation"], sq.not_in(wl.STOP_ENGLISH)))
