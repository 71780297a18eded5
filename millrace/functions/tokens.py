"""Tokenizers: Column of text to Column of token arrays, with pluggable lemmas; stemming over distinct tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import cleaning as cl
from millrace.functions import wordlists as wl
from millrace.functions.porter import stem


def _keeping(stop: Sequence[str], keep: Sequence[str]) -> tuple[str, ...]:
    kept = set(keep)
    return tuple(w for w in stop if w not in kept)


def not_only_dashes(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike(r"^[_\-]+$"))


def at_least(tokens: Column, n: int) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= n)


def simple(text: Column | str) -> Column:
    """Lower, contractions, no addresses, letters and digits, two signs at least, short stop list."""
    rules = [("lower",), ("strip",), *cl.plain(wl.CONTRACTIONS_SIMPLE), ("regex", rf"http[s]?://[^{cl.S}]+", ""), ("regex", cl.AT, ""), ("regex", f"[^a-zA-Z0-9{cl.S}]", " "), *cl.SQUEEZE]
    return cl.without(at_least(cl.split_words(cl.clean(text, rules)), 2), wl.STOP_SIMPLE)


def unified(text: Column | str, dataset: str = "quora", stop: Sequence[str] = wl.STOP_ENGLISH) -> Column:
    """N1."""
    keep = wl.KEEP_QUESTION if dataset == "quora" else wl.KEEP_ANTIQUE
    t = cl.split_words(cl.clean(text, cl.unified(dataset)))
    return not_only_dashes(cl.without(at_least(t, 2), _keeping(stop, keep)))


def question(text: Column | str, stop: Sequence[str] = wl.STOP_ENGLISH, keep_apostrophe: bool = True) -> Column:
    """N2."""
    t = cl.split_words(cl.clean(text, cl.question(keep_apostrophe)))
    return not_only_dashes(cl.without(at_least(t, 2), _keeping(stop, wl.KEEP_QUESTION)))


def answer(text: Column | str, stop: Sequence[str] = wl.STOP_ENGLISH) -> Column:
    """No least length."""
    t = cl.split_words(cl.clean(text, cl.answer_hybrid()))
    return not_only_dashes(cl.without(t, _keeping(stop, wl.KEEP_QUESTION)))


def whitespace(text: Column | str) -> Column:
    """N5."""
    return cl.split_words(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def alphanumeric(text: Column | str) -> Column:
    """Lower case, whatever is no letter, digit or white space dropped."""
    return cl.split_words(cl.clean(text, cl.evaluation_base()))


def medical(text: Column | str, training: bool = False) -> Column:
    """T8 or T9 before stemming: letters only (serving) or anything but whole numbers (training), stop list."""
    t = at_least(cl.split_words(cl.clean(text, cl.medical_base(training))), 2)
    if training:
        return cl.without(F.filter(t, lambda x: ~x.rlike("^[0-9]+$")), wl.STOP_TRAINING)
    return cl.without(F.filter(t, lambda x: x.rlike("^[a-z]+$")), wl.STOP_SERVING)


def loaded(text: Column | str) -> Column:
    """T11 without lemmas: runs of letters but stop words."""
    return cl.without(cl.split_words(cl.clean(text, cl.loader_base())), wl.STOP_ENGLISH)


def enhanced_tokens(docs: DataFrame, text: str, name: str = "tokens", stop: Sequence[str] = wl.STOP_ENGLISH) -> DataFrame:
    """T12, T18-T21 in order: negations marked, numbers and stop words dropped, key phrases added, each token once.

    On a table rather than a column: the decomposition runs in Python and must not end up inside a lambda.
    """
    d = docs.withColumn("__n", cl.nfkd(F.coalesce(text, F.lit(""))))
    cleaned = cl.clean("__n", cl.enhanced_base()[1:])
    t = cl.numeric_rule(cl.mark_negations(cl.split_words(cleaned)))
    t = cl.without(t, _keeping(stop, wl.KEEP_ENHANCED))
    return d.withColumn(name, F.array_distinct(F.concat(t, cl.key_phrases(cleaned)))).drop("__n")


def _joined(tokens: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.array_join(F.slice(tokens, i, n), " ")


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams of low to high tokens, joined by spaces, shorter ones first."""
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(tokens)
            continue
        last = F.size(tokens) - (n - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, _joined(tokens, n)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


TOKENIZERS: dict[str, Callable[[Column | str], Column]] = {
    "simple": simple,
    "unified_quora": unified,
    "unified_antique": lambda c: unified(c, "antique"),
    "question": question,
    "answer": answer,
    "whitespace": whitespace,
    "alphanumeric": alphanumeric,
    "medical": medical,
    "medical_training": lambda c: medical(c, True),
}


def map_tokens(docs: DataFrame, key: str, tokens: str, table: DataFrame, form: str = "form", lemma: str = "lemma") -> DataFrame:
    """Replace tokens by a (form, lemma) table, order kept; unknown forms stay. The table may be of any size."""
    e = docs.select(key, F.posexplode(tokens).alias("__p", "__t"))
    known = table.groupBy(F.col(form).alias("__t")).agg(F.min(lemma).alias("__l"))
    e = e.join(known, "__t", "left").select(key, F.struct("__p", F.coalesce("__l", "__t").alias("t")).alias("__s"))
    got = e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("__s")), lambda s: s["t"]).alias(tokens))
    return docs.drop(tokens).join(got, key, "left").withColumn(tokens, F.coalesce(tokens, F.array().cast("array<string>")))


_STEMS: dict[str, str] = {}
#: Words whose stems a worker keeps.
MOST_STEMS = 500_000


def _stemmed(batch: pd.Series) -> pd.Series:
    if len(_STEMS) > MOST_STEMS:
        _STEMS.clear()

    def one(w: str) -> str:
        s = _STEMS.get(w)
        if s is None:
            s = _STEMS[w] = stem(w)
        return s

    return batch.map(lambda ts: None if ts is None else [one(t) for t in ts if t is not None])


def stemmed(tokens: Column | str) -> Column:
    """N10 on arrays in Arrow batches, each different word of a worker once; no shuffle."""
    return F.pandas_udf(_stemmed, "array<string>")(tokens)


#: T8-T10 whole: tokens before stemming, and the synonyms that follow it. Lemmas come from a table, where there is one.
COMPOSED: dict[str, tuple[Callable[[Column | str], Column], dict[str, str]]] = {
    "serving": (medical, wl.SYNONYMS_SERVING),
    "training": (lambda c: medical(c, True), wl.SYNONYMS_TRAINING),
    "evaluation": (lambda c: cl.without(alphanumeric(c), wl.STOP_ENGLISH), {}),
}


def composed(docs: DataFrame, text: str, name: str, out: str = "tokens") -> DataFrame:
    """T8, T9 or T10: clean, split, filter, stem, then synonyms of the stems.

    On a table: the stemmer runs in Python and must not end up inside a lambda.
    """
    base, synonyms = COMPOSED[name]
    d = docs.withColumn("__w", base(text)).withColumn("__s", stemmed("__w"))
    return d.withColumn(out, cl.synonyms(F.col("__s"), synonyms) if synonyms else F.col("__s")).drop("__w", "__s")


def stems(distinct_tokens: DataFrame, column: str) -> DataFrame:
    """(form, lemma) for a table of tokens, each stemmed once."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame({"form": p[column], "lemma": p[column].map(stem)})

    return distinct_tokens.select(column).filter(F.col(column).isNotNull()).distinct().mapInPandas(run, "form string, lemma string")


def stem_tokens(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """Stem every token of every document; the algorithm runs over distinct tokens only."""
    table = stems(docs.select(F.explode(tokens).alias("t")), "t")
    return map_tokens(docs, key, tokens, table)
