r"""Text cleaners as Column expressions.

A cleaner is a sequence of rules, each a (kind, argument...) tuple, folded into one expression that stays inside
whole-stage code generation. Null text gives an empty string. Patterns use the Unicode flag and a white-space class with
the four information separators, so that they mean what they mean in Python.

Kinds: lower; plain (old, new): literal replacement; regex (pattern, new); strip; nfkd (an Arrow function);
tokens (a function of the token array).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import wordlists as wl

Rule = tuple
#: White space as a class body.
S = r"\s\x1c-\x1f"
# Patterns, fixed values.
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
URL_BARE = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
URL_OR_WWW = rf"https?://[^{S}]+|www\.[^{S}]+"
WEB = rf"http[^{S}]+|www[^{S}]+|https[^{S}]+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
AT = rf"[^{S}]+@[^{S}]+"
TAG = r"<[^\n]*?>"
YEAR, DECIMAL, ORDINAL, NUMBER = r"\b(19|20)\d{2}\b", r"\b\d+\.\d+\b", r"\b\d+(?:st|nd|rd|th)\b", r"\b\d+\b"
HYPHEN = r"\b(\w+)-(\w+)\b"


def plain(pairs: Sequence[tuple[str, str]]) -> list[Rule]:
    return [("plain", a, b) for a, b in pairs]


def whole_words(pairs: Sequence[tuple[str, str]]) -> list[Rule]:
    return [("regex", rf"\b{a}\b", b) for a, b in pairs]


SQUEEZE: list[Rule] = [("regex", rf"[{S}]+", " "), ("strip",)]
NUMBERS_AS_WORDS: list[Rule] = [("regex", YEAR, " YEAR "), ("regex", DECIMAL, " DECIMAL "), ("regex", ORDINAL, " ORDINAL "), ("regex", NUMBER, " NUMBER ")]
EMPHASIS: list[Rule] = [("regex", "[!]{2,}", " EMPHASIS "), ("regex", "[?]{2,}", " MULTIQUEST "), ("regex", "[.]{3,}", " ELLIPSIS ")]


def unified(dataset: str) -> list[Rule]:
    """T1. The number, e-mail, hyphen and white-space rules of this cleaner never fire; the class keeps what is listed."""
    table = {"quora": wl.CONTRACTIONS_UNIFIED_QUORA, "antique": wl.CONTRACTIONS_UNIFIED_ANTIQUE}[dataset]
    return [
        ("lower",), *plain(table), ("regex", URL, " "), ("regex", TAG, " "), ("regex", "[!]{2,}", " "), ("regex", "[?]{2,}", " "), ("regex", "[.]{3,}", " "),
        ("regex", r"[^a-zA-Z0-9\\\]^_s]", " "), ("regex", r"\\s+", " "), ("strip",),
    ]


def question(keep_apostrophe: bool = True) -> list[Rule]:
    """T2, and T3 without apostrophes."""
    kept = "[^a-zA-Z0-9" + S + r"\-'_]" if keep_apostrophe else "[^a-zA-Z0-9" + S + r"\-_]"
    return [
        ("lower",), *plain(wl.CONTRACTIONS_QUESTION), *whole_words(wl.QUESTION_PATTERNS), ("regex", URL, " URL "), ("regex", EMAIL, " EMAIL "), ("regex", TAG, " "),
        *NUMBERS_AS_WORDS, *EMPHASIS, ("regex", kept, " "), ("regex", HYPHEN, "$1 $2 $1$2"), *SQUEEZE,
    ]


def answer_hybrid() -> list[Rule]:
    """T4."""
    return [
        ("lower",), *plain(wl.CONTRACTIONS_QUESTION), ("regex", URL, " "), ("regex", EMAIL, " "), ("regex", TAG, " "),
        *[("regex", p, " ") for p in (YEAR, DECIMAL, ORDINAL, NUMBER)], *EMPHASIS, ("regex", "[^a-zA-Z0-9" + S + r"\-_]", " "), ("regex", HYPHEN, "$1 $2 $1$2"), *SQUEEZE,
    ]


def answer_embedding(keep_hyphen: bool = False) -> list[Rule]:
    """T5; with hyphens as in its training twin."""
    kept = r"""[^a-zA-Z0-9""" + S + r""".,;'"!?""" + ("-]" if keep_hyphen else "]")
    return [
        ("lower",), ("regex", URL_BARE, " url "), ("regex", TAG, " "), ("regex", r"\b\d{4}\b", " YEAR "), ("regex", DECIMAL, " DECIMAL "), ("regex", NUMBER, " NUMBER "),
        ("regex", "[!]{2,}", " EMPHASIS "), ("regex", "[?]{2,}", " QUESTION "), ("regex", kept, " "), *SQUEEZE,
    ]


def safe() -> list[Rule]:
    """No lower-casing."""
    return [("regex", URL_OR_WWW, ""), *SQUEEZE]


def advanced(remove_stopwords: bool = True) -> list[Rule]:
    """T7."""
    steps: list[Rule] = [
        ("lower",), ("regex", URL_OR_WWW, ""), ("regex", AT, ""), ("regex", "<[^>]+>", ""), ("regex", f"[^a-zA-Z0-9{S}]", ""), ("regex", r"\b\d{5,}\b", ""),
        ("regex", r"\b[b-hj-z]\b", ""),
    ]
    if remove_stopwords:
        steps.append(("tokens", lambda t: without(t, wl.STOP_ADVANCED)))
    return [*steps, *SQUEEZE]


def medical_base(training: bool = False) -> list[Rule]:
    """T8 and T9 up to their tokens."""
    table = wl.CONTRACTIONS_MEDICAL_TRAINING if training else wl.CONTRACTIONS_MEDICAL
    joins = whole_words(wl.MEDICAL_PHRASES) if training else []
    return [("lower",), *plain(table), *joins, ("regex", WEB, ""), ("regex", AT, ""), ("regex", f"[^a-zA-Z0-9{S}]", " "), *SQUEEZE]


def evaluation_base() -> list[Rule]:
    """T10 up to its tokens."""
    return [("lower",), ("regex", f"[^a-z0-9{S}]", ""), *SQUEEZE]


def loader_base() -> list[Rule]:
    """T11 up to its tokens."""
    return [("lower",), ("regex", "[^a-z]+", " "), ("strip",)]


def enhanced_base() -> list[Rule]:
    """T12."""
    return [
        ("nfkd",), ("regex", "<[^>]*>", ""), ("regex", WEB, ""), *[("regex", f"(?i){a}", b) for a, b in wl.CONTRACTIONS_ENHANCED], ("lower",),
        ("regex", "[^a-zA-Z0-9" + S + r"\-'.]", " "), *SQUEEZE,
    ]


def split_words(c: Column) -> Column:
    """Runs of what is not white space."""
    return F.filter(F.split(c, f"(?U)[{S}]+"), lambda t: t != "")


def without(tokens: Column, stop: Sequence[str]) -> Column:
    """Tokens that are not in a stop list."""
    return F.filter(tokens, lambda t: ~t.isin(*stop))


def nfkd(c: Column) -> Column:
    """Compatibility decomposition, in Arrow batches."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(c)


def clean(c: Column | str, rules: Sequence[Rule]) -> Column:
    """Fold a cleaner's rules over a text column."""
    out = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for kind, *a in rules:
        if kind == "lower":
            out = F.lower(out)
        elif kind == "plain":
            out = F.replace(out, F.lit(a[0]), F.lit(a[1]))
        elif kind == "regex":
            out = F.regexp_replace(out, "(?U)" + a[0], a[1])
        elif kind == "strip":
            out = F.regexp_replace(out, f"(?U)^[{S}]+|[{S}]+$", "")
        elif kind == "nfkd":
            out = nfkd(out)
        elif kind == "tokens":
            out = F.array_join(a[0](split_words(out)), " ")
        else:
            raise ValueError(kind)
    return out


CLEANERS: dict[str, Callable[[], list[Rule]]] = {
    "unified_quora": lambda: unified("quora"),
    "unified_antique": lambda: unified("antique"),
    "question": question,
    "question_serving": lambda: question(False),
    "answer_hybrid": answer_hybrid,
    "answer_embedding": answer_embedding,
    "answer_embedding_training": lambda: answer_embedding(True),
    "safe": safe,
    "advanced": advanced,
    "advanced_all_words": lambda: advanced(False),
    "medical": medical_base,
    "medical_training": lambda: medical_base(True),
    "evaluation": evaluation_base,
    "loader": loader_base,
    "enhanced": enhanced_base,
}


def synonyms(tokens: Column, table: dict[str, str]) -> Column:
    """Tokens through a literal map."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(m, t), t))


def mark_negations(tokens: Column) -> Column:
    """The token after a negator, unless it is the last or a negator itself, as NOT_token."""
    neg = lambda t: t.isin(*wl.NEGATORS)
    marked = F.transform(
        tokens,
        lambda t, i: F.when((i > 0) & (i < F.size(tokens) - 1) & ~neg(t) & neg(F.get(tokens, i - 1)), F.concat(F.lit("NOT_"), t)).otherwise(t),
    )
    return marked


def key_phrases(text: Column) -> Column:
    """The phrases that occur, spaces as underscores, in list order."""
    all_ = F.array(*[F.lit(p) for p in wl.KEY_PHRASES])
    return F.transform(F.filter(all_, lambda p: F.contains(text, p)), lambda p: F.replace(p, F.lit(" "), F.lit("_")))


def numeric_rule(tokens: Column) -> Column:
    """Tokens of one sign and numbers are dropped, but for years from 1000 to 2100."""
    digits = lambda t: t.rlike("^[0-9]+$")
    return F.filter(tokens, lambda t: (F.length(t) > 1) & (~digits(t) | ((F.length(t) == 4) & t.try_cast("int").between(1000, 2100))))


def cleaning_stats(raw: Column, cleaned: Column) -> dict[str, Column]:
    """T22."""
    raw = F.coalesce(raw, F.lit(""))
    return {
        "original_length": F.length(raw),
        "cleaned_length": F.length(cleaned),
        "original_words": F.size(split_words(raw)),
        "cleaned_words": F.size(split_words(cleaned)),
    }
