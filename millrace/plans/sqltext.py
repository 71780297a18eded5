"""SQL for the second engine that the queries are checked against: cleaners, tokenizers and TF-IDF tables as text."""

from __future__ import annotations

from collections.abc import Sequence

from millrace.functions import cleaning as cl
from millrace.functions import wordlists as wl
from millrace.operators.tfidf import Config

#: White space as a class body, spelled out.
SPACE = r"\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NUMBER = r"CAST(TRY_CAST(trim(doc_id, E' \t\r\n\x0b\x0c') AS DECIMAL(38,6)) AS BIGINT)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(xs: Sequence[str]) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


def pattern(p: str) -> str:
    return lit(p.replace(cl.S, SPACE))


def replaced(expr: str, p: str, new: str) -> str:
    new = new.replace("$1", r"\1").replace("$2", r"\2")
    return f"regexp_replace({expr}, {pattern(p)}, {lit(new)}, 'g')"


def clean(expr: str, rules: Sequence[tuple]) -> str:
    out = f"coalesce({expr}, '')"
    for kind, *a in rules:
        if kind == "lower":
            out = f"lower({out})"
        elif kind == "plain":
            out = f"replace({out}, {lit(a[0])}, {lit(a[1])})"
        elif kind == "regex":
            out = replaced(out, a[0], a[1])
        elif kind == "strip":
            out = replaced(out, f"^[{cl.S}]+|[{cl.S}]+$", "")
        elif kind == "tokens":
            out = f"array_to_string(list_filter({split(out)}, lambda t: NOT list_contains({words(wl.STOP_ADVANCED)}, t)), ' ')"
        else:
            raise ValueError(kind)
    return out


def split(expr: str) -> str:
    return f"regexp_extract_all({expr}, {lit(f'[^{SPACE}]+')})"


def kept(expr: str, condition: str) -> str:
    return f"list_filter({expr}, lambda t: {condition})"


def not_in(stop: Sequence[str]) -> str:
    return f"NOT list_contains({words(stop)}, t)"


def simple_tokens(expr: str) -> str:
    rules = [("lower",), ("strip",), *cl.plain(wl.CONTRACTIONS_SIMPLE), ("regex", rf"http[s]?://[^{cl.S}]+", ""), ("regex", cl.AT, ""), ("regex", f"[^a-zA-Z0-9{cl.S}]", " ")]
    return kept(split(clean(expr, rules)), f"length(t) >= 2 AND {not_in(wl.STOP_SIMPLE)}")


def ngram_lists(tokens: str, low: int, high: int) -> str:
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(tokens)
        else:
            parts.append(f"list_transform(generate_series(1, greatest(len({tokens}) - {n - 1}, 0)), lambda i: array_to_string(list_slice({tokens}, i, i + {n - 1}), ' '))")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def tfidf(config: Config, docs: str = "documents", text: str = "text") -> str:
    """CTEs toks, tc, v and w over a table of documents, without WITH."""
    tf = "1 + ln(tc.tf)" if config.sublinear else "tc.tf"
    limit = "" if config.max_features is None else f"ORDER BY cf DESC, term LIMIT {config.max_features}"
    return f"""
toks AS MATERIALIZED (SELECT doc_id, {simple_tokens(text)} AS toks FROM {docs}),
grams AS (SELECT doc_id, unnest({ngram_lists("toks", config.low, config.high)}) AS term FROM toks),
tc AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
nd AS (SELECT count(*) AS n FROM {docs}),
v0 AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tc GROUP BY 1),
v AS MATERIALIZED (SELECT term, df, CAST(cf AS BIGINT) AS cf, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM v0, nd WHERE df >= {config.min_df} AND df <= {config.max_df} * n {limit}),
w0 AS (SELECT tc.doc_id, tc.term, tc.tf, ({tf}) * v.idf AS w FROM tc JOIN v ON tc.term = v.term),
w AS MATERIALIZED (SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0)"""


def query_weights(config: Config, name: str, source: str, tokens: str) -> str:
    """CTE `name` (query_id, term, tf, weight) from a relation with query_id and a token list."""
    tf = "1 + ln(c.tf)" if config.sublinear else "c.tf"
    return f"""
{name}_g AS (SELECT query_id, unnest({ngram_lists(tokens, config.low, config.high)}) AS term FROM {source}),
{name}_c AS (SELECT query_id, term, count(*) AS tf FROM {name}_g GROUP BY 1, 2),
{name}_0 AS (SELECT c.query_id, c.term, c.tf, ({tf}) * v.idf AS w FROM {name}_c c JOIN v ON c.term = v.term),
{name} AS MATERIALIZED (SELECT query_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM {name}_0)"""


def ranked(scores: str, k: int | None, score: str = "score", columns: str = "") -> str:
    cut = "" if k is None else f" WHERE rank <= {k}"
    return f"SELECT * FROM (SELECT query_id, doc_id, {score}{columns}, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC NULLS LAST, doc_id) AS rank FROM {scores}){cut}"
