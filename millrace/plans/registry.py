"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from millrace.plans import conversation, evaluation, files, integrity, lexical, storage, texts, vectors

MODULES = (integrity, texts, lexical, vectors, evaluation, conversation, storage, files)
FLAGSHIP = "eval_per_query"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
