"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def run_sql(sql: str, d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(d).glob("*.parquet")):
        f = str(p) if p.is_file() else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{f}')")
    rel = con.execute(sql)
    return [c[0] for c in rel.description], rel.fetchall()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, d: str) -> None:
    columns, rows = run_sql(sql, d)
    assert sorted(columns) == sorted(df.columns), (columns, df.columns)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows_of(columns, rows)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs):
        assert a == b, (a, b)
