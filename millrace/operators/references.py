"""Finding references to rows that do not exist (problem 2).

References are grouped by their null mask: which of the key columns are null. Each mask is anti-joined on its
non-null columns only, under one of the three match rules of the SQL standard:

simple    a reference with any null column is not checked;
partial   the non-null columns must occur together in some parent row; all null is not checked;
full      either all columns are null (not checked) or none; a mixture is an orphan.

With times, a parent counts only while it exists: from valid_from (null: always was) until before valid_to (null:
still is), looked at when the reference was made. A reference without a time is checked for existence alone.

Repeated references are all reported, each row once. Extra columns pass through; the two sides may share column names.
Empty tables are allowed: without parents every checked reference is an orphan.

Physical plan: one shuffle of the pruned references on the key, none if Spark measures the parents as broadcastable.
A key that holds a large share of the references lands in one shuffle partition; adaptive execution splits that
partition for anti joins, the parent side being one row a key. Nothing is gathered by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def null_mask(columns: Sequence[str]) -> Column:
    """Bit i is set if the i-th column is null."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)])


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    keys: Sequence[tuple[str, str]],
    match: str = "simple",
    ref_time: str | None = None,
    valid_from: str | None = None,
    valid_to: str | None = None,
) -> DataFrame:
    """The rows of refs whose parent is missing, with their null_mask; keys pairs columns of refs and of parents."""
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if not 1 <= len(keys) <= 8:
        raise ValueError("between one and eight key columns")
    own = [k for k, _ in keys]
    n = len(keys)
    out = []
    for mask in range(1 << n):
        nulls = bin(mask).count("1")
        if nulls == n or (nulls and match == "simple"):
            continue
        # static conditions on each column, so that they reach the scan
        part = refs.filter(reduce(lambda a, b: a & b, [F.col(c).isNull() if mask >> i & 1 else F.col(c).isNotNull() for i, c in enumerate(own)]))
        part = part.withColumn("null_mask", F.lit(mask))
        if nulls and match == "full":
            out.append(part)
            continue
        used = [(c, p) for i, (c, p) in enumerate(keys) if not mask >> i & 1]
        side = parents.select(
            *[F.col(p).alias(f"__p{i}") for i, (_, p) in enumerate(used)],
            *([F.col(valid_from).alias("__from")] if valid_from else []),
            *([F.col(valid_to).alias("__to")] if valid_to else []),
        )
        if nulls:  # a part of the key repeats
            side = side.distinct()
        on = reduce(lambda a, b: a & b, [part[c] == side[f"__p{i}"] for i, (c, _) in enumerate(used)])
        if ref_time and valid_from:
            on &= part[ref_time].isNull() | side["__from"].isNull() | (side["__from"] <= part[ref_time])
        if ref_time and valid_to:
            on &= part[ref_time].isNull() | side["__to"].isNull() | (side["__to"] > part[ref_time])
        out.append(part.join(side, on, "left_anti"))
    if not out:
        return refs.withColumn("null_mask", F.lit(0)).limit(0)
    return reduce(DataFrame.unionByName, out)


def orphan_report(orphans: DataFrame, by_table: str, at: str) -> DataFrame:
    """Number of orphan references for each table and month (month is null where the time is)."""
    return orphans.groupBy(F.col(by_table).alias("ref_table"), F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))
