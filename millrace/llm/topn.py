"""The N best items of every group, by secondary sort (problem 5).

Rows are hash-partitioned by group, sorted within partitions by group and the ranking columns, and streamed as Arrow
batches; what is kept between batches is the last group's key and at most N item keys. No group is ever buffered.

The same pass runs twice. First on every input partition as it lies, without a shuffle: at most N rows of a group leave
a partition, so a group with a third of all rows shrinks before it is shuffled. An item that is among the N best of its
group is among the N best distinct items of its group in the partition that holds its best row, hence nothing is lost.
The second pass, after the shuffle by group, gives the result.

Defined cases: rows with a null group or item don't count; an item counts once a group, by its best row; ties are
settled by the ranking columns, whose last must be the item, so the result is the same at any partitioning; null and
NaN handling is the caller's, by filter and by the order given; empty input gives an empty result; columns that are not
named are dropped before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _codes(a: pa.Array) -> np.ndarray:
    """Small integers that are equal where the values are."""
    if pa.types.is_integer(a.type):
        return a.to_numpy(zero_copy_only=False)
    return a.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def first_n(n: int, group: str, item: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A streaming pass over rows sorted by group and rank: the first n rows with different items of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, set()  # the group that the last batch ended in, and its items so far (n at most)
        for b in batches:
            if not b.num_rows:
                continue
            g, it = b.column(group), b.column(item)
            gc, ic = _codes(g), _codes(it)
            start = np.flatnonzero(np.r_[True, gc[1:] != gc[:-1]])
            run_of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(gc)]))
            # the first row of each (run, item): a stable sort keeps the rank order
            order = np.lexsort((ic, run_of))
            ro, io = run_of[order], ic[order]
            fresh = np.empty(len(order), bool)
            fresh[order] = np.r_[True, (ro[1:] != ro[:-1]) | (io[1:] != io[:-1])]
            before = 0
            if key is not None and g[0].as_py() == key:
                end = start[1] if len(start) > 1 else len(gc)
                before = len(seen)
                if before >= n:
                    fresh[:end] = False
                else:  # only rows up to the n-th of this group need looking at
                    head = np.flatnonzero(fresh[:end])
                    old = np.isin(_plain(it.take(pa.array(head))), list(seen)) if seen else np.zeros(len(head), bool)
                    fresh[head[old]] = False
            else:
                seen = set()
            rank = np.cumsum(fresh)
            rank -= np.r_[0, rank[start[1:] - 1]][run_of]
            rank[run_of == 0] += before
            keep = np.flatnonzero(fresh & (rank <= n))
            last = keep[run_of[keep] == len(start) - 1]
            if len(start) > 1:
                seen = set()
            seen.update(_plain(it.take(pa.array(last))).tolist())
            key = g[len(gc) - 1].as_py()
            if len(keep):
                yield b.take(pa.array(keep))

    return run


def _plain(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def top_n_per_group(rows: DataFrame, group: str, item: str, order: Sequence[tuple[str, str]], n: int, within: DataFrame | None = None) -> DataFrame:
    """The n best rows with different items of each group.

    order: (column, 'asc' | 'desc', nulls last in both) pairs; the item is added as the last, ascending.
    within: keep only groups that occur in this table's column of the same name.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    columns = list(dict.fromkeys([group, item, *[c for c, _ in order]]))
    by: list[Column] = [F.col(group)]
    by += [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in order]
    by.append(F.col(item).asc())
    rows = rows.select(*columns).filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    stream = first_n(n, group, item)
    some = rows.sortWithinPartitions(*by).mapInArrow(stream, rows.schema)
    if within is not None:
        some = some.join(within.select(group).filter(F.col(group).isNotNull()).distinct(), group, "left_semi")
    return some.repartition(group).sortWithinPartitions(*by).mapInArrow(stream, rows.schema)
