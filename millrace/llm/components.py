"""Groups of records that are linked directly or through others (problem 4).

The graph is reduced before it is solved. Rounds of

1. stripping: a vertex with one neighbour leaves and remembers that neighbour;
2. compressing: maximal chains of vertices with two neighbours are ranked by pointer jumping (each round doubles the
   distance a pointer spans), their inner vertices leave and remember one end, one edge joins the two ends;

go on while they remove a tenth of the vertices. The core is then contracted: every vertex points to its smallest
neighbour, if that is smaller than itself, pointers are doubled until they reach a root, and edges are drawn between
roots. Once no more than CORE_ARCS arcs are left after a round (they are counted), one task of an executor solves them by the same two
steps in memory. Labels go back to the removed vertices in the reverse order of their removal.

Ranking ends when no more than a tenth of the chains' arcs are open: what is left of long chains and of circles stays in
the core, whose connections the removed vertices' edges keep.

Nothing but counts comes to the driver. Degrees and smallest neighbours are sums and minima that are combined before
the shuffle, so a hub costs one row a map task; joins against the edges of a hub are split by adaptive execution. Each
round is cut with checkpoint(). Joins are shuffled merge joins throughout: the sizes are unknown, and hash tables of many
rounds would pile up on the driver.

Defined cases: edges with a null end are no edges; repeated edges and both directions count once; an edge from a record
to itself makes a group of one; empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

#: Reduction goes on while a round removes at least this share of the vertices.
WORTH = 0.1
#: So many arcs (both directions of an edge count) are solved in one task.
CORE_ARCS = 1_000_000


def _strip(arcs: DataFrame) -> DataFrame:
    """(v, to): vertices with one neighbour; of two that have only each other, the larger."""
    ends = arcs.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).filter("n = 1")
    pairs = ends.groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u"), F.min("v").alias("v"))
    alone = F.col("n") == 2
    return pairs.select(F.when(alone, F.col("hi")).otherwise(F.col("u")).alias("v"), F.when(alone, F.col("lo")).otherwise(F.col("v")).alias("to"))


def _without(arcs: DataFrame, gone: DataFrame) -> DataFrame:
    left = arcs.join(gone.select(F.col("v").alias("u")).hint("merge"), "u", "left_anti")
    return left.join(gone.select("v").hint("merge"), "v", "left_anti").select("u", "v")


def _chains(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inner vertices of chains with one end (v, to), and the edges that join the ends (u, v both ways)."""
    two = cut(arcs.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).filter("n = 2").drop("n"))
    inner = two.select(F.col("u").alias("v"))
    # An arc (u, v) stands at its head; if the head is inner, its successor leaves the head by the other side.
    out = two.select("u", F.explode(F.array("a", "b")).alias("v"))
    mid = two.select(F.col("u").alias("v"), "a", "b")
    step = out.join(mid.hint("merge"), "v", "left").select(
        "u",
        "v",
        F.when(F.col("a").isNull(), F.col("u")).otherwise(F.col("v")).alias("hu"),
        F.when(F.col("a").isNull(), F.col("v")).when(F.col("a") == F.col("u"), F.col("b")).otherwise(F.col("a")).alias("hv"),
        F.col("a").isNull().alias("done"),
    )
    step = cut(step)
    n, n_before = step.count(), None
    while True:
        # done: the head is the end of the chain
        n_open = step.filter(~F.col("done")).count()
        if n_open <= WORTH * n or n_open == n_before:  # what stays open runs in circles; the core takes it
            break
        n_before = n_open
        jump = step.select(F.col("u").alias("hu"), F.col("v").alias("hv"), F.col("hu").alias("ju"), F.col("hv").alias("jv"), F.col("done").alias("jd"))
        there = step.filter(~F.col("done")).join(jump.hint("merge"), ["hu", "hv"], "left").select(
            "u",
            "v",
            F.coalesce("ju", "hu").alias("hu"),
            F.coalesce("jv", "hv").alias("hv"),
            F.coalesce("jd", F.lit(True)).alias("done"),
        )
        step = cut(step.filter("done").unionByName(there))
    ends = step.filter("done").groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("hv").alias("lo"), F.max("hv").alias("hi")).filter("n = 2")
    ends = cut(ends.select(F.col("u").alias("v"), F.col("lo").alias("to"), "hi"))
    joined = ends.filter("to <> hi").select(F.col("to").alias("u"), F.col("hi").alias("v")).distinct()
    return ends, joined.unionByName(joined.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _contract(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round on the core: (v, to) for what was merged into a root, and the edges between roots."""
    point = arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("to"))
    point = cut(point)
    while True:
        up = point.select(F.col("v").alias("to"), F.col("to").alias("up"))
        nxt = cut(point.join(up.hint("merge"), "to", "left").select("v", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")))
        point = nxt.select("v", "to")
        if nxt.filter("moved").isEmpty():
            break
    rest = arcs.join(point.select(F.col("v").alias("u"), F.col("to").alias("ru")).hint("merge"), "u").join(point.select("v", F.col("to").alias("rv")).hint("merge"), "v")
    rest = rest.filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct()
    return point.filter("v <> to"), cut(rest)


def solve(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The root, the smallest vertex of its group, of each vertex 0 .. max; u and v are the ends of edges."""
    n = int(max(u.max(), v.max())) + 1 if len(u) else 0
    root = np.arange(n)
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return root


def _solve_in_one_task(arcs: DataFrame) -> DataFrame:
    """(v, to): the vertices that are no root of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got)
        names = pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]).dictionary_encode().combine_chunks()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        order = names.dictionary.to_numpy(zero_copy_only=False).argsort(kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[names.indices.to_numpy()]
        root = solve(at[: t.num_rows], at[t.num_rows :])
        moved = np.flatnonzero(root != np.arange(len(root)))
        values = names.dictionary.take(pa.array(order))
        yield pa.RecordBatch.from_arrays([values.take(pa.array(moved)), values.take(pa.array(root[moved]))], ["v", "to"])

    kind = dict(arcs.dtypes)["u"]
    return arcs.filter("u < v").select("u", "v").repartition(1).mapInArrow(run, f"v {kind}, to {kind}")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(record, root) for every record of the edges; root is one record of its group."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    e = cut(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    selves = e.filter("u = v").select(F.col("u").alias("record"))
    e = e.filter("u <> v")
    arcs = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    removed: list[DataFrame] = []
    left = arcs.select("u").distinct().count()
    while left:
        before = left
        while left:
            gone = cut(_strip(arcs))
            n = gone.count()
            if n == 0:
                break
            removed.append(gone)
            arcs, left = cut(_without(arcs, gone)), left - n
            if n < WORTH * (left + n):
                break
        if not left or arcs.isEmpty():
            break
        ends, joined = _chains(arcs)
        n = ends.count()
        if n:
            removed.append(ends.select("v", "to"))
            arcs = cut(_without(arcs, ends).unionByName(joined).distinct())
            left -= n
        if before - left < WORTH * before or arcs.count() <= CORE_ARCS:
            break
    while n := arcs.count() if left else 0:
        if n <= CORE_ARCS:
            removed.append(cut(_solve_in_one_task(arcs)))
            break
        gone, arcs = _contract(arcs)
        removed.append(gone)
    known: DataFrame | None = None
    for gone in reversed(removed):
        if known is None:
            known = gone.select(F.col("v").alias("record"), F.col("to").alias("root"))
            continue
        up = known.select(F.col("record").alias("to"), "root")
        some = gone.join(up.hint("merge"), "to", "left").select(F.col("v").alias("record"), F.coalesce("root", "to").alias("root"))
        known = known.unionByName(cut(some))
    alone = selves.withColumn("root", F.col("record"))
    if known is None:
        return alone
    known = known.unionByName(known.select(F.col("root").alias("record"), "root").distinct())
    return known.unionByName(alone.join(known.hint("merge"), "record", "left_anti"))


def label_by_least(members: DataFrame, value: str) -> DataFrame:
    """Give every record of a group the least non-null value of its members; members has record, root and value."""
    least = members.groupBy("root").agg(F.min(value).alias("label"))
    return members.join(least.hint("merge"), "root").select("record", "label")
