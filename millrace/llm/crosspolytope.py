"""The most similar vectors of every vector, by cross-polytope hashing (problem 6).

A table hashes a unit vector by pseudo-random rotations, each three rounds of random signs and a fast Hadamard
transform, and takes the signed axis nearest to the rotated vector; `hashes` of them make a bucket. Every vector lies in
one bucket of a table and looks into `probes` of them: its own and those that the next nearest axes give.

Buckets are joined in packed blocks of vectors quantised to one byte a coordinate. Per bucket and looking vector, what
may be among its k best is kept: the quantisation error of each vector is known and sent along, so nothing that can
belong to them is dropped. Kept pairs are ranked again with the exact cosine in doubles.

Hashing needs a least cosine. Without one (`least=None`) every two vectors are compared: they are dealt into blocks, and
each two blocks meet in one task, tile by tile, in single precision with room for its error, then in doubles for what may
be among the k best. That misses nothing, and its time grows with the square of the number of vectors.

Vectors with the same direction (to `DIGITS` decimals) make one class; only one vector of a class is hashed. Of a
class's members the k + 1 smallest identifiers are kept as its head, by partial selection, and each member gets its
partners from the heads: a third of all rows being one vector costs one entry.

Defined cases: null vectors, those with a wrong number of coordinates, a null, NaN or infinite one, or all zero are not
usable and have no partners; a repeated identifier counts once (the smallest packed vector); ties in
similarity go to the smaller identifier; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.textscan import mix
from millrace.session import cut

DIGITS = 6
BLOCK = 2048
#: Vectors in a block of the comparison of all, and the least number of blocks (each two are a task).
GRID_ROWS, GRID_BLOCKS = 65_536, 6


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation: three rounds of random signs and the transform."""
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice((-1.0, 1.0), x.shape[1]))
    return x


def buckets(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """[row, probe] bucket numbers in a table; the first is the row's own.

    Probes change one axis at a time, in the order of how little further the changed axis is.
    """
    n, d = x.shape
    near = np.empty((n, hashes, probes), np.int64)
    loss = np.empty((n, hashes, probes))
    for i in range(hashes):
        y = rotate(x, 1_000 * table + i)
        z = np.concatenate([y, -y], axis=1)
        take = min(probes, 2 * d)
        top = np.argpartition(-z, take - 1, axis=1)[:, :take]
        s = np.take_along_axis(z, top, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        near[:, i, :take] = np.take_along_axis(top, order, 1)
        s = np.take_along_axis(s, order, 1)
        loss[:, i, :take] = (s[:, :1] - s) ** 2
    base = np.zeros(n, np.int64)
    for i in range(hashes):
        base = base * 2 * d + near[:, i, 0]
    out = np.empty((n, probes), np.int64)
    out[:, 0] = base
    if probes > 1:
        other = loss[:, :, 1:].reshape(n, -1)
        best = np.argsort(other, axis=1, kind="stable")[:, : probes - 1]
        which, alt = best // (probes - 1), best % (probes - 1) + 1
        weight = (2 * d) ** (hashes - 1 - which)
        rows = np.arange(n)[:, None]
        out[:, 1:] = base[:, None] + (near[rows, which, alt] - near[rows, which, 0]) * weight
    return out


@functools.cache
def found_chance(hashes: int, probes: int, cosine: float, dimensions: int) -> float:
    """The chance that one table shows a vector another one of that cosine, measured on random pairs."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(2, 4_000, dimensions))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    padded = np.zeros((2, len(x), 1 << max(0, dimensions - 1).bit_length()))
    padded[0, :, :dimensions], padded[1, :, :dimensions] = x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * y
    # only the looking vector's own probes count: for the other one it need not be among the k best
    return float(np.mean([(buckets(padded[0], t, hashes, probes) == buckets(padded[1], t, hashes, 1)).any(axis=1).mean() for t in range(4)]))


def tables_for(recall: float, hashes: int, probes: int, cosine: float, dimensions: int) -> int:
    """The number of tables that show the given share of the pairs of that cosine."""
    p = found_chance(hashes, probes, cosine, dimensions)
    if p == 0:
        raise ValueError(f"hashing can't find pairs of cosine {cosine}; compare all vectors (least=None)")
    return 1 if p == 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))


def _entry(d: int) -> np.dtype:
    return np.dtype([("bucket", "<i8"), ("id", "<i8"), ("own", "u1"), ("scale", "<f4"), ("error", "<f4"), ("v", "i1", (d,))])


def _best_in_bucket(e: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(looking, found) identifiers that may be among the k best of the looking vector and reach the least cosine."""
    own = e[e["own"] == 1]
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    iv = own["v"].astype(np.float32) * own["scale"][:, None]
    a, b = [], []
    for p in range(0, len(e), BLOCK):
        q = e[p : p + BLOCK]
        s = (q["v"].astype(np.float32) * q["scale"][:, None]) @ iv.T
        s[q["id"][:, None] == own["id"][None, :]] = -2
        slack = q["error"][:, None] + own["error"][None, :] + 1e-5
        floor = np.full(len(q), least)
        if len(own) > k:
            kth = np.partition(s - slack, len(own) - k, axis=1)[:, len(own) - k]
            floor = np.maximum(floor, kth)
        i, j = np.nonzero(s + slack >= floor[:, None])
        a.append(q["id"][i])
        b.append(own["id"][j])
    return np.concatenate(a), np.concatenate(b)


def _rows(a: pa.Array, kind: str, d: int) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    return np.frombuffer(b"".join(a.to_pylist()), kind).reshape(len(a), d).astype(np.float64)


def _may_be_best(s: np.ndarray, kth: np.ndarray, k: int, axis: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores in a tile that may be among the k best of their line, given the k-th best so far."""
    if s.shape[axis] > k and kth.min() < -1.5:
        kth = np.maximum(kth, np.take(np.partition(s, s.shape[axis] - k, axis=axis), s.shape[axis] - k, axis=axis))
    floor = (kth - slack).astype(np.float32)
    at = np.flatnonzero(s >= (floor[:, None] if axis else floor[None, :]))
    return at // s.shape[1], at % s.shape[1]


def _keep_best(best: np.ndarray, ids: np.ndarray, row: np.ndarray, found: np.ndarray, s: np.ndarray) -> None:
    """Take found identifiers and their similarities into the k best of each row; ties go to the smaller identifier."""
    k = best.shape[1]
    touched = np.unique(row)
    r = np.concatenate([np.repeat(touched, k), row])
    i = np.concatenate([ids[touched].ravel(), found])
    c = np.concatenate([best[touched].ravel(), s])
    order = np.lexsort((i, -c, r))
    r, i, c = r[order], i[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    best[touched], ids[touched] = c[keep].reshape(-1, k), i[keep].reshape(-1, k)


def _best_of_blocks(lid: np.ndarray, lx: np.ndarray, rid: np.ndarray, rx: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Rows of _FOUND: for each vector of either block its k most similar of the other one (same: of its own, but itself)."""
    slack = 4 * (lx.shape[1] + 4) * 2.0**-24  # a single-precision product of unit vectors is off by less than half of it
    ln, rn = np.linalg.norm(lx, axis=1), np.linalg.norm(rx, axis=1)
    lu, ru = (lx / ln[:, None]).astype(np.float32), (rx / rn[:, None]).astype(np.float32)
    sides = [(np.full((len(x), k), -2.0), np.full((len(x), k), np.iinfo(np.int64).max)) for x in (lid, rid)]
    (lbest, lfound), (rbest, rfound) = (sides[0], sides[0]) if same else sides
    for p in range(0, len(lid), BLOCK):
        for q in range(p if same else 0, len(rid), BLOCK):
            s = lu[p : p + BLOCK] @ ru[q : q + BLOCK].T
            if same and p == q:
                np.fill_diagonal(s, -3)
            for axis, best, found in ((1, lbest, lfound), (0, rbest, rfound)):
                if axis == 0 and same and p == q:
                    continue  # the other half of a tile that mirrors itself
                at = p if axis else q
                i, j = _may_be_best(s, best[at : at + s.shape[1 - axis], k - 1], k, axis, slack)
                for z in range(0, len(i), 1 << 16):
                    a, b = i[z : z + (1 << 16)] + p, j[z : z + (1 << 16)] + q
                    c = np.einsum("ij,ij->i", lx[a], rx[b]) / (ln[a] * rn[b])
                    c = np.minimum(np.round(c, 12), 1.0)
                    _keep_best(best, found, a if axis else b, rid[b] if axis else lid[a], c)
    out = []
    for ids, (best, found) in zip((lid,) if same else (lid, rid), sides):
        ok = best > -1.5
        e = np.empty(int(ok.sum()), _FOUND)
        e["a"], e["b"], e["s"] = np.repeat(ids, ok.sum(axis=1)), found[ok], best[ok]
        out.append(e)
    return np.concatenate(out)


_FOUND = np.dtype([("a", "<i8"), ("b", "<i8"), ("s", "<f8")])


def _shares(number: np.ndarray, n: int) -> np.ndarray:
    """Numbers dealt into n shares."""
    h = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _runs(part: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each part and its rows, packed."""
    order = np.argsort(part, kind="stable")
    e, part = e[order], part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return part[cuts], [y.tobytes() for y in np.split(e, cuts[1:])]


def _nearest_of_all(one: DataFrame, packing: str, d: int, k: int, n: int, parts: int) -> DataFrame:
    """(a, b, similarity): the k most similar others of every one of n vectors, all compared with all."""
    blocks = max(GRID_BLOCKS, math.ceil(n / GRID_ROWS))
    cells = [(i, j) for j in range(blocks) for i in range(j + 1)]
    kind = np.dtype([("id", "<i8"), ("block", "<i4"), ("v", packing, (d,))])
    parts = max(parts, math.ceil(n * k * blocks / 2_000_000))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            e = np.empty(b.num_rows, kind)
            e["id"] = b.column(0).to_numpy()
            e["v"] = np.frombuffer(b"".join(b.column(1).to_pylist()), packing).reshape(-1, d)
            e["block"] = _shares(e["id"], blocks)
            for own, rows in zip(*_runs(e["block"], e)):
                with_each = [max(own, x) * (max(own, x) + 1) // 2 + min(own, x) for x in range(blocks)]
                yield pa.RecordBatch.from_arrays([pa.array(with_each, pa.int32()), pa.array([rows] * blocks, pa.binary())], ["cell", "block"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(c, x) for b in batches for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        for cell in sorted({c for c, _ in got}):
            i, j = cells[cell]
            e = np.frombuffer(b"".join(x for c, x in got if c == cell), kind)
            left, right = e[e["block"] == i], e[e["block"] == j]
            found = _best_of_blocks(left["id"], left["v"].astype(np.float64), right["id"], right["v"].astype(np.float64), k, i == j)
            if len(found):
                part, rows = _runs(_shares(found["a"], parts), found)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(rows, pa.binary())], ["part", "block"])

    def best(t: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(t.column("block").to_pylist()), _FOUND)
        e = e[np.lexsort((e["b"], -e["s"], e["a"]))]
        e = e[np.arange(len(e)) - np.searchsorted(e["a"], e["a"]) < k]
        return pa.table({"a": e["a"], "b": e["b"], "similarity": e["s"]})

    dealt = one.select("id", "v").mapInArrow(deal, "cell int, block binary").repartitionById(len(cells), "cell")
    return dealt.mapInArrow(compare, "part long, block binary").groupBy("part").applyInArrow(best, "a long, b long, similarity double")


def usable(vectors: DataFrame, key: str, vector: str, d: int) -> tuple[DataFrame, str]:
    """(id, form, v): one usable vector for each identifier, packed, and a number for its direction; and how it is packed."""
    kind = "<f4" if "float" in dict(vectors.dtypes)[vector] else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v = b.column(0), b.column(1)
            x = np.asarray(v.flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, d)
            length = np.linalg.norm(x.astype(np.float64), axis=1)
            ok = np.flatnonzero(np.isfinite(x).all(axis=1) & np.isfinite(length) & (length > 0))
            x, length = x[ok], length[ok]
            cells = np.rint(x.astype(np.float64) / length[:, None] * 10**DIGITS).astype(np.int64).view(np.uint64)
            form = (mix(cells + np.arange(1, d + 1, dtype=np.uint64)) * (2 * np.arange(d, dtype=np.uint64) + 1)).sum(axis=1, dtype=np.uint64)
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(ok)), pa.array(form.view(np.int64)), packed], ["id", "form", "v"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == d))
    # nulls within arrays would shift the flat values
    rows = rows.filter(~F.exists("v", lambda x: x.isNull()))
    packed = rows.mapInArrow(run, "id long, form long, v binary")
    one = packed.groupBy("id").agg(F.min(F.struct("v", "form")).alias("x"))
    return one.select("id", "x.form", "x.v"), kind


def most_similar(
    vectors: DataFrame, key: str, vector: str, k: int = 5, least: float | None = 0.9, dimensions: int = 64, tables: int = 8, probes: int = 2, bucket_rows: int = 16, part_entries: int = 200_000, recall: float = 0.99
) -> DataFrame:
    """(id, neighbour, similarity, place): the k most similar others of every usable vector, of cosine `least` or more.

    With no least cosine all vectors are compared and the result is exact. Otherwise they are hashed. The number of hashes in a bucket follows from the number of vectors: about bucket_rows of them would share a
    bucket if they lay evenly. There are at least `tables` tables, and as many more as that number of hashes needs for
    an expected recall of about `recall` at the least cosine by one vector's probes alone.
    """
    spark = vectors.sparkSession
    size = 1 << max(0, dimensions - 1).bit_length()
    unit, packing = usable(vectors, key, vector, dimensions)
    unit = cut(unit)
    # classes of one direction; the first members are its head
    w = Window.partitionBy("form").orderBy("id")
    heads = unit.select("form", "id").withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k + 1)
    heads = cut(heads.groupBy("form").agg(F.sort_array(F.collect_list("id")).alias("head")))
    one = unit.join(heads.select("form", F.col("head")[0].alias("id")), ["form", "id"], "left_semi")
    n = heads.count()
    if least is None:
        return _of_members(unit, heads, _nearest_of_all(one, packing, dimensions, k, n, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), k)
    hashes = max(1, round(math.log(max(n, 2) / bucket_rows) / math.log(2 * size)))
    tables = max(tables, tables_for(recall, hashes, probes, min(least, 1.0), dimensions))
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * tables * probes / part_entries))
    kind = _entry(dimensions)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                ids = b.column(0).to_numpy()
                x = _rows(b.column(1), packing, dimensions)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                scale = np.maximum(np.abs(x).max(axis=1), 1e-12) / 127
                q = np.rint(x / scale[:, None]).astype(np.int8)
                # |<x, y> - <x', y'>| is at most the sum of the two errors
                err = np.linalg.norm(x - q * scale[:, None], axis=1) * (1 + 1e-2) + 1e-6
                padded = np.zeros((len(ids), size))
                padded[:, :dimensions] = x
                e = np.empty((tables, len(ids), probes), kind)
                for t in range(tables):
                    e["bucket"][t] = buckets(padded, t, hashes, probes) * tables + t
                e["id"], e["scale"], e["error"] = ids[None, :, None], scale[None, :, None], err[None, :, None]
                e["own"] = np.arange(probes) == 0
                e["v"] = q[None, :, None, :]
                e = e.reshape(-1)
                h = e["bucket"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                part = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                e, part = e[order], part[order]
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array([y.tobytes() for y in np.split(e, cuts[1:])], pa.binary())], ["part", "block"])

    def search(t: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column("block")])
        order = np.argsort(e["bucket"], kind="stable")
        e = e[order]
        cuts = np.flatnonzero(np.r_[True, e["bucket"][1:] != e["bucket"][:-1]])
        a, b = [], []
        for x in np.split(e, cuts[1:]):
            if len(x) > 1:
                p, q = _best_in_bucket(x, k, least)
                a.append(p)
                b.append(q)
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    found = one.select("id", "v").mapInArrow(entries, "part long, block binary").groupBy("part").applyInArrow(search, "a long, b long")
    # what one looks up holds for the other as well
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    va = one.select(F.col("id").alias("a"), F.col("v").alias("va"))
    vb = one.select(F.col("id").alias("b"), F.col("v").alias("vb"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (_rows(b.column(i), packing, dimensions) for i in (2, 3))
            c = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            c = np.minimum(np.round(c, 12), 1.0)
            ok = np.flatnonzero(c >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(c[ok])], ["a", "b", "similarity"])

    both = pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb")
    exact = both.mapInArrow(rank, "a long, b long, similarity double")
    exact = cut(exact)
    both = exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    near = both.withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).filter(F.col("at") <= k)
    return _of_members(unit, heads, near, k).filter(F.col("similarity") >= least)


def _of_members(unit: DataFrame, heads: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, similarity, place) of every vector, from the k most similar classes of each class."""
    # from class to members: the k + 1 best for the class, its own head included
    first = heads.select(F.col("head")[0].alias("rep"), "head")
    wide = near.join(first.select(F.col("rep").alias("b"), "head"), "b").select("a", "similarity", F.explode("head").alias("m"))
    own = first.select(F.col("rep").alias("a"), F.lit(1.0).alias("similarity"), F.explode("head").alias("m"))
    ranked = wide.unionByName(own).withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "m"))).filter(F.col("at") <= k + 1)
    best = ranked.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("at", "m", "similarity"))).alias("best"))
    of_class = best.join(first.select(F.col("rep").alias("a"), F.lit(1).alias("is")), "a").select("a", "best")
    forms = heads.select("form", F.col("head")[0].alias("a")).join(of_class, "a").select("form", "best")
    per = unit.select("id", "form").join(forms, "form")
    others = F.slice(F.filter("best", lambda x: x["m"] != F.col("id")), 1, k)
    out = per.select("id", F.posexplode(others).alias("place", "x"))
    return out.select("id", F.col("x.m").alias("neighbour"), F.col("x.similarity").alias("similarity"), (F.col("place") + 1).alias("place"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(a, b): each pair once, smaller identifier first."""
    return neighbours.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
