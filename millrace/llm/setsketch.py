"""Near-duplicate texts by SetSketch registers (problem 1).

A SetSketch holds, for each of m registers, the largest K = floor(1 - log_b h) over the elements of a set, h being an
exponential number made from the element and the register, truncated to 0 .. q + 1. The registers of a union are the
maxima of the registers, and two sets agree in a register the more often the more they have in common.

1. Counting. How often each word occurs is counted over all texts in a table whose size follows from that of the input
   (2 ** count_bits counters, within fixed bounds; a counter never counts too little). Only that table comes to the
   driver and is broadcast.
2. Banding. One sketch takes each word with the weight ln(1 + N / count): its h has that rate. A band is a run of
   registers of this sketch, as many as it takes until the expected number of texts agreeing in them by chance, N times
   the product of the winning words' shares, is at most `chance`. Rare winners need one register, common ones several.
   A band's key is made of the words that won its registers, whichever registers those are: texts that agree in a band
   have the same key, bands of one text won by the same words are one entry, and texts also meet in different bands.
   A band won by a word that occurs once in the corpus can't be shared and isn't sent. The longer the bands must be, the
   more of them there are; those beyond the first `bands` are sent only if DEEP words or more had to win in them, as it
   is the texts of common words that need them.
3. Joint estimate. A second sketch of 256 bits is carried along; it leaves out the words that occur once, which are
   never common. Texts of up to ODD words have an odd sketch: each word turns over one bit. Two such sketches differ in at
   most as many bits as there are words in one text only, so a pair is dropped if they differ in more than a true pair
   of these sizes can; no true pair is. Longer texts would turn over most bits several times. Theirs is one bit of
   each of 256 unweighted registers; two bits agree with chance (1 + J) / 2 at similarity J. The likelihood of the
   agreement seen under the least similarity that a true pair of these sizes can have is set against its maximum over J: a
   pair is dropped if its estimate is lower and the ratio says that no true pair, but for a share of `miss`, is so far off.
   Texts that may have partners of either kind are sent with both.
4. Verifying. The pairs left are compared word by word.

Texts with the same set of words make one class and go through 2-4 once; a class is told by two hashes of 64 bits. Copies
are made one within a batch before anything is shuffled, so a text with a third of all copies costs one entry a batch and
band. Entries are shuffled as packed binary blocks into as many parts as their number asks for. A band's part follows from
the rarest word in it (the two rarest, if one is in more than `HOT` texts), so most bands of a text fall into a few parts,
and in each the text's identifier, signature and sizes go once, in 42 bytes, with three bytes a band.

Hot buckets: a part is read as a stream and held up to `split` entries. What is held is compared; if the part goes on (a
hot bucket fell into it), it is also written as a block, to be compared with each later block of the part in a task of
that block's own. So no task holds more than two blocks, and no bucket is cut.

Defined cases: null and empty texts and those of fewer than min_words different words have no partner; a key delivered
again counts once; pairs come out once with the smaller key first; a pair lies above the threshold if the common words
are at least `share` of the words of either text (exact integer arithmetic on verified words); empty tables give empty
results; other columns are ignored.

Recall: a true pair is lost if no two bands agree or, beyond ODD words, the estimate falls under the bound. See README for measurements.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textscan as ts

U = np.uint64
#: Base and limit of the registers' scale; 16 bits hold q + 2 values.
B, Q, RATE = 1.001, (1 << 16) - 2, 4096  # RATE: log_b of the exponentials' common rate
REGISTERS = 32
DEPTH = 8  # most registers in a band
BANDS_PER_BIT = 3.25  # bands for each bit that a band asks for
DEEP = 2  # the words that win in a band beyond the first ones
SIGNATURE = 256  # bits of the second sketch
ODD = 100  # most words of a text with an odd sketch
LONG = 1 << 23  # the bit of an entry's hash that is set if its signature is one of registers
ENTRY = np.dtype([("hash", "<u4"), ("id", "<u8"), ("s0", "<u8"), ("s1", "<u8"), ("s2", "<u8"), ("s3", "<u8"), ("n", "u1"), ("m", "u1")])  # n words, m of them not alone in the corpus
WORDS = ("s0", "s1", "s2", "s3")
OF_SET = ("id", *WORDS)
SET = np.dtype([(f, ENTRY[f]) for f in ENTRY.names[1:]])
SIZES = 256  # larger sets count as this large in the estimate, which only keeps more
STEPS = 4  # codes of counts for each power of two: one byte holds every count of 63 bits
COUNT_BITS = (22, 25)  # least and most
SLICES = 64
HOT = 125_000  # a word in more texts than this doesn't alone decide on a band's part
HELD = 400_000  # entries packed at once
HELD_BYTES = 1 << 24  # of texts, packed at once
PART_SETS = 40_000  # sets in a part of the verification
STRIP = 16  # registers worked on at a time, for the processor's caches
BLOCK = 512


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((h >> U(12)).astype(np.float64) + 0.5) / 2.0**52


def _registers(words: np.ndarray, weight: np.ndarray | float, first: int, count: int) -> np.ndarray:
    """Register values of single words: rows words, columns registers first .. first + count - 1."""
    seeds = ts.mix((np.arange(first, first + count, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
    h = -np.log(_uniform(ts.mix(words[:, None] ^ seeds[None, :])))
    h /= np.asarray(weight).reshape(-1, 1)
    return np.clip(np.floor(1 - np.log(h) / math.log(B)) + RATE, 0, Q + 1).astype(U)


def log_likelihood(equal: np.ndarray | int, j: np.ndarray | float) -> np.ndarray:
    """Of similarity j, `equal` of SIGNATURE registers' bits being equal."""
    p = np.clip((1 + np.asarray(j, float)) / 2, 1e-12, 1 - 1e-12)
    return equal * np.log(p) + (SIGNATURE - equal) * np.log1p(-p)


def least_agreement(j: float, miss: float) -> int:
    """The fewest equal registers at which similarity j isn't ruled out by the likelihood ratio.

    The estimate is the similarity of greatest likelihood, 2 equal / SIGNATURE - 1 or 0. Twice the log of the ratio is
    about a squared normal number, of which a share of `miss` lies beyond the bound on this side.
    """
    bound = NormalDist().inv_cdf(1 - miss) ** 2
    equal = np.arange(SIGNATURE + 1)
    best = np.clip(2 * equal / SIGNATURE - 1, 0, 1)
    kept = (best >= j) | (2 * (log_likelihood(equal, best) - log_likelihood(equal, j)) <= bound)
    return int(np.flatnonzero(kept)[0])


@lru_cache(maxsize=8)
def agreement_bounds(miss: float) -> np.ndarray:
    """Similarity in thousandths -> least number of equal signature registers for a pair to be kept."""
    return np.array([least_agreement(k / 1000, miss) for k in range(1001)], np.uint16)


def passes(equal: np.ndarray, na: np.ndarray, ma: np.ndarray, nb: np.ndarray, mb: np.ndarray, share: Fraction, bounds: np.ndarray) -> np.ndarray:
    """Whether pairs of n words each, m of them in the signature, may have enough in common.

    What is common is not alone in the corpus, so it is at most m; the similarity looked at is the least that signatures
    of m_a and m_b words can have if enough is common.
    """
    na, ma, nb, mb = (x.astype(np.int32) for x in (na, ma, nb, mb))
    c = -(-share.numerator * np.maximum(na, nb) // share.denominator)
    j = 1000 * c // np.maximum(ma + mb - c, 1)
    return (c <= np.minimum(ma, mb)) & (equal >= bounds[np.clip(j, 0, 1000)])


class Sets(NamedTuple):
    """The texts of a batch with enough different words."""

    words: np.ndarray  # hashes of the different words, text by text
    sizes: np.ndarray
    starts: np.ndarray
    ids: np.ndarray  # of the set of words
    checks: np.ndarray  # a second hash of it
    rows: np.ndarray  # row numbers in the batch


def _sets(texts: pa.Array, min_words: int) -> Sets:
    h, t, n = ts.distinct(ts.scan(texts))
    ok = n >= min_words
    h = h[ok[t]]
    rows = np.flatnonzero(ok)
    sizes = n[rows]
    if not len(rows):
        return Sets(h, sizes, np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), rows)
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    ids, checks = (ts.mix(np.add.reduceat(ts.mix(h ^ salt), starts) + sizes.astype(U)) for salt in (U(0), ts.BASES[1]))
    return Sets(h, sizes, starts, ids, checks, rows)


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.int64)


def _slot_counts(docs: DataFrame, bits: int, slots: Callable[[pa.RecordBatch], tuple[np.ndarray, int]]) -> tuple[np.ndarray, int]:
    """A code for each of 2 ** bits counters, and the sum of n, over all batches; slots gives the places to count and n.

    A code is 0 for none, else 1 + STEPS log2 of the count, so 1 is exactly once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(1 << bits, np.uint32), 0
        for b in (x for whole in batches for x in ts.slices(whole)):
            at, k = slots(b)
            np.add.at(table, at, np.uint32(1))
            n += k
        if n:
            parts = [_squeeze(x.tobytes()) for x in np.split(table, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] * SLICES, pa.int64())], ["slice", "counts", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // SLICES, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(_unsqueeze(x.as_py()), np.uint32)
        return pa.table({"slice": t.column("slice")[:1], "counts": pa.array([_squeeze(count_codes(total).tobytes())], pa.binary()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})

    schema = "slice int, counts binary, n long"
    got = docs.mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect()  # SLICES rows at most
    table = np.zeros((SLICES, (1 << bits) // SLICES), np.uint8)
    for r in got:
        table[r["slice"]] = np.frombuffer(_unsqueeze(r["counts"]), np.uint8)
    return table.reshape(-1), max([0, *(r["n"] for r in got)])


def count_codes(counts: np.ndarray) -> np.ndarray:
    """One byte for each count of up to 63 bits: 0 for none, 1 for one, STEPS more for each power of two."""
    return np.where(counts > 0, 1 + np.floor(STEPS * np.log2(np.maximum(counts, 1).astype(float))), 0).astype(np.uint8)


def counts_of(codes: np.ndarray) -> np.ndarray:
    """What a code stands for, from below; 0 for none."""
    return np.where(codes > 0, 2.0 ** ((np.maximum(codes, 1).astype(float) - 1) / STEPS), 0)


def count_words(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """A code for the occurrences behind each counter of a word's hash, and the number of texts with words."""

    def slots(b: pa.RecordBatch) -> tuple[np.ndarray, int]:
        w = ts.scan(b.column(1))
        return _slot(w.hashes, bits), len(np.unique(w.text))

    return _slot_counts(docs, bits, slots)


def band_keys(words: np.ndarray, back: np.ndarray, starts: np.ndarray, codes: np.ndarray, n: int, bands: int, chance: float, always: int, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """[row, band] keys of the words that won the bands' registers, and whether the entry is to be sent.

    The upper 32 bits of a key are a hash of the rarest of its words (the two rarest, if one is in more than `hot` texts),
    the lower ones a hash of all of them.

    words holds the different words of a batch, back the place in it of every word of every row. A band in which a word
    wins that occurs once in the corpus is no other text's; of several bands with the same key one is sent; a band beyond
    the first `always` is sent only if it is deep.
    """
    bits = int(codes.size).bit_length() - 1
    weight = np.log1p(n / np.maximum(counts_of(codes[_slot(words, bits)]), 1))
    low = words >> U(16)  # along with the register goes the word that won it
    tops = []
    for at in range(0, REGISTERS, STRIP):
        single = _registers(words, weight, at, min(STRIP, REGISTERS - at)) << U(48) | low[:, None]
        tops.append(np.maximum.reduceat(single[back], starts, axis=0))
    won = np.concatenate(tops, axis=1) << U(16)
    code = codes[_slot(won, bits)].astype(np.float64)
    # the winner's share of the texts, in bits
    share = np.maximum(math.log2(max(n, 1)) - (code - 1) / STEPS, 0)
    # a register's values of all rows lie together
    won, code, share = (np.ascontiguousarray(x.T) for x in (won, code, share))
    hashed = ts.mix(won)
    rare = code.astype(U) << U(48) | won >> U(16)
    most = count_codes(np.array([hot]))[0]
    none = ~U(0)
    out = np.empty((len(starts), bands), U)
    alive = np.ones((len(starts), bands), bool)
    goal = math.log2(max(n / chance, 1))
    rng = np.random.default_rng(20)
    for b in range(bands):
        start = b % REGISTERS
        run = np.r_[start, rng.permutation(np.setdiff1d(np.arange(REGISTERS), [start]))[: DEPTH - 1]]
        acc, got, on = np.zeros(len(starts), U), np.zeros(len(starts)), np.ones(len(starts), bool)
        deep = np.zeros(len(starts), np.int64)
        first, second = np.full(len(starts), none), np.full(len(starts), none)
        for i, r in enumerate(run):
            at = np.flatnonzero(on)
            if not len(at):
                break
            w, new = won[r][at], np.ones(len(at), bool)
            for q in run[:i]:
                new &= won[q][at] != w
            acc[at] += np.where(new, hashed[r][at], U(0))
            got[at] += np.where(new, share[r][at], 0)
            deep[at] += new
            r1, r2 = first[at], np.where(new, rare[r][at], none)
            first[at] = np.minimum(r1, r2)
            second[at] = np.minimum(second[at], np.maximum(r1, r2))
            once = code[r][at] == 1
            alive[at[once], b] = False
            on[at] = (got[at] < goal) & ~once
        group = ts.mix(np.where(first >> U(48) > most, first ^ ts.mix(second), first))
        out[:, b] = group >> U(32) << U(32) | ts.mix(acc) >> U(32)
        if b >= always:
            alive[deep < DEEP, b] = False
    order = np.argsort(out, axis=1, kind="stable")
    ordered = np.take_along_axis(out, order, 1)
    sent = np.take_along_axis(alive, order, 1)
    # bands of one key are sent or not alike, but for those beyond the first: the one before is of a lower number
    sent[:, 1:] &= ~((ordered[:, 1:] == ordered[:, :-1]) & sent[:, :-1])
    np.put_along_axis(alive, order, sent, 1)
    return out, alive


def signatures(words: np.ndarray, back: np.ndarray, starts: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """[row, word]: one bit of each of SIGNATURE unweighted registers of the words that aren't alone in the corpus.

    Here b is as near to 1 as the hash is fine: the register is then in effect the largest hash itself, K being a
    monotone function of it, and no logarithm is needed.
    """
    seeds = ts.mix(np.arange(REGISTERS, REGISTERS + SIGNATURE, dtype=np.uint64)) | U(1)
    bits = []
    for at in range(0, SIGNATURE, STRIP):
        single = ((words[:, None] * seeds[None, at : at + STRIP]) >> U(48)).astype(np.uint16)
        single[alone] = 0
        bits.append(np.maximum.reduceat(single[back], starts, axis=0) & np.uint16(1))
    return np.ascontiguousarray(np.packbits(np.concatenate(bits, axis=1).astype(bool), axis=1)).view(U)


def odd_sketches(words: np.ndarray, back: np.ndarray, starts: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """[row, word]: SIGNATURE bits, each the parity of the words, of those not alone in the corpus, that fall on it."""
    row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(back)]))
    bit = (ts.mix(words ^ ts.BASES[0]) >> U(56)).astype(np.int64)  # log2 of SIGNATURE bits
    kept = ~alone[back]
    n = np.bincount(row[kept] * SIGNATURE + bit[back[kept]], minlength=len(starts) * SIGNATURE)
    return np.packbits((n & 1).astype(bool).reshape(-1, SIGNATURE), axis=1).view(U)


def _differ(s: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of different bits."""
    off = np.bitwise_count(s[0][i] ^ s[0][j]).astype(np.uint16)
    for x in s[1:]:
        off += np.bitwise_count(x[i] ^ x[j])
    return off


def close_enough(off: np.ndarray, na: np.ndarray, ma: np.ndarray, nb: np.ndarray, mb: np.ndarray, share: Fraction) -> np.ndarray:
    """Whether pairs whose odd sketches differ in `off` bits may have enough in common; n and m as in passes.

    Each differing bit takes a word that only one of them has, and of those there are m_a + m_b less twice the common ones.
    """
    na, ma, nb, mb = (x.astype(np.int32) for x in (na, ma, nb, mb))
    c = -(-share.numerator * np.maximum(na, nb) // share.denominator)
    return (c <= np.minimum(ma, mb)) & (off <= ma + mb - 2 * c)


def pairs_in_buckets(e: np.ndarray, share: Fraction, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of identifiers that share a bucket and pass the estimate."""
    e = e[np.lexsort((e["s0"], e["id"], e["hash"]))]
    same = np.zeros(len(e), bool)
    same[1:] = (e["hash"][1:] == e["hash"][:-1]) & (e["id"][1:] == e["id"][:-1]) & (e["s0"][1:] == e["s0"][:-1])
    e = e[~same]
    start = np.flatnonzero(np.r_[True, e["hash"][1:] != e["hash"][:-1]]) if len(e) else np.zeros(0, int)
    size = np.diff(np.r_[start, len(e)])
    n, m = np.ascontiguousarray(e["n"]), np.ascontiguousarray(e["m"])
    # half of what a text allows its pairs to differ in, at the least; it settles most pairs. Registers: no pair can have less than this similarity
    of_registers = e["hash"] >= LONG
    half = np.where(of_registers, (SIGNATURE - bounds[int(1000 * share / (2 - share))]) / 2, m - float(share) * n + 0.01).astype(np.float32)
    ids = np.ascontiguousarray(e["id"])
    sig = tuple(np.ascontiguousarray(e[f]) for f in WORDS)
    left, right = [], []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        off = _differ(sig, i, j)
        some = np.flatnonzero(off <= half[i] + half[j])
        i, j, off = i[some], j[some], off[some]
        sizes = n[i], m[i], n[j], m[j], share
        ok = np.where(of_registers[i], passes(SIGNATURE - off, *sizes, bounds), close_enough(off, *sizes))
        left.append(ids[i[ok]])
        right.append(ids[j[ok]])

    # small buckets of one size together, in rounds of at most two million pairs
    for k in np.unique(size[(size > 1) & (size <= BLOCK)]):
        first = start[size == k]
        x, y = np.triu_indices(int(k), 1)
        step = max(1, 2_000_000 // len(x))
        for q in range(0, len(first), step):
            f = first[q : q + step, None]
            take((f + x).ravel(), (f + y).ravel())
    for f, k in zip(start[size > BLOCK], size[size > BLOCK]):
        for p in range(f, f + k, BLOCK):
            i = np.arange(p, min(p + BLOCK, f + k))
            for q in range(p, f + k, BLOCK):
                j = np.arange(q, min(q + BLOCK, f + k))
                ii, jj = np.repeat(i, len(j)), np.tile(j, len(i))
                keep = ii < jj
                take(ii[keep], jj[keep])
    a, b = (np.concatenate(x) if x else np.zeros(0, U) for x in (left, right))
    if not len(a):
        return a, b
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return a[new], b[new]


def bands_for(n: int, chance: float, least: int) -> int:
    """The number of bands for n texts: a band asks for log2(n / chance) bits, and the more it asks the fewer pairs agree in it."""
    return max(least, math.ceil(BANDS_PER_BIT * math.log2(max(n / chance, 1))))


class NearDuplicates:
    """The parts of the join; docs needs the columns key and text."""

    def __init__(self, docs: DataFrame, key: str, text: str, share: float = 0.7, min_words: int = 5, bands: int = 12, chance: float = 1024.0, miss: float = 0.003, count_bits: int | None = None, part_entries: int = 200_000, split: int = 1_000_000):
        self.share, self.min_words = Fraction(str(share)), min_words
        self.docs = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("key IS NOT NULL AND text IS NOT NULL")
        self.bands, self.chance, self.miss, self.part_entries, self.split = bands, chance, miss, part_entries, split
        size = float(str(self.docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        # a new word comes with every some 16 bytes at most
        self.count_bits = count_bits or int(min(max(math.log2(max(size, 1.0) / 16), COUNT_BITS[0]), COUNT_BITS[1]))

    def members(self) -> DataFrame:
        """(id, check, key): which set of words a key's text has."""
        return self._keyed().distinct()

    def _keyed(self) -> DataFrame:
        min_words = self.min_words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x for whole in batches for x in ts.slices(whole)):
                s = _sets(b.column(1), min_words)
                yield pa.RecordBatch.from_arrays([pa.array(s.ids.view(np.int64)), pa.array(s.checks.view(np.int64)), b.column(0).take(pa.array(s.rows))], ["id", "check", "key"])

        return self.docs.mapInArrow(run, "id long, check long, key string")

    def _texts(self, parts: int) -> DataFrame:
        """(part, block): one text of every set, packed and compressed by the part its identifier falls in."""
        min_words = self.min_words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def close() -> Iterator[pa.RecordBatch]:
                ids, checks = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                first = _first_of(ids, checks)
                if len(first):
                    texts = pa.chunked_array([h[2] for h in held]).combine_chunks().take(pa.array(first))
                    yield _by_part(_part(ids[first], parts), [ids[first], checks[first]], texts)

            for b in (x for whole in batches for x in ts.slices(whole)):
                s = _sets(b.column(1), min_words)
                first = _first_of(s.ids, s.checks)
                held.append((s.ids[first], s.checks[first], b.column(1).take(pa.array(s.rows[first])).cast(pa.large_string())))
                size += held[-1][2].nbytes
                if size > HELD_BYTES:
                    yield from close()
                    held, size = [], 0
            if held:
                yield from close()

        return self.docs.mapInArrow(run, PACKED)

    def candidates(self) -> tuple[DataFrame, int]:
        """(part, block): packed identifiers of sets that agree in a band and pass the joint estimate; and the number of parts.

        A pair may come from several bands and blocks; part is that of its first identifier. Parts of the texts are fewer
        than those of the entries, as what they hold is compressed the better the more it is.
        """
        spark = self.docs.sparkSession
        counts, n = count_words(self.docs, self.count_bits)
        sent = spark.sparkContext.broadcast(counts)  # one byte a counter
        bands = bands_for(n, self.chance, self.bands)
        min_words, chance, split, always = self.min_words, self.chance, self.split, self.bands
        share, miss = self.share, self.miss

        def banded(b: pa.RecordBatch) -> tuple[Sets, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Sets, their words, the first row of each set, and of these the bands' keys and whether they are sent."""
            s = _sets(b.column(1), min_words)
            words, back = np.unique(s.words, return_inverse=True)
            if not len(s.ids):
                return s, words, back, np.zeros(0, np.int64), np.zeros((0, bands), U), np.zeros((0, bands), bool)
            key, alive = band_keys(words, back, s.starts, sent.value, n, bands, chance, always)
            first = _first_of(s.ids, s.checks)  # copies within the batch go once
            return s, words, back, first, key[first], alive[first]

        least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts, text_parts = max(least, math.ceil(n * bands / self.part_entries)), max(least, math.ceil(n / PART_SETS))

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def close() -> Iterator[pa.RecordBatch]:
                at, blocks = _pack_parts(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(blocks, pa.binary())], ["part", "block"])

            for b in (x for whole in batches for x in ts.slices(whole)):
                s, words, back, first, key, alive = banded(b)
                if not len(first):
                    continue
                alone = sent.value[_slot(words, int(sent.value.size).bit_length() - 1)] == 1
                shared = s.sizes - np.add.reduceat(alone[back].astype(np.int64), s.starts)
                row, band = np.nonzero(alive)
                for long, of, sketch in ((0, s.sizes <= ODD, odd_sketches), (LONG, s.sizes >= math.ceil(share * (ODD + 1)), signatures)):
                    mine = of[first[row]]
                    if not mine.any():
                        continue
                    sizes = s.sizes[of]
                    sig = sketch(words, back[np.repeat(of, s.sizes)], np.cumsum(sizes) - sizes, alone)[np.cumsum(of) - 1]
                    at, k = first[row[mine]], key[row[mine], band[mine]]
                    e = np.empty(len(at), ENTRY)
                    e["hash"], e["id"] = k & U(LONG - 1) | U(long), s.ids[at]
                    e["n"], e["m"] = np.minimum(s.sizes[at], SIZES - 1), np.minimum(shared[at], SIZES - 1)
                    for i, f in enumerate(WORDS):
                        e[f] = sig[at, i]
                    held.append((((k >> U(32)) % U(parts)).astype(np.int64), e))
                    size += len(e)
                if size >= HELD:
                    yield from close()
                    held, size = [], 0
            if held:
                yield from close()

        def found(e: np.ndarray, later: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
            a, b = pairs_in_buckets(e if later is None else np.concatenate([e, later]), share, agreement_bounds(miss))
            if len(a):
                at, blocks = _runs(_part(a, text_parts), np.stack([a, b], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([0] * len(at), pa.int32()), pa.array(blocks, pa.binary())], GROUPS.names)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Pairs (role 0) and, of parts with more than one block, the blocks: role 1 under their own group, 2 under those of all before."""
            part, held, size, number = None, [], 0, 0

            def close(more: bool) -> Iterator[pa.RecordBatch]:
                if not held:
                    return
                yield from found(np.concatenate([_unpack(x) for x in held]))
                if more or number:
                    block = _join(held)
                    own = [_group(part, number, text_parts)] if more else []
                    before = [_group(part, i, text_parts) for i in range(number)]
                    for g, role in [*((g, 1) for g in own), *((g, 2) for g in before)]:
                        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([role], pa.int32()), pa.array([block], pa.binary())], GROUPS.names)

            for b in batches:
                for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    k = int(np.frombuffer(x, np.uint32, 1)[0])
                    if p != part or held and size + k > split:
                        yield from close(p == part)
                        number = number + 1 if p == part else 0
                        part, held, size = p, [], 0
                    held.append(x)
                    size += k
            yield from close(False)

        def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Pairs go through, those of a part once; a block meets the later ones of its group, which come one by one."""
            left, part, pairs, size = None, None, [], 0

            def close() -> Iterator[pa.RecordBatch]:
                block = _once(pairs).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([0], pa.int32()), pa.array([block], pa.binary())], GROUPS.names)

            for b in batches:
                for g, role, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if pairs and (role or g != part or size > HELD_BYTES):
                        yield from close()
                        pairs, size = [], 0
                    if role == 0:
                        part, size = g, size + len(x)
                        pairs.append(x)
                    elif role == 1:
                        left = _unpack(x)
                    else:
                        later = _unpack(x)
                        at = np.isin(later["hash"], left["hash"])
                        yield from found(left[np.isin(left["hash"], later["hash"])], later[at])
            if pairs:
                yield from close()

        packed = self.docs.mapInArrow(entries, PACKED).repartition(parts, "part").sortWithinPartitions("part")
        kind = "grp long, role int, block binary"
        some = packed.mapInArrow(compare, kind).repartition(parts, "grp").sortWithinPartitions("grp", "role").mapInArrow(across, kind)
        return some.select(F.col("grp").alias("part"), "block"), text_parts

    def linked_sets(self) -> DataFrame:
        """(a, ca, b, cb, common, n_a, n_b): verified pairs of different sets, each once.

        Pairs meet the text of a in a's part, go on to b's part and are compared there.
        """
        pairs, parts = self.candidates()
        texts = self._texts(parts).repartition(parts, "part").groupBy("part")
        num, den = self.share.numerator, self.share.denominator

        def attach(p: pa.Table, t: pa.Table) -> pa.Table:
            a, b = _once(p.column("block").to_pylist()).T
            if not len(a):
                return pa.Table.from_batches([], OUT)
            at, ca, ta = _Texts(t).find(a)
            return pa.Table.from_batches([_by_part(_part(b[at], parts), [a[at], ca, b[at]], ta)], OUT)

        def verify(p: pa.Table, t: pa.Table) -> pa.Table:
            got: list[list] = [[] for _ in range(7)]
            store = _Texts(t)
            for x in p.column("block"):
                (a, ca, b), ta = _unblock(x.as_py(), 3)
                at, cb, tb = store.find(b)
                a, ca, b, ta = a[at], ca[at], b[at], ta.take(pa.array(at))
                for z in range(0, len(a), ts.MOST_TEXTS):
                    (ha, wa, na), (hb, wb, nb) = (ts.distinct(ts.scan(y.slice(z, ts.MOST_TEXTS))) for y in (ta, tb))
                    both = np.sort(np.r_[wa.astype(U) << U(52) | ha >> U(12), wb.astype(U) << U(52) | hb >> U(12)])
                    twice = both[1:][both[1:] == both[:-1]] >> U(52)
                    common = np.bincount(twice.astype(np.int64), minlength=len(na))
                    ok = np.flatnonzero(common * den >= num * np.maximum(na, nb))
                    for g, v in zip(got, (*(v[z:][ok].view(np.int64) for v in (a, ca, b, cb)), common[ok], na[ok], nb[ok])):
                        g.append(v)
            names = ("a", "ca", "b", "cb", "common", "n_a", "n_b")
            return pa.table({k: np.concatenate(g) if g else np.zeros(0, np.int64) for k, g in zip(names, got)})

        half = pairs.repartition(parts, "part").groupBy("part").cogroup(texts).applyInArrow(attach, PACKED)
        return half.repartition(parts, "part").groupBy("part").cogroup(texts).applyInArrow(verify, "a long, ca long, b long, cb long, common long, n_a long, n_b long")

    def key_pairs(self) -> DataFrame:
        """(key_a, key_b): every pair of keys, copies included."""
        # by set from the start, so that one shuffle serves both ends; the copies of a set are paired here in any case
        # (the filter, which lets everything pass, is what the optimizer adds for some of the joins: they read one shuffle if all have it)
        members = self._keyed().filter("id IS NOT NULL AND check IS NOT NULL AND key IS NOT NULL").repartition("id", "check").distinct()
        x = members.select(F.col("id").alias("a"), F.col("check").alias("ca"), F.col("key").alias("ka"))
        y = members.select(F.col("id").alias("b"), F.col("check").alias("cb"), F.col("key").alias("kb"))
        across = self.linked_sets().select("a", "ca", "b", "cb").join(x, ["a", "ca"]).join(y, ["b", "cb"])
        across = across.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).filter("key_a <> key_b")
        within = x.join(y, (F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb")) & (F.col("ka") < F.col("kb"))).select(F.col("ka").alias("key_a"), F.col("kb").alias("key_b"))
        return across.unionByName(within).distinct()

    def classes(self) -> DataFrame:
        """(key, class_key, n_links): one row a key with the smallest key of its class and its number of partners.

        Copies are not expanded: a key's partners are the others of its class and all of the classes linked with it.
        """
        members = self.members()
        sizes = members.groupBy("id", "check").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("class_key"))
        links = self.linked_sets().select("a", "ca", "b", "cb")
        both = links.unionAll(links.select("b", "cb", "a", "ca"))
        there = sizes.select(F.col("id").alias("b"), F.col("check").alias("cb"), "size")
        more = both.join(there, ["b", "cb"]).groupBy(F.col("a").alias("id"), F.col("ca").alias("check")).agg(F.sum("size").alias("more"))
        per = sizes.join(more, ["id", "check"], "left").select("id", "check", "class_key", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
        return members.join(per, ["id", "check"]).select("key", "class_key", "n_links")


def _first_of(ids: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The first place of each different (id, check)."""
    if not len(ids):
        return np.zeros(0, np.int64)
    order = np.lexsort((checks, ids))
    i, c = ids[order], checks[order]
    return np.sort(order[np.r_[True, (i[1:] != i[:-1]) | (c[1:] != c[:-1])]])


def _runs(part: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each part and the bytes of its rows."""
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return part[cuts], [x.tobytes() for x in np.split(rows, cuts[1:])]


def _group(part: int, number: int, parts: int) -> int:
    """A group for a block, apart from those of pairs."""
    return parts + part + (number << 40)


def _join(blocks: list[bytes]) -> bytes:
    """Packed entries of several blocks as one."""
    e = np.concatenate([_unpack(x) for x in blocks])
    return _pack_parts(np.zeros(len(e), np.int64), e)[1][0]


def _once(blocks: list[bytes]) -> np.ndarray:
    """[pair, 2]: each pair of the blocks once, sorted."""
    a, b = np.frombuffer(b"".join(blocks), U).reshape(-1, 2).T
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[new], b[new]], axis=1)


GROUPS = pa.schema([("grp", pa.int64()), ("role", pa.int32()), ("block", pa.binary())])
PACKED = "part long, block binary"
OUT = pa.schema([("part", pa.int64()), ("block", pa.binary())])


ZSTD = pa.Codec("zstd", compression_level=3)


def _squeeze(raw: bytes) -> bytes:
    return np.uint32(len(raw)).tobytes() + ZSTD.compress(raw, asbytes=True)


def _unsqueeze(block: bytes) -> bytes:
    return ZSTD.decompress(memoryview(block)[4:], decompressed_size=int.from_bytes(block[:4], "little"), asbytes=True)


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids >> U(32)) % U(parts)).astype(np.int64)


def _by_part(part: np.ndarray, columns: list[np.ndarray], texts: pa.Array) -> pa.RecordBatch:
    """Rows (columns of 64 bits and a text) as one compressed block a part."""
    order = np.argsort(part, kind="stable")
    cuts = np.r_[np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]), len(part)]
    blocks = []
    for i, j in zip(cuts[:-1], cuts[1:]):
        at = order[i:j]
        raw = [t.encode() for t in texts.take(pa.array(at)).to_pylist()]
        head = [np.uint32(len(at)).tobytes(), *(c[at].tobytes() for c in columns), np.fromiter(map(len, raw), np.uint32, len(raw)).tobytes()]
        blocks.append(_squeeze(b"".join(head + raw)))
    return pa.RecordBatch.from_arrays([pa.array(part[order][cuts[:-1]]), pa.array(blocks, pa.binary())], schema=OUT)


def _unblock(block: bytes, columns: int) -> tuple[list[np.ndarray], pa.Array]:
    raw = _unsqueeze(block)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    got = [np.frombuffer(raw, U, n, 4 + 8 * n * i) for i in range(columns)]
    at = 4 + 8 * n * columns
    ends = np.r_[0, np.cumsum(np.frombuffer(raw, np.uint32, n, at), dtype=np.int64)]
    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[at + 4 * n :]))
    return got, texts


class _Texts:
    """The texts of a part, by identifier."""

    def __init__(self, blocks: pa.Table):
        parts = [_unblock(x.as_py(), 2) for x in blocks.column("block")]
        known, checks = (np.concatenate([p[0][i] for p in parts]) for i in (0, 1))
        first = _first_of(known, checks)
        order = first[np.argsort(known[first], kind="stable")]
        self.known, self.checks, self.order = known[order], checks[order], order
        self.texts = pa.concat_arrays([p[1] for p in parts])

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Place in ids, check and text of every set with one of the identifiers (several, should two sets share one)."""
        lo = np.searchsorted(self.known, ids)
        n = np.searchsorted(self.known, ids, "right") - lo
        at = np.repeat(np.arange(len(ids)), n)
        place = np.repeat(lo, n) + ts.ragged(np.cumsum(n) - n, int(n.sum()))
        return at, self.checks[place], self.texts.take(pa.array(self.order[place]))


#: A part holds about as many entries at any size, so 23 bits of a band's hash tell its buckets apart; a rare mixture of
#: two only adds comparisons.
def _pack_parts(part: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each part and its entries as a block: numbers of entries and sets, hashes, a bit where a set begins, the sets.

    Entries of a set that are the same in all go once.
    """
    order = np.lexsort((e["hash"], *(e[f] for f in reversed(OF_SET)), part))
    part, e = part[order], e[order]
    begins, other = np.ones(len(e), bool), np.ones(len(e), bool)
    begins[1:] = part[1:] != part[:-1]
    for f in OF_SET:
        begins[1:] |= e[f][1:] != e[f][:-1]
    other[1:] = begins[1:] | (e["hash"][1:] != e["hash"][:-1])
    part, e, begins = part[other], e[other], begins[other]
    short = np.ascontiguousarray(e["hash"]).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    sets = np.empty(int(begins.sum()), SET)
    for f in SET.names:
        sets[f] = e[f][begins]
    whole = sets.tobytes()
    ends = np.cumsum(begins)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(e) else np.zeros(0, np.int64)
    blocks, done = [], 0
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(e)]):
        to = int(ends[j - 1])
        blocks.append(b"".join((np.array([j - i, to - done], np.uint32).tobytes(), short[3 * i : 3 * j], np.packbits(begins[i:j]).tobytes(), whole[SET.itemsize * done : SET.itemsize * to])))
        done = to
    return part[cuts], blocks


def _unpack(raw: bytes) -> np.ndarray:
    k, n = (int(x) for x in np.frombuffer(raw, np.uint32, 2))
    e, bits = np.zeros(k, ENTRY), 8 + 3 * k
    short = np.zeros((k, 4), np.uint8)
    short[:, :3] = np.frombuffer(raw, np.uint8, 3 * k, 8).reshape(-1, 3)
    e["hash"] = short.view(np.uint32)[:, 0]
    begins = np.unpackbits(np.frombuffer(raw, np.uint8, -(-k // 8), bits), count=k)
    sets = np.frombuffer(raw, SET, n, bits + -(-k // 8))[np.cumsum(begins, dtype=np.int64) - 1]
    for f in SET.names:
        e[f] = sets[f]
    return e
