"""Encoding whole corpora with a public byte-level BPE vocabulary (problem 7).

The different words of a corpus part (an Arrow batch; words known from earlier batches of the task are not encoded
again) lie in one array of symbols. An inverted index leads from each mergeable pair to the positions where it stands.
The merges are then replayed over the part, once, in rank order: a merge visits its positions from left to right and
touches nothing but the two neighbours of each, whose new pairs enter the index. A merge can only make pairs of a later
rank, because its product didn't exist before, so one pass suffices.

Words don't reach across texts, so parts need nothing of each other: the corpus is encoded without a shuffle, whatever
its size and whatever share of it one text has. Memory is that of a batch and of a cache with a fixed number of words.

The vocabulary file is read on the driver and broadcast (about 50,000 merges; its size doesn't depend on the data).

Defined cases: null and empty texts give an empty list; special tokens' strings in a text are ordinary text; every byte
is a symbol, so no text is without ids; long texts are encoded whole; repeated rows are all encoded; columns other than
the two named are dropped.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the vocabulary splits text before merging; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 500_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


class Merges(NamedTuple):
    """keys: sorted left << 32 | right of each merge; ranks: their order; product: the id a merge of a rank makes."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    left: np.ndarray
    right: np.ndarray
    product: np.ndarray


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_merges(path: str) -> Merges:
    model = json.load(open(path, encoding="utf-8"))["model"]
    ids = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    left = np.array([ids[a] for a, _ in pairs], np.int64)
    right = np.array([ids[b] for _, b in pairs], np.int64)
    product = np.array([ids[a + b] for a, b in pairs], np.int64)
    keys = left << 32 | right
    order = np.argsort(keys)
    letters = byte_letters()
    return Merges(np.array([ids[letters[b]] for b in range(256)], np.int64), keys[order], order.astype(np.int64), left, right, product)


def replay(words: list[bytes], m: Merges) -> list[np.ndarray]:
    """The ids of each word; no word is empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    sym_a = m.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym_a)
    ends = np.cumsum(lengths)
    # the index, ranks in order and positions in order within them
    key = sym_a[:-1] << 32 | sym_a[1:]
    inside = np.ones(max(n - 1, 0), bool)
    inside[ends[:-1] - 1] = False
    at = np.searchsorted(m.keys, key)
    at[at == len(m.keys)] = 0
    hit = np.flatnonzero((m.keys[at] == key) & inside) if n > 1 else np.zeros(0, np.int64)
    rank = m.ranks[at[hit]] if n > 1 else hit
    order = np.argsort(rank, kind="stable")
    hit, rank = hit[order], rank[order]
    cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
    index = {int(rank[c]): p.tolist() for c, p in zip(cuts, np.split(hit, cuts[1:]))}
    todo = list(index)
    ranks = _rank_of(m)
    sym = sym_a.tolist()
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    for e in ends.tolist():
        nxt[e - 1] = -1
        if e < n:
            prv[e] = -1
    lefts, rights, products = m.left.tolist(), m.right.tolist(), m.product.tolist()
    while todo:
        r = heapq.heappop(todo)
        a, b, c = lefts[r], rights[r], products[r]
        for p in sorted(index.pop(r)):
            if sym[p] != a:
                continue
            q = nxt[p]
            if q < 0 or sym[q] != b:
                continue
            sym[p], sym[q] = c, -1
            after = nxt[p] = nxt[q]
            if after >= 0:
                prv[after] = p
                k = ranks.get(c << 32 | sym[after])
                if k is not None:
                    if k in index:
                        index[k].append(p)
                    else:
                        index[k] = [p]
                        heapq.heappush(todo, k)
            before = prv[p]
            if before >= 0:
                k = ranks.get(sym[before] << 32 | c)
                if k is not None:
                    if k in index:
                        index[k].append(before)
                    else:
                        index[k] = [before]
                        heapq.heappush(todo, k)
    done = np.array(sym, np.int32)
    alive = done >= 0
    kept = np.cumsum(alive)
    return np.split(done[alive], kept[ends - 1][:-1])


_RANKS: dict[int, dict[int, int]] = {}


def _rank_of(m: Merges) -> dict[int, int]:
    if id(m) not in _RANKS:
        _RANKS.clear()
        _RANKS[id(m)] = dict(zip(m.keys.tolist(), m.ranks.tolist()))
    return _RANKS[id(m)]


class Encoder:
    """Encodes lists of texts; keeps the ids of words it has met."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.merges, self.find = merges, regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts."""
        words = [self.find(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list(set(chain.from_iterable(words)).difference(self.known))
        if new:
            self.known.update(zip(new, (x.tolist() for x in replay([w.encode("utf-8") for w in new], self.merges))))
        get = self.known.__getitem__
        per = [list(chain.from_iterable(map(get, w))) for w in words]
        lengths = np.fromiter(map(len, per), np.int64, len(per))
        return np.r_[0, np.cumsum(lengths)], np.fromiter(chain.from_iterable(per), np.int32, int(lengths.sum()))


def _small_batches(b: pa.RecordBatch, column: int, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of at most about `most` bytes of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0))
    at, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if total and total + s > most:
            yield b.slice(at, i - at)
            at, total = i, 0
        total += s
    if at < b.num_rows:
        yield b.slice(at)


def encode_corpus(docs: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of every text, without special tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(read_merges(path))
    d = docs.select(F.col(key), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for whole in batches:
            for b in _small_batches(whole, 1):
                offsets, ids = encoder.encode(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], [key, "ids"])

    return d.mapInArrow(run, f"`{key}` {dict(d.dtypes)[key]}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """The columns to keep and n_tokens of each text; ids are not sent on."""
    sent = docs.sparkSession.sparkContext.broadcast(read_merges(path))
    d = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for whole in batches:
            for b in _small_batches(whole, len(keep)):
                offsets, _ = encoder.encode(b.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(np.diff(offsets))], [*keep, "n_tokens"])

    kinds = dict(d.dtypes)
    return d.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long")
