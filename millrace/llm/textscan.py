"""Words of whole Arrow batches of texts, in NumPy.

A word is an unbroken run of letters and digits, in lower case. A text's code points run through one lookup table that
skips (0) or folds (the lower-case code point), straight into polynomial hashes; no cleaned string is ever made.
"""

from __future__ import annotations

import sys
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03))


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point to folded code point; 0 for what is neither letter nor digit."""
    t = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalnum():
            t[i] = ord(c.lower()[0])
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(maxsize=8)
def _powers_to(base: int, size: int) -> np.ndarray:
    p = np.full(size, U(base))
    p[0] = U(1)
    return np.multiply.accumulate(p)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    return _powers_to(int(base), 1 << max(10, int(n).bit_length()))[:n]


def ragged(starts: np.ndarray, total: int) -> np.ndarray:
    """Position of each element within its run."""
    return np.arange(total) - np.repeat(starts, np.diff(np.r_[starts, total]))


def rolling(values: np.ndarray, starts: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of values; runs are not empty."""
    if not len(starts):
        return np.zeros(0, U)
    pos = ragged(starts, len(values))
    return mix(np.add.reduceat(values * powers(base, int(pos.max()) + 1)[pos], starts))


class Words(NamedTuple):
    """All words of a batch in order: hash, text they belong to, place of the code point after them."""

    hashes: np.ndarray
    text: np.ndarray
    end: np.ndarray
    codes: np.ndarray  # all code points of the batch
    offsets: np.ndarray  # where each text begins in codes
    n: int


def scan(texts: pa.Array | pa.ChunkedArray, base: np.uint64 = BASES[0]) -> Words:
    """Null counts as an empty text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    offsets = np.r_[0, np.cumsum(lengths)]
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = memoryview(data)[ends[0] : ends[-1]] if data is not None and len(texts) else b""
    codes = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    kept = fold_table()[codes]
    alive = kept > 0
    begins = alive.copy()
    begins[1:] &= ~alive[:-1]
    first = offsets[:-1][lengths > 0]
    begins[first] = alive[first]
    at = np.flatnonzero(alive)
    starts = np.flatnonzero(begins[at])
    place = at[starts]
    hashes = rolling(mix(kept[at].astype(U) + U(1)), starts, base)
    end = at[np.r_[starts[1:], len(at)] - 1] + 1 if len(starts) else place
    return Words(hashes, np.searchsorted(offsets, place, "right") - 1, end, codes, offsets, len(texts))


#: distinct() takes at most so many texts at once; it keeps the upper 52 bits of a word's hash.
MOST_TEXTS = 4096


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words of each text: hashes sorted within texts, their texts, and how many each text has."""
    if w.n > MOST_TEXTS:
        raise ValueError(f"at most {MOST_TEXTS} texts at once")
    both = np.sort(w.text.astype(U) << U(52) | w.hashes >> U(12))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    t = (both >> U(52)).astype(np.int64)
    return both << U(12), t, np.bincount(t, minlength=w.n)


def slices(b: pa.RecordBatch | pa.Table, size: int = MOST_TEXTS):
    """Slices of at most `size` rows."""
    for at in range(0, b.num_rows, size):
        yield b.slice(at, size)
