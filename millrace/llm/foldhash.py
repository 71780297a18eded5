"""Texts that are the same but for white space, letter case, punctuation or the order of labelled fields (problem 3).

Batches of texts stream through the skip-and-fold table of textscan into rolling polynomial hashes, one of 64 bits over
each word and two over the sequence of words; cleaned strings are never made. A text is a record if it begins with a
label and a mark; each field is hashed by itself and the fields are summed under their labels, so their order is lost.

Keys are grouped by hash; then the rows of groups are verified: each is compared with its group's representative by two
pointers that skip what the table skips. Rows that fail (a collision) are regrouped by their exact words.

Skew: keys are made distinct by a partial aggregation first, so one text with a third of all rows costs one key each
in two shuffles and is never gathered; the verifying join is keyed by the group and split by adaptive execution, its
other side being one row a group.

Defined cases: null and empty texts have no words and are left out as all texts under min_words different words; a key
delivered again counts once; a plain text with the very words of a record joins that record's group; ties for the
representative go to the smallest key; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textscan as ts

LABELS = ("title", "topic", "body")
MARKS = ":="
_WORD = re.compile(r"[^\W_]+")


def _label_hashes(labels: Sequence[str]) -> np.ndarray:
    return ts.scan(pa.array(list(labels))).hashes


def hash_batch(texts: pa.Array, labels: Sequence[str] = LABELS, marks: str = MARKS) -> tuple[np.ndarray, ...]:
    """For each text: two hashes of its words in order, two of it as a record (0 if it is none), different words."""
    w = ts.scan(texts)
    n = w.n
    first = np.flatnonzero(np.diff(w.text, prepend=-1)) if len(w.text) else np.zeros(0, int)
    plain = [np.zeros(n, ts.U) for _ in ts.BASES]
    fields = [np.zeros(n, ts.U) for _ in ts.BASES]
    if not len(first):
        return plain[0], plain[1], fields[0], fields[1], np.zeros(n, np.int64)
    for out, base in zip(plain, ts.BASES):
        out[w.text[first]] = ts.rolling(w.hashes, first, base)
    # labels: a label's word with a mark after it, white space between them or none
    known = _label_hashes(labels)
    maybe = np.flatnonzero(np.isin(w.hashes, known))
    is_label = np.zeros(len(w.hashes), bool)
    mark_codes = {ord(c) for c in marks}
    for k in maybe:
        i, stop = w.end[k], w.offsets[w.text[k] + 1]
        while i < stop and chr(w.codes[i]).isspace():
            i += 1
        is_label[k] = i < stop and int(w.codes[i]) in mark_codes
    record = np.zeros(n, bool)
    record[w.text[first]] = is_label[first]
    use = record[w.text] if len(w.text) else record
    if use.any():
        h, t, lab = w.hashes[use], w.text[use], is_label[use]
        starts = np.flatnonzero(lab)
        value = np.where(lab, ts.U(1), h)  # the label itself stands as 1: an empty value is a value
        for out, base in zip(fields, ts.BASES):
            of_field = ts.mix(ts.rolling(value, starts, base) ^ ts.mix(h[starts]))
            np.add.at(out, t[starts], of_field)
            out[record] |= ts.U(1)  # never 0
    return plain[0], plain[1], fields[0], fields[1], ts.distinct(w)[2]


def same_words(a: str, b: str) -> bool:
    """Two pointers over both texts, each skipping to its next word."""
    return a == b or all(x is not None and y is not None and x[0].lower() == y[0].lower() for x, y in zip_longest(_WORD.finditer(a), _WORD.finditer(b)))


def _fields(text: str, labels: Sequence[str], marks: str) -> list[tuple[str, str]] | None:
    cuts = list(re.finditer(rf"(?<![^\W_])({'|'.join(map(re.escape, labels))})\s*[{re.escape(marks)}]", text, re.I))
    word = _WORD.search(text)
    if not cuts or not word or word.start() != cuts[0].start():
        return None
    return sorted(((m[1].lower(), text[m.end() : n]) for m, n in zip(cuts, [*[m.start() for m in cuts[1:]], len(text)])), key=lambda x: x[0])


def same_text(a: str, b: str, labels: Sequence[str] = LABELS, marks: str = MARKS) -> bool:
    """The same words in the same order, as a whole or label by label."""
    if same_words(a, b):
        return True
    fa, fb = _fields(a, labels, marks), _fields(b, labels, marks)
    if not fa or not fb or [x for x, _ in fa] != [x for x, _ in fb]:
        return False
    if all(same_words(x, y) for (_, x), (_, y) in zip(fa, fb)):
        return True
    form = lambda f: sorted((k, tuple(x.lower() for x in _WORD.findall(v))) for k, v in f)  # noqa: E731  a label that occurs twice
    return form(fa) == form(fb)


def exact_form(text: str, labels: Sequence[str] = LABELS, marks: str = MARKS) -> str:
    """Only for rows whose hash collided."""
    f = _fields(text, labels, marks)
    if f is None:
        return " ".join(x.lower() for x in _WORD.findall(text))
    return "\n".join(sorted(k + ":" + " ".join(x.lower() for x in _WORD.findall(v)) for k, v in f))


def fingerprints(docs: DataFrame, key: str, text: str, min_words: int, labels: Sequence[str] = LABELS, marks: str = MARKS) -> DataFrame:
    """(key, text, h1, h2, p1, p2, record): h is what groups a row, p the hash of its plain words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in ts.slices(whole)):
            p1, p2, f1, f2, n = hash_batch(b.column(1), labels, marks)
            ok = np.flatnonzero(n >= min_words)
            if not len(ok):
                continue
            record = f1[ok] != 0
            columns = [np.where(record, f[ok], p[ok]).view(np.int64) for f, p in ((f1, p1), (f2, p2))]
            columns += [p1[ok].view(np.int64), p2[ok].view(np.int64), record]
            some = b.take(pa.array(ok))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *map(pa.array, columns)], ["key", "text", "h1", "h2", "p1", "p2", "record"])

    d = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("key IS NOT NULL AND text IS NOT NULL")
    return d.mapInArrow(run, "key string, text string, h1 long, h2 long, p1 long, p2 long, record boolean")


def collapse_copies(docs: DataFrame, key: str, text: str, min_words: int = 5, labels: Sequence[str] = LABELS, marks: str = MARKS) -> DataFrame:
    """(key, n_copies): the smallest key and the number of keys of each text that two or more keys have."""
    rows = fingerprints(docs, key, text, min_words, labels, marks)
    # A plain text with the very words of a record takes the record's hash, and is verified against that record.
    records = rows.filter("record").groupBy("p1", "p2").agg(F.min(F.struct("h1", "h2", "text")).alias("r"))
    records = records.select(F.col("p1").alias("h1"), F.col("p2").alias("h2"), F.col("r.h1").alias("r1"), F.col("r.h2").alias("r2"), F.col("r.text").alias("via"))
    keys = rows.select("h1", "h2", "key").distinct()
    firsts = keys.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n"))
    to = firsts.join(records, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("r1", "h1").alias("g1"), F.coalesce("r2", "h2").alias("g2"), "rep", "n", "via")
    groups = to.groupBy("g1", "g2").agg(F.sum("n").alias("n"), F.min(F.when(F.col("via").isNull(), F.col("rep"))).alias("rep")).filter("n > 1").select("g1", "g2", "rep")
    groups = to.select("h1", "h2", "g1", "g2", "via").join(groups, ["g1", "g2"])
    members = rows.select("key", "text", "h1", "h2").join(groups, ["h1", "h2"])
    texts = members.filter("key = rep AND via IS NULL").groupBy("g1", "g2").agg(F.min("text").alias("rep_text"))
    both = members.join(texts, ["g1", "g2"]).select("g1", "g2", "key", "text", F.coalesce("via", "rep_text").alias("rep_text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form = [None if same_text(x, y, labels, marks) else exact_form(x, labels, marks) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(form, pa.string())], ["g1", "g2", "key", "form"])

    sure = both.mapInArrow(verify, "g1 long, g2 long, key string, form string").distinct()
    return sure.groupBy("g1", "g2", "form").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1").select("key", "n_copies")
