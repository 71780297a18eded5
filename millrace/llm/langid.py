"""The language of documents and of their segments by hyperdimensional profiles (problem 9).

Each letter has a random vector of DIMENSIONS signs. An n-gram's vector binds its letters' vectors, each permuted
(rolled) by its place, by multiplication; a text's vector bundles (adds) those of its n-grams; a language's prototype
bundles its training sentences, weighting each n-gram by how much it tells the languages apart. A text has the language whose prototype has
the largest cosine with it.

Bundling is linear, so the product of a text's vector with a prototype is the sum of its n-grams' products with it.
These are computed once, for the n-grams met in training (what was never met has an expected product of zero), and
looked up; the length of a text's vector follows from its n-gram counts, as n-gram vectors are nearly orthogonal.
Reading a corpus thus costs one lookup an n-gram, no shuffle, and a model of bounded size is broadcast.

Training takes the labels as they are, wrong ones included: prototypes are made from the sentences of labelled rows, the
sentences are then read with them, and prototypes are made again from those that are read as labelled. It uses a sample
of about train_rows labelled rows, whole texts, drawn by a hash of their identifier; everything else covers all rows.
N-grams are counted in the executors; what comes to the driver is at most one number for each n-gram and language, and
there are 2 ** 18 n-grams. A model can be saved and loaded.

Batches are read in NumPy: code points run through tables of letters, words and digits; only the ends of sentences are
looked for in text form.

Defined cases: null, empty and blank texts and what is no language (cosine under LEAST, or fewer than min_words words)
have no language and no confidence, and of a sentence's words at least LEAST_PLAIN must be without digits; ties go to the first language in the order given; texts are read whole; repeated
rows are all read; an empty table, or one without any labelled row, gives no languages; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import stripped
from millrace.session import cut

LANGUAGES = ("en", "de", "fr", "es", "pt", "it")
#: Other ways of writing a language's name; fixed values.
NAMES = {
    "en": ("eng", "english"),
    "de": ("ger", "deu", "german", "deutsch"),
    "fr": ("fre", "fra", "french", "français", "francais"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "it": ("ita", "italian", "italiano"),
}
DIMENSIONS = 8192
N = 3
LEAST = 0.06
SHARPNESS = 24.0
#: Letters with a vector of their own; other letters share one. Symbol 0 is what stands between words.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7) + "œ"
OTHER = len(LETTERS) + 1
BITS = 6
#: A sentence ends after a run of marks, with closing ones, before white space, closing marks or the end; or at an empty line.
END = re.compile(r"[.!?…]+(?=[\s»”\"'’)\]]|$)[»”\"'’)\]]*|\n(?=\s*\n)")
#: Words of letters alone that a sentence needs to be read.
LEAST_PLAIN = 3
MOST_BYTES = 1 << 22


class Model(NamedTuple):
    languages: tuple[str, ...]
    grams: np.ndarray  # sorted n-gram codes
    products: np.ndarray  # [gram, language]: products with the unit prototypes, over sqrt(DIMENSIONS)


def declared_language(c: Column | str) -> Column:
    """The language a label names, however written; null if it names none of LANGUAGES."""
    low = F.lower(stripped(c))
    head = F.regexp_extract(low, r"^(\p{L}+)", 1)
    out = F.lit(None).cast("string")
    for lang in LANGUAGES:
        out = F.when(head.isin(lang, *NAMES[lang]), F.lit(lang)).otherwise(out)
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the letter's symbol; and 1 for letters and digits, 2 for digits, 4 for white space."""
    symbol, kind = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            kind[i] = 1 | 2 * c.isdecimal()
        elif c.isspace():
            kind[i] = 4
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            k = LETTERS.find(c.lower()[0])
            symbol[i] = k + 1 if k >= 0 else OTHER
    symbol[0x10000:0x30000] = OTHER  # letters beyond the basic plane, pictures among them
    symbol[0x1F000:0x1FB00] = 0
    return symbol, kind


class Parsed(NamedTuple):
    """The sentences of a batch of texts."""

    text: np.ndarray  # which text each is of
    start: np.ndarray  # in code points of the text
    end: np.ndarray
    words: np.ndarray  # runs of letters and digits, but for addresses and runs of one sign
    plain: np.ndarray  # words of tokens without digits among them
    code: np.ndarray  # n-grams
    of: np.ndarray  # the sentence of each n-gram


def parse(texts: Sequence[str | None]) -> Parsed:
    """Sentences with at least one word, and their n-grams; runs of non-letters count as one gap.

    Tokens with digits, addresses and runs of one sign (four or more) tell nothing of the language and are gaps.
    """
    symbol, kind = _tables()
    texts = [t or "" for t in texts]
    text, ends = [], []
    for i, t in enumerate(texts):
        at = [m.end() for m in END.finditer(t)]
        if t and (not at or at[-1] != len(t)):
            at.append(len(t))
        text += [i] * len(at)
        ends += at
    z = np.zeros(0, np.int64)
    if not ends:
        return Parsed(z, z, z, z, z, z, z)
    text, end = np.array(text), np.array(ends)
    first = np.r_[True, text[1:] != text[:-1]]
    start = np.where(first, 0, np.r_[0, end[:-1]])
    base = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(end)
    length = end - start
    last = np.r_[first[1:], True]
    filled = np.flatnonzero(np.fromiter(map(bool, texts), bool, len(texts)))
    kept = np.ones(len(codes), bool)  # the line ends after empty texts are no sentence's
    kept[base[:-1][np.setdiff1d(np.arange(len(texts)), filled)]] = False
    codes = codes[kept]
    of = np.repeat(np.arange(n), length + last)
    k = kind[codes]
    s = symbol[codes]
    # tokens between white space
    space = k == 4
    token = np.cumsum(space)
    tokens = int(token[-1]) + 1
    odd = np.zeros(tokens, bool)
    same = (codes[1:] == codes[:-1]) & ~space[1:]
    if len(codes) > 3:
        odd[token[3:][same[2:] & same[1:-1] & same[:-2]]] = True
        odd[token[2:][(codes[:-2] == ord(":")) & (codes[1:-1] == ord("/")) & (codes[2:] == ord("/"))]] = True
    digits = odd.copy()
    digits[token[k & 2 > 0]] = True
    alnum = k & 1 > 0
    begin = alnum.copy()
    begin[1:] &= ~alnum[:-1] | (of[1:] != of[:-1])
    begin = np.flatnonzero(begin)
    words = np.bincount(of[begin[~odd[token[begin]]]], minlength=n)
    plain = np.bincount(of[begin[~digits[token[begin]]]], minlength=n)
    s = np.where(digits[token], 0, s).astype(np.int64)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
    keep[0] = s[0] > 0
    s, o = s[keep], of[keep]
    if len(s) and s[0] > 0:  # a sentence begins with a gap: that which ends the one before
        s, o = np.r_[0, s], np.r_[o[0], o]
    code = np.zeros(max(len(s) - N + 1, 0), np.int64)
    for i in range(N):
        code = code << BITS | s[i : len(code) + i]
    who = o[N - 1 :][: len(code)]
    inside = (o[: len(code)] == who) | ((s[: len(code)] == 0) & (o[1:][: len(code)] == who))
    code, who = code[inside], who[inside]
    some = words > 0
    new = np.cumsum(some) - 1
    use = some[who]
    return Parsed(text[some], start[some], end[some], words[some], plain[some], code[use], new[who[use]])


def gram_vectors(codes: np.ndarray, seed: int = 0) -> np.ndarray:
    """[code, DIMENSIONS] signs: letters' vectors rolled by their place and multiplied."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (1 << BITS, DIMENSIONS))
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for i in range(N):
        out *= np.roll(letters, N - 1 - i, axis=1)[codes >> BITS * (N - 1 - i) & (1 << BITS) - 1]
    return out


def build(counts: np.ndarray, grams: np.ndarray, languages: tuple[str, ...] = LANGUAGES) -> Model:
    """A model from [language, gram] counts; prototypes bundle each n-gram as far as it tells the languages apart.

    That is by the share of its uses that each language has.
    """
    k, g = len(languages), len(grams)
    total = counts.sum(axis=1, keepdims=True)
    some = total[:, 0] > 0
    rate = np.where(total > 0, counts / np.maximum(total, 1), 0) * 1e5
    weight = (rate + 0.5) / (rate + 0.5)[some].sum(axis=0) - 1 / max(some.sum(), 1) if g and some.any() else rate
    weight[~some] = 0
    prototypes = np.zeros((k, DIMENSIONS), np.float32)
    for at in range(0, g, 1024):
        prototypes += weight[:, at : at + 1024].astype(np.float32) @ gram_vectors(grams[at : at + 1024]).astype(np.float32)
    length = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = (prototypes / np.where(length > 0, length, 1)).T
    products = [gram_vectors(grams[at : at + 1024]).astype(np.float32) @ unit for at in range(0, g, 1024)]
    products = np.concatenate(products) if g else np.zeros((0, k))
    return Model(languages, grams, (products / np.sqrt(DIMENSIONS)).astype(np.float32))


def scores(code: np.ndarray, of: np.ndarray, n: int, m: Model) -> np.ndarray:
    """[sentence, language]: products of the sentences' vectors with the prototypes."""
    out = np.zeros((n, len(m.languages)))
    if len(m.grams) and len(code):
        at = np.searchsorted(m.grams, code)
        at[at == len(m.grams)] = 0
        hit = m.grams[at] == code
        at, who = at[hit], of[hit]
        for k in range(len(m.languages)):
            out[:, k] = np.bincount(who, m.products[at, k], minlength=n)
    return out


def cosines(p: Parsed, m: Model) -> np.ndarray:
    """[sentence, language]"""
    n = len(p.text)
    out = scores(p.code, p.of, n, m)
    if len(p.code):
        # length of each sentence's vector over sqrt(DIMENSIONS): root of the sum of squared n-gram counts
        both = np.sort(p.of << BITS * N | p.code)
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        times = np.diff(np.r_[first, len(both)]).astype(float)
        length = np.sqrt(np.bincount(both[first] >> BITS * N, times**2, minlength=n))
        out /= np.maximum(length, 1e-9)[:, None]
    return out


class Read(NamedTuple):
    """Sentences of a batch: their texts, places, words, language (its place in the model, -1 for none) and confidence."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    lang: np.ndarray
    sure: np.ndarray


def read(texts: Sequence[str | None], model: Model, min_words: int = 6) -> Read:
    p = parse(texts)
    c = cosines(p, model)
    if not len(p.text):
        return Read(*p[:4], np.zeros(0, np.int64), np.zeros(0))
    best, top = c.argmax(axis=1), c.max(axis=1)
    e = np.exp(SHARPNESS * (c - top[:, None]))
    sure = 1 / e.sum(axis=1)
    good = (p.words >= min_words) & (p.plain >= LEAST_PLAIN) & (top >= LEAST)
    return Read(*p[:4], np.where(good, best, -1), np.where(good, sure, 0.0))


def segments_of(sentences: list[tuple[int, int, int, str | None, float]]) -> list[tuple[int, int, int, str | None, float]]:
    """Neighbouring sentences of one language joined; short ones and non-language go with what is before them, or after."""
    out: list[list] = []
    for s in sentences:
        if out and (s[3] is None or s[3] == out[-1][3] or out[-1][3] is None):
            o = out[-1]
            if s[3] is not None:
                o[4] += s[4] * s[2]
                o[5] += s[2]
            o[1], o[2], o[3] = s[1], o[2] + s[2], o[3] or s[3]
        else:
            out.append([*s[:4], s[4] * s[2], s[2] if s[3] else 0])
    return [(a, b, w, lang, (c / k) if k else 0.0) for a, b, w, lang, c, k in out]


def fit(docs: DataFrame, key: str, text: str, label: str, train_rows: int = 6_000, min_words: int = 6, rounds: int = 2) -> Model:
    """A model from about train_rows labelled rows of docs, whole texts."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("k"), declared_language(label).alias("l"), F.col(text).alias("t")).filter("l IS NOT NULL AND t IS NOT NULL")
    labelled = d.count()
    drawn = min(1 << 40, math.ceil((1 << 40) * train_rows / max(labelled, 1)))
    rows = cut(d.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 40)) < drawn).select("l", "t"))
    known = {x: i for i, x in enumerate(LANGUAGES)}
    model: Model | None = None
    for _ in range(rounds + 1):
        sent = spark.sparkContext.broadcast(model)  # of bounded size: 2 ** 18 n-grams

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = np.zeros(len(LANGUAGES) << BITS * N, np.int64)
            for whole in batches:
                for b in _slices(whole, 1):
                    own = np.array([known[x] for x in b.column(0).to_pylist()], np.int64)
                    p = parse(b.column(1).to_pylist())
                    good = p.words >= min_words
                    lang = own[p.text]
                    if sent.value is not None:
                        good &= cosines(p, sent.value).argmax(axis=1) == lang
                    use = good[p.of]
                    held += np.bincount(lang[p.of[use]] << BITS * N | p.code[use], minlength=len(held))
            at = np.flatnonzero(held)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["at", "n"])

        got = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        at, n = got.column("at").to_numpy(), got.column("n").to_numpy()
        grams, back = np.unique(at & (1 << BITS * N) - 1, return_inverse=True)
        counts = np.zeros((len(LANGUAGES), len(grams)))
        counts[at >> BITS * N, back] = n
        model = build(counts, grams)
        if not len(grams):
            break
    return model


def save(spark: SparkSession, model: Model, path: str) -> None:
    """As a table of n-grams with a product for each language."""
    columns = {"gram": model.grams, **dict(zip(model.languages, model.products.T))}
    spark.createDataFrame(pa.table({k: np.ascontiguousarray(v) for k, v in columns.items()})).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    t = spark.read.parquet(path).orderBy("gram").toArrow()  # of bounded size
    languages = tuple(c for c in t.column_names if c != "gram")
    products = np.stack([t.column(c).to_numpy() for c in languages], axis=1)
    return Model(languages, t.column("gram").to_numpy(), products)


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most about MOST_BYTES of text and 4,096 rows; one row at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64) + MOST_BYTES // 4096)
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_BYTES, "right")))
        yield b.slice(at, to - at)
        at = to


def _read(docs: DataFrame, model: Model, key: str, text: str, min_words: int, keep: Sequence[str], make, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(key), *keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, whole.num_columns - 1):
                yield make(b, read(b.column(b.num_columns - 1).to_pylist(), sent.value, min_words))

    return d.mapInArrow(run, schema)


def document_languages(docs: DataFrame, model: Model, key: str, text: str, min_words: int = 6) -> DataFrame:
    """(key, lang, confidence): the language of most words; confidence is its share of them times its sentences' own."""
    k = len(model.languages)

    def make(b: pa.RecordBatch, r: Read) -> pa.RecordBatch:
        ok = r.lang >= 0
        at = r.text[ok] * k + r.lang[ok]
        words, weight = (np.bincount(at, x, minlength=b.num_rows * k).reshape(-1, k) for x in (r.words[ok], r.words[ok] * r.sure[ok]))
        best = _first_best(words, model.languages)
        total = words.sum(axis=1)
        some = total > 0
        lang = np.where(some, np.array(model.languages, object)[best], None)
        sure = weight[np.arange(len(best)), best] / np.maximum(total, 1)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(sure, pa.float64(), mask=~some)], [key, "lang", "confidence"])

    kind = dict(docs.dtypes)[key]
    return _read(docs, model, key, text, min_words, [], make, f"`{key}` {kind}, lang string, confidence double")


def _first_best(words: np.ndarray, languages: tuple[str, ...]) -> np.ndarray:
    """The language of most words; of ties the first by name."""
    order = np.argsort(languages)
    return order[words[:, order].argmax(axis=1)] if len(words) else np.zeros(0, np.int64)


def segment_languages(docs: DataFrame, model: Model, key: str, text: str, min_words: int = 6) -> DataFrame:
    """(key, segment, start, end, n_words, lang, confidence): places are code points, end excluded."""

    def make(b: pa.RecordBatch, r: Read) -> pa.RecordBatch:
        names = [*model.languages, None]
        sentences: list[list] = [[] for _ in range(b.num_rows)]
        for i, *x, lang, sure in zip(*(c.tolist() for c in r)):
            sentences[i].append((*x, names[lang], sure))
        at, rows = [], []
        for i, own in enumerate(sentences):
            for n, s in enumerate(segments_of(own)):
                at.append(i)
                rows.append((n, *s[:4], s[4] if s[3] else None))
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], [key, "segment", "start", "end", "n_words", "lang", "confidence"])

    kind = dict(docs.dtypes)[key]
    return _read(docs, model, key, text, min_words, [], make, f"`{key}` {kind}, segment int, start int, end int, n_words int, lang string, confidence double")


def mislabelled(docs: DataFrame, model: Model, key: str, text: str, label: str, min_words: int = 6) -> DataFrame:
    """(key, lang): languages in which a text has a sentence of min_words words and which its label doesn't name."""
    d = docs.withColumn("__declared", declared_language(label))
    known = {x: i for i, x in enumerate(model.languages)}
    k = len(model.languages)

    def make(b: pa.RecordBatch, r: Read) -> pa.RecordBatch:
        own = np.array([known.get(x, -1) for x in b.column(1).to_pylist()], np.int64)
        ok = (r.lang >= 0) & (r.lang != own[r.text])
        both = np.unique(r.text[ok] * k + r.lang[ok])
        langs = np.array(model.languages, object)[both % k]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(both // k)), pa.array(langs, pa.string())], [key, "lang"])

    kind = dict(docs.dtypes)[key]
    return _read(d, model, key, text, min_words, ["__declared"], make, f"`{key}` {kind}, lang string").distinct()
