import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import setsketch
from millrace.llm import textscan as ts
from millrace.llm.foldhash import collapse_copies, hash_batch, same_text
from millrace.llm.setsketch import NearDuplicates

WORD = re.compile(r"[^\W_]+")


def brute_pairs(rows, share=0.7, least=5):
    sets = {}
    for k, t in rows:
        if k is not None and t is not None:
            sets.setdefault(k, set()).add(frozenset(WORD.findall(t.lower())))
    keys = sorted(sets)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if min(len(x), len(y)) >= least and 10 * len(x & y) >= round(share * 10) * max(len(x), len(y)):
                        out.add((a, b))
    return out


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = rng.sample(vocabulary, 20)
        rows.append((f"k{i:04}", " ".join(words)))
        if i % 5 == 0:  # some words replaced, order changed
            for j, keep in enumerate((19, 17, 14)):
                w = rng.sample(words, keep) + [f"new{rng.randrange(10**6)}" for _ in range(20 - keep)]
                rng.shuffle(w)
                rows.append((f"k{i:04}.{j}", ", ".join(w).upper()))
    return rows


def test_pairs_against_all_pairs(spark):
    rows = corpus(250)
    df = spark.createDataFrame(rows, "key string, text string")
    got = {tuple(r) for r in NearDuplicates(df, "key", "text").key_pairs().collect()}
    want = brute_pairs(rows)
    assert not got - want
    assert len(got & want) >= 0.98 * len(want) and len(want) > 100


@pytest.mark.parametrize("n", [360_000, 3_600_000, 36_000_000])
def test_bands_of_larger_corpora_lose_no_more(n):
    rng = np.random.default_rng(1)
    words = ts.mix(np.arange(400, dtype=np.uint64))
    codes = np.zeros(1 << 22, np.uint8)
    codes[setsketch._slot(words, 22)] = setsketch.count_codes(np.array([n // 20]))  # every word in a twentieth of the texts
    sets = [rng.permutation(400)[:24] for _ in range(2000)]
    rows = [r for s in sets for r in (s[:20], s[4:])]  # 16 of 20 words in common
    n_bands = setsketch.bands_for(n, 1024.0, 12)
    key, alive = setsketch.band_keys(words, np.concatenate(rows), np.arange(len(rows)) * 20, codes, n, n_bands, 1024.0, 12)
    key[~alive] = np.arange((~alive).sum(), dtype=np.uint64)
    found = (key[::2, :, None] == key[1::2, None, :]).any(axis=(1, 2))
    assert found.mean() >= 0.99


def test_the_estimate_loses_no_pair_at_the_threshold(spark):
    rng = random.Random(7)
    rows = []
    for i in range(2500):  # 14 of 20 words in common, all rare enough for bands of their own
        for k in "ab":
            rows.append((f"{k}{i:04}", " ".join([*(f"c{i}x{j}" for j in range(14)), *(f"w{x}" for x in rng.sample(range(400), 6))])))
    df = spark.createDataFrame(rows, "key string, text string")
    got = {tuple(r) for r in NearDuplicates(df, "key", "text").key_pairs().collect()}
    assert got == {(f"a{i:04}", f"b{i:04}") for i in range(2500)}


@pytest.mark.parametrize("n", [5, 20, 69, 70, 90, 100, 101, 130, 300])
def test_texts_of_all_lengths_meet_their_partners(spark, n):
    rows = [r for i in range(12) for r in ((f"a{i}", " ".join(f"c{i}x{j}" for j in range(n))), (f"b{i}", " ".join(f"c{i}x{j}" for j in range(-(-7 * n // 10)))))]
    df = spark.createDataFrame(rows, "key string, text string").repartition(2)
    got = {tuple(r) for r in NearDuplicates(df, "key", "text").key_pairs().collect()}
    assert got == brute_pairs(rows) and (len(got) == 12 or n == 5)


def test_bands_of_a_text_in_a_part_share_its_signature():
    rng = np.random.default_rng(6)
    e = np.zeros(3000, setsketch.ENTRY)
    of = rng.integers(0, 300, 3000)
    e["hash"] = rng.integers(0, 1 << 24, 3000)
    for f in setsketch.SET.names:
        e[f] = rng.integers(0, 200, 300)[of]
    part, blocks = setsketch._pack_parts(of % 3, e)
    assert part.tolist() == [0, 1, 2] and sum(map(len, blocks)) < 300 * 42 + 3000 * 3.2 + 30
    back = np.concatenate([setsketch._unpack(x) for x in blocks])
    assert sorted(back.tolist()) == sorted(set(e.tolist()))


def test_pairs_of_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [("a", "one two three four five"), ("b", "FIVE four-three, two one!"), ("b", "FIVE four-three, two one!"), ("c", None), (None, "one two three four five"), ("d", ""), ("e", "one two three four"),
            ("f", long), ("g", long + " y"), ("h", "　​"), ("i", "one two three four five six seven")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "key string, text string, part int")
    got = sorted(tuple(r) for r in NearDuplicates(df, "key", "text").key_pairs().collect())
    assert got == sorted(brute_pairs([r for r in rows if r[0] is not None]))
    assert ("a", "b") in got and ("f", "g") in got
    assert NearDuplicates(df.limit(0), "key", "text").key_pairs().count() == 0


def test_codes_hold_every_count():
    counts = np.array([0, 1, 2, 3, 1 << 31, 1 << 32, 1 << 36, 1 << 62])
    codes = setsketch.count_codes(counts)
    assert codes[:2].tolist() == [0, 1] and (np.diff(codes.astype(int)) > 0).all()
    back = setsketch.counts_of(codes)
    assert (back <= counts).all() and (back * 2 ** (1 / setsketch.STEPS) >= counts).all()


def test_sizes_beyond_the_limit_only_keep_more():
    share, bounds = setsketch.Fraction("0.7"), setsketch.agreement_bounds(0.001)
    rng = np.random.default_rng(4)
    na, ma = rng.integers(5, 2000, (2, 4000))
    nb, mb = rng.integers(5, 2000, (2, 4000))
    ma, mb = np.minimum(na, ma), np.minimum(nb, mb)
    equal = rng.integers(0, setsketch.SIGNATURE + 1, 4000)
    whole = setsketch.passes(equal, na, ma, nb, mb, share, bounds)
    short = setsketch.passes(equal, *(np.minimum(x, setsketch.SIZES - 1) for x in (na, ma, nb, mb)), share, bounds)
    assert not (whole & ~short & (np.minimum(ma, mb) * 10 >= 7 * np.maximum(na, nb)) & (na == ma) & (nb == mb)).any()


def test_hot_buckets_are_dealt_into_blocks(spark):
    rng = random.Random(5)
    same = [f"t{i}" for i in range(9)]
    rows = [(f"k{i:03}", " ".join([*same, *(f"v{rng.randrange(30)}a{j}" for j in range(3))])) for i in range(240)]
    df = spark.createDataFrame(rows, "key string, text string")
    got, whole = ({tuple(r) for r in NearDuplicates(df, "key", "text", split=k).key_pairs().collect()} for k in (200, 1_000_000))
    want = brute_pairs(rows)
    assert got == whole and not got - want and len(got) >= 0.997 * len(want)


def test_classes_count_the_partners_of_copies(spark):
    rows = corpus(60) + [(f"copy{i}", corpus(60)[0][1]) for i in range(3)]
    df = spark.createDataFrame(rows, "key string, text string")
    near = NearDuplicates(df, "key", "text")
    pairs = [tuple(r) for r in near.key_pairs().collect()]
    got = {r["key"]: (r["class_key"], r["n_links"]) for r in near.classes().collect()}
    assert set(got) == {k for k, _ in rows}
    assert all(n == sum(k in p for p in pairs) for k, (_, n) in got.items())
    assert len({got[k][0] for k in ("copy0", "copy1", "copy2", "k0000")}) == 1


def test_sets_with_one_identifier_stay_apart():
    t = setsketch._by_part(np.zeros(3, np.int64), [np.array([7, 7, 9], np.uint64), np.array([1, 2, 3], np.uint64)], pa.array(["a", "b", "c"]))
    at, checks, texts = setsketch._Texts(pa.Table.from_batches([t])).find(np.array([9, 7], np.uint64))
    assert at.tolist() == [0, 1, 1] and checks.tolist() == [3, 1, 2] and texts.to_pylist() == ["c", "a", "b"]


def test_a_third_of_all_rows_is_one_text(spark):
    hot = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"), F.lit("one and the same text here for all").alias("text"))
    rest = spark.range(6000).select(F.concat(F.lit("r"), "id").alias("key"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), "id") for i in range(8)]).alias("text"))
    n = NearDuplicates(hot.unionAll(rest), "key", "text")
    assert n.linked_sets().count() == 0
    assert n.members().filter("key LIKE 'h%'").select("id").distinct().count() == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aB1 .-é\n", max_size=30)), max_size=8))
def test_scan_finds_the_words(texts):
    w = ts.scan(pa.array(texts, pa.string()))
    want = [(i, m) for i, t in enumerate(texts) for m in WORD.findall((t or "")) if m]
    if any("".join(c.lower()[0] for c in m) != m.lower() for _, m in want):
        return  # lower case that is longer than the word
    assert w.text.tolist() == [i for i, _ in want]
    same = {}
    for (_, m), h in zip(want, w.hashes.tolist()):
        assert same.setdefault(m.lower(), h) == h
    assert len(set(same.values())) == len(same)


EQUAL = [
    ("Hello, big wide WORLD out there", "hello big  wide\tworld — out there!"),
    ("Title: a b c | Body: d e f", "BODY= d e f\nTITLE= a b c"),
    ("title a b c body d e f", "Title: a b c | Body: d e f"),
]
DIFFERENT = [("one two three four five", "one two three five four"), ("Title: a b c | Body: d e f", "Title: d e f | Body: a b c"), ("title a b c body d e f", "Body: d e f | Title: a b c")]


@pytest.mark.parametrize("a,b", EQUAL)
def test_equal_forms(a, b):
    assert same_text(a, b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_forms(a, b):
    assert not same_text(a, b)


def test_hashes_follow_the_comparison():
    texts = [x for p in EQUAL[:2] + DIFFERENT for x in p] + ["", "x y z v w", "TOPIC:x y z v w", None]
    p1, p2, f1, f2, n = hash_batch(pa.array(texts))
    form = [(f1[i], f2[i]) if f1[i] else (p1[i], p2[i]) for i in range(len(texts))]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if a and b and bool(f1[i]) == bool(f1[j]):
                assert (form[i] == form[j]) == same_text(a, b), (a, b)
    assert n[-1] == 0


def test_collapse(spark):
    rows = [("d1", "The quick brown fox jumps"), ("d2", "the QUICK, brown fox; jumps"), ("d2", "the QUICK, brown fox; jumps"), ("d3", "the quick brown jumps fox"), ("d4", None), ("d5", ""), ("d6", "a b c d"), ("d7", "A-B c D"),
            ("d9", "Topic: t | Title: x y | Body: q w e r"), ("d8", "BODY = q w e r; TITLE = x, y; TOPIC = t"), ("d0", "topic t title x y body q w e r"), (None, "The quick brown fox jumps")]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "key string, text string, rep string")
    got = sorted(tuple(r) for r in collapse_copies(df, "key", "text").collect())
    assert got == [("d0", 3), ("d1", 2)]
    assert collapse_copies(df.limit(0), "key", "text").count() == 0


def test_collapse_hot_text(spark):
    hot = spark.range(4000).select(F.format_string("h%05d", "id").alias("key"), F.when(F.col("id") % 2 == 0, "Same words in the row, again").otherwise("same WORDS in the row again").alias("text"))
    rest = spark.range(8000).select(F.format_string("r%05d", "id").alias("key"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), "id") for i in range(6)]).alias("text"))
    assert [tuple(r) for r in collapse_copies(hot.unionAll(rest), "key", "text").collect()] == [("h00000", 4000)]
