import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bpe, crosspolytope, langid, queries
from millrace.llm.crosspolytope import buckets, hadamard, most_similar, rotate
from millrace.llm.mixture import Mixture, source_name


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(hadamard(hadamard(x)), x)
    y = rotate(x, 7)
    assert np.allclose(y @ y.T, x @ x.T)
    b = buckets(x, 0, 2, 4)
    assert b.shape == (5, 4) and all(len(set(r)) == 4 for r in b.tolist())


def clustered(n=600, d=64, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, d))
    return (centres[rng.integers(0, len(centres), n)] + 0.12 * rng.normal(size=(n, d))) * rng.uniform(0.2, 5, size=(n, 1))


def brute(ids, x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = {}
    for i, a in enumerate(ids):
        c = [(-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= least]
        out[a] = [b for _, b in sorted(c)[:k]]
    return out


def test_neighbours_against_brute_force(spark):
    x = clustered()
    x[10:16] = x[10]  # copies
    x[20] = 3 * x[21]
    ids = list(range(1000, 1000 + len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "doc_id long, vector array<double>")
    got = {}
    for r in most_similar(df, "doc_id", "vector").orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    want = brute(ids, x, 5, 0.9)
    pairs = lambda m: {(a, b) for a, v in m.items() for b in v}
    assert len(pairs(got) & pairs(want)) >= 0.99 * len(pairs(want)) and len(pairs(want)) > 500
    assert all(len(v) <= 5 for v in got.values())


@pytest.mark.parametrize("hashes", [2, 3])
def test_recall_at_the_least_cosine_holds_with_more_hashes(spark, hashes):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.9001 * x + np.sqrt(1 - 0.9001**2) * y
    rows = [(2 * i + s, v.tolist()) for i in range(1000) for s, v in ((0, x[i]), (1, z[i]))]
    df = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    # so few rows a bucket that 2,000 vectors ask for that many hashes
    got = similar(df, bucket_rows=2000 / 128**hashes)
    assert sum(2 * i + 1 in got.get(2 * i, []) for i in range(1000)) >= 985


def similar(df, **kw):
    got = {}
    for r in most_similar(df, "doc_id", "vector", **kw).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    return got


def test_nearest_without_a_least_cosine(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "GRID_ROWS", 100)  # more blocks
    x = np.concatenate([clustered(), np.random.default_rng(3).normal(size=(300, 64))])
    x[10:20] = x[10]  # copies
    ids = list(range(1000, 1000 + len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "doc_id long, vector array<double>")
    assert similar(df, least=None) == brute(ids, x, 5, -2)
    few = df.filter("doc_id >= 1017 AND doc_id < 1021")
    assert similar(few, least=None) == brute(ids[17:21], x[17:21], 5, -2)
    assert similar(df.limit(1), least=None) == {} and similar(df.limit(0), least=None) == {}


def test_blocks_of_many_tiles(monkeypatch):
    monkeypatch.setattr(crosspolytope, "BLOCK", 64)
    x, ids = clustered(), np.arange(600) * 7
    want = brute(ids.tolist(), x, 5, -2)
    a, b = slice(0, 350), slice(350, 600)
    e = np.concatenate([crosspolytope._best_of_blocks(ids[p], x[p], ids[q], x[q], 5, p == q) for p, q in ((a, a), (b, b), (a, b))])
    got = {i: [f["b"] for f in np.sort(e[e["a"] == i], order="s")[::-1][:5]] for i in ids.tolist()}
    assert {i: set(v) for i, v in got.items()} == {i: set(v) for i, v in want.items()}


def test_p6_similar_finds_the_true_neighbours(spark):
    d = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r["vector"] for r in spark.read.parquet(f"{d}/doc_vectors.parquet").collect() if r["vector"] and len(r["vector"]) == 64}
    rows = {i: v for i, v in rows.items() if np.isfinite(v).all() and np.any(v)}
    want = brute(list(rows), np.array(list(rows.values())), 5, -2)
    got = {}
    for r in queries.p6_similar(spark, d).collect():
        got.setdefault(r["doc_id"], set()).add(r["similar_doc_id"])
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(got[i] & set(v)) for i, v in want.items()) >= 0.99 * sum(map(len, want.values()))


def test_unusable_vectors(spark):
    v = [1.0] * 64
    rows = [(1, v), (1, v), (2, v), (3, None), (4, [0.0] * 64), (5, [float("nan")] * 64), (6, [1.0] * 63), (7, [None] + [1.0] * 63), (8, [float("inf")] * 64), (None, v)]
    df = spark.createDataFrame(rows, "doc_id long, vector array<double>").withColumn("id", F.lit("x"))
    got = [(r["id"], r["neighbour"], r["place"]) for r in most_similar(df, "doc_id", "vector").collect()]
    assert sorted(got) == [(1, 2, 1), (2, 1, 1)]
    assert most_similar(df.limit(0), "doc_id", "vector").count() == 0


def test_hot_vector(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=64).tolist()
    rows = [(i, v) for i in range(2000)] + [(5000 + i, rng.normal(size=64).tolist()) for i in range(500)]
    got = most_similar(spark.createDataFrame(rows, "doc_id long, vector array<double>"), "doc_id", "vector")
    assert got.count() == 10_000 and got.filter("id > 5 AND id < 2000").agg(F.max("neighbour")).first()[0] == 4


pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_merges(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return t


TEXTS = ["", None, " ", "\n\n  x", "don't stop", "aaaaaaaaaaaaaaaa", "<|endoftext|>", "测试 テスト 😀👍🏽", "é" * 300, "a" * 5000, "x = [i**2]\t#!", "\x00\x1f\x85", "12345 １２３ ½"]


def test_encoding_equals_the_library(encoder, library):
    offsets, ids = encoder.encode(TEXTS)
    for i, t in enumerate(TEXTS):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_encoding_random_texts(encoder, library, texts):
    offsets, ids = encoder.encode(texts)
    for i, t in enumerate(texts):
        mine = ids[offsets[i] : offsets[i + 1]].tolist()
        assert mine == library.encode(t, add_special_tokens=False).ids
        assert library.decode(mine, skip_special_tokens=False) == t


def test_encoding_of_a_table(spark):
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df, "doc_id", "text").collect()}
    assert got[0] == [] and got[1] == [] and len(got) == len(TEXTS)
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df, ["doc_id", "ids"], "text").collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def sized(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Big-One", "big one ", "BIG_ONE"]), rng.randrange(50, 150)) for i in range(6000)]
    rows += [(10_000 + i, "small", rng.randrange(50, 150)) for i in range(100)] + [(20_000 + i, "tiny", 100) for i in range(3)]
    rows += [(30_000, None, 70), (30_001, "unasked", 70), (30_002, "small", 0), (30_003, "small", None), (None, "small", 10), (10_000, "small", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("copies", F.lit("x"))


TARGETS = [("big_one", 0.6, 1), ("Small", 0.3, 4), ("tiny", 0.05, 2), ("absent", 0.05, 3), ("bad", float("nan"), None)]


def test_mixture(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    m = Mixture(sized(spark), targets, "doc_id", "source", total_tokens=100_000)
    docs = m.documents().collect()
    assert len(docs) == len({r["key"] for r in docs})
    by = {r["source"]: r for r in m.shares().collect()}
    assert abs(by["big_one"]["tokens"] - 60_000) <= 75 and by["big_one"]["most_copies"] == 1
    small = [r["copies"] for r in docs if r["source"] == "small"]
    assert abs(by["small"]["tokens"] - 30_000) <= 75 and max(small) - min(small) <= 1 and max(small) <= 4 and len(small) == 100
    assert by["tiny"]["tokens"] == 600 and by["tiny"]["most_copies"] == 2 and by["tiny"]["lacking"] == pytest.approx(4400)
    assert by["absent"]["tokens"] == 0 and by["unasked"]["target_share"] == 0 and by[None]["tokens"] == 0
    again = {(r["key"], r["copies"]) for r in Mixture(sized(spark).repartition(5), targets, "doc_id", "source", total_tokens=100_000).documents().collect()}
    assert again == {(r["key"], r["copies"]) for r in docs}
    empty = Mixture(sized(spark).limit(0), targets, "doc_id", "source", total_tokens=100)
    assert empty.documents().count() == 0 and empty.shares().filter("tokens > 0").count() == 0


def test_weights_shift_the_sample(spark):
    t = spark.createDataFrame([("big_one", 1.0, 1)], "source string, target_share double, max_repeats int")
    d = sized(spark).withColumn("w", F.when(F.col("doc_id") < 3000, 4.0).otherwise(1.0))
    got = Mixture(d, t, "doc_id", "source", total_tokens=100_000, weight="w").documents()
    n = got.filter("key < 3000").count()
    assert 0.7 < n / got.count() < 0.9


def test_source_names(spark):
    df = spark.createDataFrame([(" Answer-Board ",), ("answer board",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(source_name("s")).collect()] == ["answer_board", "answer_board", None, None]


SENTENCES = {
    "en": "the {} is on the {} and nobody knows why this has happened again",
    "de": "der {} ist auf dem {} und niemand weiß warum das wieder passiert ist",
    "fr": "le {} est sur la {} et personne ne sait pourquoi cela est encore arrivé",
    "es": "el {} está en la {} y nadie sabe por qué esto ha pasado otra vez",
    "pt": "o {} está na {} e ninguém sabe porque é que isto aconteceu outra vez",
    "it": "il {} è sul {} e nessuno sa perché questo sia successo ancora una volta",
}


def _docs(n, seed=0):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bdkmrst") + rng.choice("aeiou") for _ in range(3)).title()
    for i in range(n):
        lang = rng.choice(list(SENTENCES))
        s = [SENTENCES[lang].format(name(), name()).capitalize() + "." for _ in range(rng.randrange(1, 4))]
        other = None
        if i % 7 == 0:
            other = rng.choice([x for x in SENTENCES if x != lang])
            s.insert(1, "«" + SENTENCES[other].format(name(), name()) + ".»")
        label = rng.choice(["sv", None, "", "de"]) if i % 5 == 0 else {"en": "en-GB", "de": "German", "pt": "pt_BR"}.get(lang, lang.upper())
        yield i, " ".join(s), label, lang, other


def test_languages_held_out(spark):
    rows = list(_docs(800))
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    model = langid.fit(df, "doc_id", "text", "lang")
    fresh = list(_docs(400, seed=9))
    test = spark.createDataFrame([r[:3] for r in fresh], "doc_id long, text string, lang string")
    declared = {r["doc_id"]: r["d"] for r in test.select("doc_id", langid.declared_language("lang").alias("d")).collect()}
    want = {(r[0], x) for r in fresh for x in (r[3], r[4]) if x and declared[r[0]] != x}
    got = {tuple(r) for r in langid.mislabelled(test, model, "doc_id", "text", "lang").collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_odd_texts_have_no_language(spark):
    model = langid.fit(spark.createDataFrame([r[:3] for r in _docs(300)], "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    rows = [(1, None), (2, ""), (3, " \n"), (4, "12 34 56 78 90 11"), (5, "测试 テスト 가나다 测试 テスト 가나다"), (6, "https://a.b/c?d=e zzzzzzzzzzzz"), (7, "the cat is here"), (8, "x" * 5000)]
    rows.append((9, " ".join(SENTENCES["en"].format("Bo", "Da") + "." for _ in range(3000))))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("confidence"))
    got = {r["doc_id"]: r for r in langid.document_languages(df, model, "doc_id", "text").collect()}
    assert [k for k, r in got.items() if r["lang"]] == [9] and got[9]["lang"] == "en" and got[9]["confidence"] > 0.8
    seg = langid.segment_languages(df, model, "doc_id", "text").filter("doc_id = 9").collect()
    assert len(seg) == 1 and seg[0]["end"] == len(rows[-1][1])
    nothing = langid.fit(df, "doc_id", "text", "lang")
    assert langid.mislabelled(df, nothing, "doc_id", "text", "lang").count() == 0
    assert langid.document_languages(df.limit(0), model, "doc_id", "text").count() == 0


def test_segments_cover_mixed_texts(spark):
    model = langid.fit(spark.createDataFrame([r[:3] for r in _docs(300)], "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    text = SENTENCES["en"].format("Bo", "Da") + ". " + SENTENCES["de"].format("Bo", "Da") + ". (so ist es) " + SENTENCES["de"].format("Ti", "Ra") + "."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = langid.segment_languages(df, model, "doc_id", "text").orderBy("segment").collect()
    assert [r["lang"] for r in got] == ["en", "de"] and got[0]["start"] == 0 and got[-1]["end"] == len(text)
