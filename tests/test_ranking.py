import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluate as ev
from millrace.operators import fuse, retrieve, vectors
from millrace.operators import tfidf as tf
from millrace.operators.ranking import top_k
from millrace.plans import vectors as plan_vectors


def run_of(spark, docs, q="q"):
    return spark.createDataFrame([(q, i + 1, x) for i, x in enumerate(docs)], "query_id string, rank int, doc_id string")


def judged_of(spark, docs, q="q", relevance=1):
    return spark.createDataFrame([(q, x, relevance) for x in docs], "query_id string, doc_id string, relevance int")


@pytest.mark.parametrize("found,good,ap", [(["d1", "d2", "d3", "d4", "d5"], ["d1", "d3", "d5"], (1 + 2 / 3 + 3 / 5) / 3), (["d1", "d2", "d4"], ["d3", "d5"], 0.0), ([], ["d1", "d2"], 0.0)])
def test_average_precision(spark, found, good, ap):
    r = ev.per_query(run_of(spark, found), judged_of(spark, good)).first()
    assert r["ap"] == pytest.approx(ap)
    assert r["num_retrieved"] == len(found)


def test_variants(spark):
    judged = judged_of(spark, ["a", "b"]).unionByName(judged_of(spark, ["z"], relevance=0))
    r = ev.per_query(run_of(spark, ["z", "a", "x"]), judged, cuts=(5,)).first()
    assert (r["ap"], r["ap_b"], r["rr"]) == (0.25, 0.5, 0.5)
    assert (r["p_at_5"], r["p_b_at_5"], r["p_c_at_5"], r["recall_at_5"]) == (0.2, pytest.approx(1 / 3), None, 0.5)
    assert r["ndcg_at_5"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert ev.average_precision_c(run_of(spark, ["z", "a", "x"]), judged).first()["ap"] == pytest.approx((1 + 1) / 3)
    assert {r["cut"] for r in ev.precision_where_relevant(run_of(spark, list("abcde")), judged_of(spark, ["e"])).collect()} == {5}


def test_queries_without_results_or_judgments(spark):
    judged = judged_of(spark, ["a"]).unionByName(judged_of(spark, ["a"], "other"))
    s = ev.mean_average_precision(run_of(spark, ["a"]).unionByName(run_of(spark, ["a"], "unjudged")), judged).first()
    assert (s["n_queries"], s["map"], s["map_answered"]) == (2, 0.5, 1.0)
    empty = judged.limit(0)
    assert ev.summary(ev.per_query(run_of(spark, ["a"]), empty)).first()["n_queries"] == 0


def test_fusion_of_one_arm_and_of_missing_ranks(spark):
    arm = "query_id string, rank int, doc_id string, score double"
    lexical = spark.createDataFrame([("q", 1, "a", 0.9), ("q", 2, "b", 0.5), ("l", 1, "a", 0.005), ("l", 2, "b", 0.02)], arm)
    vector = spark.createDataFrame([("q", 1, "b", 0.8), ("v", 1, "c", 0.05), ("v", 2, "d", 0.4)], arm)
    got = {(r["query_id"], r["doc_id"]): r for r in fuse.hybrid(lexical, vector, fuse.WEIGHTS["quora"], 10).collect()}
    assert got["q", "b"]["hybrid_score"] == pytest.approx(1.3 * (0.75 / 61 + 0.25 / 62))
    assert got["q", "a"]["hybrid_score"] == pytest.approx(0.75 / 62 + 0.25 / 61)
    assert ("l", "a") not in got and got["l", "b"]["rank"] == 2
    assert ("v", "c") not in got and got["v", "d"]["rank"] == 2
    q = spark.createDataFrame([("q",), ("none",)], "query_id string")
    assert [r["query_id"] for r in fuse.answered(q, fuse.hybrid(lexical, vector, fuse.WEIGHTS["quora"], 10)).collect()] == ["none"]


def test_alignment_falls_back_to_vectors(spark):
    a, v = spark.createDataFrame([("1",), ("2",)], "doc_id string"), spark.createDataFrame([("2",), ("3",)], "doc_id string")
    assert [r["doc_id"] for r in fuse.aligned(a, v).collect()] == ["2"]
    assert sorted(r["doc_id"] for r in fuse.aligned(a.limit(0), v).collect()) == ["2", "3"]


def test_min_max_of_equal_scores(spark):
    s = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 2.0)], "query_id string, doc_id string, score double")
    assert {r["normalised"] for r in fuse.min_max(s).collect()} == {0.0}


def test_ties_and_nulls_in_ranks(spark):
    s = spark.createDataFrame([("q", "b", 0.3), ("q", "a", 0.1 + 0.2), ("q", "c", None)], "query_id string, doc_id string, score double")
    assert [r["doc_id"] for r in top_k(s, None).orderBy("rank").collect()] == ["a", "b", "c"]


def test_vocabulary_pruning_and_unknown_queries(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, []), (4, None)], "doc_id int, toks array<string>")
    model = tf.fit(docs, "toks", tf.Config(None, 1, 0.4, 1, 1))
    assert model.n_docs == 4 and {r["term"] for r in model.vocabulary.collect()} == {"b", "c"}
    w = tf.weights(docs, "toks", model)
    q = spark.createDataFrame([(7, ["zzz"]), (8, ["b", "b"])], "query_id int, toks array<string>")
    got = retrieve.cosine_search(q, "toks", w, model, 5).collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in got] == [(8, 1, 1)] and got[0]["score"] == pytest.approx(1.0)
    assert tf.fit(docs.limit(0), "toks", tf.Config()).n_terms == 0


def test_bag_search_counts_repeats(spark):
    docs = spark.createDataFrame([(1, ["a"])], "doc_id int, toks array<string>")
    c = tf.Config(None, 1, 1.0, 1, 1)
    w = tf.weights(docs, "toks", tf.fit(docs, "toks", c))
    q = spark.createDataFrame([(7, ["a", "a"])], "query_id int, toks array<string>")
    assert retrieve.index_search(q, "toks", w, c).first()["score"] == pytest.approx(2.0)


def test_related_terms_from_a_table(spark):
    q = spark.createDataFrame([(1, ["car"]), (2, ["x"])], "query_id int, toks array<string>")
    rel = spark.createDataFrame([("car", "auto"), ("car", "automobile"), ("car", "ca"), ("car", "motor_car"), ("car", "machine"), ("car", "wagon")], "word string, lemma string")
    got = {r["query_id"]: r["toks"] for r in retrieve.expand_from_table(q, "toks", rel, 2).collect()}
    assert got == {1: ["car", "auto", "wagon"], 2: ["x"]}


def test_vector_search_odd_vectors(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [-1.0, 0.0])], "doc_id int, vector array<double>")
    q = spark.createDataFrame([(9, [3.0, 0.0]), (10, [0.0, 0.0])], "query_id int, vector array<double>")
    got = [(r["query_id"], r["doc_id"]) for r in vectors.flat_search(q, c, 5, positive=True).orderBy("rank").collect()]
    assert got == [(9, 1), (9, 4)]
    assert vectors.flat_search(q, c.limit(0), 5).count() == 0
    assert vectors.flat_search(q.limit(0), c, 5).count() == 0
    d = vectors.flat_search(q.filter("query_id = 9"), c, 1, metric="l2").first()
    assert d["doc_id"] == 4 and d["score"] == pytest.approx(-1.0)


def test_similarity_stats(spark):
    s = spark.createDataFrame([(1.0,), (3.0,)], "score double")
    r = retrieve.similarity_stats(s).first()
    assert (r["mean"], r["std"], r["max"], r["min"]) == (2.0, 1.0, 3.0, 1.0)


def test_fallback_order(spark):
    a = spark.createDataFrame([("x", 1, "d1", 0.5)], "query_id string, rank int, doc_id string, score double")
    b = spark.createDataFrame([("x", 1, "d2", 0.9), ("y", 1, "d2", 0.9)], a.schema)
    got = {(r["query_id"], r["doc_id"], r["strategy"]) for r in retrieve.first_that_answers([a, b]).collect()}
    assert got == {("x", "d1", 0), ("y", "d2", 1)}
    assert retrieve.capped(80) == 50 and F.lit(1) is not None


def test_similarity_stats_cover_every_score(spark, monkeypatch):
    seen = []
    search = vectors.flat_search
    monkeypatch.setattr(vectors, "flat_search", lambda q, c, k, *a: seen.append(k) or search(q, c, k, *a))
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id")
    assert plan_vectors.vector_similarity_stats(spark, d).first()["n"] == n.filter("vec_id % 100 = 0").count() * n.count()
    assert seen == [None]  # no cut, however many rows


def feedback_corpus(n_docs, n_queries):
    rng = random.Random(2)
    pick = lambda n: [f"w{int(60 * rng.random() ** 2)}" for _ in range(n)]
    docs = [(i, pick(rng.randrange(12))) for i in range(n_docs)]
    return docs + [(n_docs, None), (n_docs + 1, docs[1][1])], [(f"q{i}", pick(rng.randrange(4))) for i in range(n_queries)]


def feedback_by_hand(docs, queries, k, share=0.7):
    """R17 in plain Python: {(query, rank): (doc, score)}."""
    docs = {d: Counter(t or []) for d, t in docs}
    df = Counter(x for t in docs.values() for x in t)
    idf = {x: math.log((1 + len(docs)) / (1 + n)) + 1 for x, n in df.items()}

    def unit(t):
        w = {x: n * idf[x] for x, n in t.items() if x in idf}
        return {x: v / math.sqrt(sum(y * y for y in w.values())) for x, v in w.items()}

    weights = {d: unit(t) for d, t in docs.items()}

    def ranked(q, k):
        s = {d: sum(v * w[x] for x, v in q.items() if x in w) for d, w in weights.items() if q.keys() & w.keys()}
        return sorted(s.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]

    out = {}
    for name, t in queries:
        longer = Counter(t)
        for d, _ in ranked(unit(Counter(t)), 5):
            longer += docs[d]
        first, second = unit(Counter(t)), unit(longer)
        for i, r in enumerate(ranked({x: share * first.get(x, 0) + (1 - share) * v for x, v in second.items()}, k)):
            out[name, i + 1] = r
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_feedback_has_no_row_for_each_query_and_document(spark, monkeypatch, broadcast):
    rows, asked = feedback_corpus(3000, 1500)
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3).cache()
    queries = spark.createDataFrame(asked, "query_id string, tokens array<string>")
    config = tf.Config(None, 1, 1.0, 1, 1, False)
    model = tf.fit(docs, "tokens", config)
    index = tf.weights(docs, "tokens", model)
    if not broadcast:  # the documents' weights then come from the index
        monkeypatch.setattr(tf, "BROADCAST_TERMS", 10)
    got = retrieve.feedback_search(queries, docs, "tokens", index, model, 10)
    joins = got._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins == (0 if broadcast else 1)  # that of the index with the vocabulary
    want = feedback_by_hand(rows, asked, 10)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got.collect()}
    assert got.keys() == want.keys()
    for key, (doc, score) in want.items():
        assert got[key][0] == doc and got[key][1] == pytest.approx(score, abs=1e-9), key
