import datetime as dt
import json

from pyspark.sql import functions as F

from millrace.operators import rag
from millrace.operators import tfidf as tf
from millrace.sources import readers, sinks
from millrace.streaming import batches


def docs_of(rows):
    return {r["id"]: (r["text"], r["metadata"]) for r in readers.normalise(rows).collect()}


def test_json_shapes(spark, tmp_path):
    # an id of 0 counts as empty: the position stands in
    (tmp_path / "l.json").write_text(json.dumps([{"id": "9", "text": " a "}, {"id": 0, "body": "b", "tag": "t"}, {"id": "3", "text": "  "}, {"note": "no text"}]))
    assert docs_of(readers.read_any(spark, str(tmp_path / "l.json"))) == {"9": ("a", {}), "1": ("b", {"id": "0", "tag": "t"})}
    (tmp_path / "k.json").write_text(json.dumps({"x": {"content": "hello", "lang": "en"}, "y": {"content": ""}}))
    assert docs_of(readers.read_json(spark, str(tmp_path / "k.json"))) == {"x": ("hello", {"lang": "en"})}


def test_json_lines_skip_the_malformed(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"doc_id": "a", "passage": "one"}\n\n{broken\n{"doc_id": "b", "answer": "two", "z": "9"}\n')
    rows = readers.read_any(spark, str(tmp_path / "d.jsonl"))
    assert docs_of(rows) == {"a": ("one", {}), "b": ("two", {"z": "9"})}
    assert readers.read_jsonl(spark, str(tmp_path / "d.jsonl"), 1).count() == 1


def test_delimited(spark, tmp_path):
    (tmp_path / "d.tsv").write_text('pid\ttext\n7\tsay "hi"\n8\t\n')
    assert docs_of(readers.read_any(spark, str(tmp_path / "d.tsv"))) == {"7": ('say "hi"', {})}
    (tmp_path / "d.csv").write_text('id,text\n7,"a, b"\n')
    assert docs_of(readers.read_any(spark, str(tmp_path / "d.csv"))) == {"7": ("a, b", {})}
    assert readers.probe(str(tmp_path), ("x.tsv", "d.tsv")).endswith("d.tsv") and readers.probe(str(tmp_path), ("x",)) is None


def test_collection_and_judgments(spark, tmp_path):
    (tmp_path / "docs.tsv").write_text("doc_id\ttext\n1\ta\n2\tb\n")
    (tmp_path / "queries.tsv").write_text("query_id\ttext\nq\tx\n")
    (tmp_path / "qrels.tsv").write_text("query_id\tdoc_id\trelevance\nq\t1\t2\nq\t2\t0\nq\t3\tbad\n")
    d, q, r = readers.collection(spark, str(tmp_path), docs_limit=1)
    assert (d.count(), q.count(), r.count()) == (1, 1, 2)
    assert readers.read_judgments(spark, str(tmp_path / "qrels.tsv"), positive=True).count() == 1
    assert readers.registry(spark).count() == 4


def test_positions_follow_an_order(spark):
    df = spark.createDataFrame([(f"{i:03}",) for i in range(100, 0, -1)], "k string")
    got = sorted((r["position"], r["k"]) for r in readers.positions(df, "k").collect())
    assert got == [(i, f"{i + 1:03}") for i in range(100)]


def test_upsert_and_refresh(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 2, 5), ("b", 3, 6), ("c", None, 7)], old.schema)
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"], "seq").collect()) == [("a", 1, 1), ("b", 3, 6), ("c", None, 7)]
    sinks.refresh(str(tmp_path / "t"), new, ["k"], "seq")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert sinks.upsert(old, new.limit(0), ["k"], "seq").count() == 2
    assert sinks.append(old, new).count() == 5
    vals = spark.createDataFrame([("a", "x")], "k string, c string")
    assert {r["k"]: r["c"] for r in sinks.set_column(old, "k", "c", vals).collect()} == {"a": "x", "b": None}


def test_saving_and_loading(spark, tmp_path):
    docs = spark.createDataFrame([("1", ["a", "b"]), ("2", ["b"])], "doc_id string, toks array<string>")
    m = tf.fit(docs, "toks", tf.Config())
    sinks.save_index(tf.weights(docs, "toks", m), m.vocabulary, str(tmp_path / "m"))
    v, w = readers_load(spark, tmp_path)
    assert v.count() == m.n_terms and w.count() == 4
    t = spark.createDataFrame([("1", "a\tb\nc")], "doc_id string, text string")
    sinks.export_tsv(t, str(tmp_path / "x"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "x")).first()["text"] == "a b c"
    meta = sinks.save_dataset(t, t, t, str(tmp_path / "s"), "n")
    assert meta["documents"] == 1 and spark.read.json(str(tmp_path / "s/docs")).count() == 1


def readers_load(spark, tmp_path):
    return sinks.load_index(spark, str(tmp_path / "m"))


def test_history_and_prompt(spark):
    m = spark.createDataFrame([("c", i, "uSER", f"m{i}") for i in range(30)] + [("d", 0, None, None)], "conversation_id string, turn int, role string, text string")
    assert rag.last_messages(m, 20).count() == 21
    q = spark.createDataFrame([("q", "c", "why?"), ("p", None, None)], "query_id string, conversation_id string, text string")
    c = spark.createDataFrame([("q", 1, "x" * 400, 0.9), ("q", 2, None, 0.1)], "query_id string, rank int, document string, similarity_score double")
    got = {r["query_id"]: r["prompt"] for r in rag.prompts(q, m, c).collect()}
    assert got["q"] == "Previous conversation:\n" + "\n".join(f"User: m{i}" for i in range(24, 30)) + "\n\nRelevant information from Quora:\n1. " + "x" * 300 + "\n2. \n\nUser question: why?\nAssistant:"
    assert got["p"] == "Relevant information from Quora:\n\nUser question: \nAssistant:"
    a = {r["query_id"]: r["answer"] for r in rag.template_answers(q, c).collect()}
    assert a["q"].startswith("Based on similar questions") and a["q"].endswith("1 other related questions that might be helpful.")
    assert a["p"].startswith("I couldn't find")


def test_answer_cleaning(spark):
    cases = {"Assistant: One. Two is long enough. x": "One. Two is long enough.", "no dot": "no dot", "User: A. this tail is long": "A. this tail is long", "": "", "a.": "a."}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in df.select("t", "want", rag.cleaned_answer(F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_conversation_life(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    m = spark.createDataFrame([("a", t(1)), ("b", t(5))], "conversation_id string, ts timestamp")
    now = F.lit("2024-01-01 05:30:00").cast("timestamp")
    assert rag.live_conversations(m, now).count() == 2
    assert [r["conversation_id"] for r in rag.live_conversations(m, now, most=2).collect()] == ["b"]
    assert rag.without_conversations(m, m.filter("conversation_id = 'a'")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    s = batches.document_stream(spark, str(tmp_path / "in"), e._jdf.schema().toDDL())
    batches.run_once(s, lambda df, _: got.append(df.count()), str(tmp_path / "cp"))
    assert sum(got) == e.count() and len(got) == 3
    q = batches.counts_by_window(s).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, batches.counts_by_window(e).collect()))
    assert sorted(map(tuple, spark.sql("select cast(start as timestamp_ntz) as start, event_type, n_events from w").collect())) == want


def test_load_all_and_decoding(spark, tmp_path):
    (tmp_path / "docs.tsv").write_text("doc_id\ttext\n1\told\n2\tb\n1\tnew\n")
    (tmp_path / "queries.tsv").write_text("query_id\ttext\nq\tx\n")
    (tmp_path / "qrels.tsv").write_text("query_id\tdoc_id\trelevance\nq\t1\t0\nq\t1\t2\n")
    assert sinks.load_all(spark, str(tmp_path), str(tmp_path / "out")) == {"docs": 2, "queries": 1, "qrels": 1}
    assert spark.read.parquet(str(tmp_path / "out/docs")).filter("doc_id = '1'").first()["text"] == "new"
    assert spark.read.parquet(str(tmp_path / "out/qrels")).first()["relevance"] == 2
    df = spark.createDataFrame([('["a"]',), ("{",), (None,)], "tokens string")
    assert [r["tokens"] for r in readers.decoded(df, {"tokens": "array<string>"}).collect()] == [["a"], None, None]


def test_lifted_scores_and_currency(spark):
    from millrace.operators import catalog, fuse

    arm = spark.createDataFrame([("q", "a", 0.0), ("q", "b", 0.0), ("p", "a", 0.0), ("p", "b", 0.5)], "query_id string, doc_id string, score double")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in fuse.lifted(arm).collect()}
    assert got == {("q", "a"): 0.001, ("q", "b"): 0.001, ("p", "a"): 0.0, ("p", "b"): 0.5}
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert catalog.is_current(arm, docs) and not catalog.is_current(arm.filter("doc_id = 'a'"), docs)
