import pytest
from pyspark.sql import functions as F

from millrace.engine import PROFILES, Engine


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame([("1", "best way to fix a kettle"), ("2", "how do I fix a roof"), ("3", "kettle descaling guide"), ("4", None)], "doc_id string, text string")
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0]), ("3", [0.9, 0.1])], "doc_id string, vector array<double>")
    return Engine(PROFILES["quora"], docs, vectors, encode=lambda q: q.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0))))


@pytest.fixture(scope="module")
def question(spark):
    return spark.createDataFrame([("q", "c", "kettle guide")], "query_id string, conversation_id string, text string")


def test_methods(engine, question):
    assert [r["doc_id"] for r in engine.search(question, "tfidf").orderBy("rank").collect()][0] == "3"
    assert [r["doc_id"] for r in engine.search(question, "embedding", 2).orderBy("rank").collect()] == ["1", "3"]
    h = engine.search(question, "auto", 2, texts=True).orderBy("rank").collect()
    assert [r["doc_id"] for r in h] == ["1", "3"] and h[1]["text"] == "kettle descaling guide"
    with pytest.raises(ValueError):
        engine.search(question, "bm25")


def test_indexes(engine, question):
    engine.add_index("cells", cells=2, probes=2)
    assert engine.info()["active_index"] == "cells"
    assert [r["doc_id"] for r in engine.search(question, "embedding", 1).collect()] == ["1"]
    engine.set_index(None)
    with pytest.raises(KeyError):
        engine.set_index("none")
    assert engine.validate().first()["ok"]


def test_chat(spark, engine, question):
    m = spark.createDataFrame([("c", 1, "user", "hello")], "conversation_id string, turn int, role string, text string")
    r = engine.chat(question, m).first()
    assert "User: hello" in r["prompt"] and r["answer"].startswith("Based on similar questions")
    r = engine.chat(question, m, generate=lambda p: p.select("query_id", F.lit("Assistant: Fine. It works well now.").alias("answer"))).first()
    assert r["answer"] == "Fine. It works well now."
