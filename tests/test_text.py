import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import cleaning as cl
from millrace.functions import tokens as tk
from millrace.functions import wordlists as wl
from millrace.functions.keys import blank, whole_number
from millrace.functions.porter import stem

ODD = [
    "What's the BEST way to clean a state-of-the-art oven in 1999? I don't know!!! See https://a.b/c?d=e or mail me@x.org...",
    "<b>Héllo</b> wörld　it's 3.5 times, the 2nd of 12 items??",
    "", "   ", None, "é" * 50, "a b c i 123456 12", "İstanbul ٣٤٥ １２３", "no\x1fbreak\x85here", "not no never good bad",
]


def by_re(text, rules):
    """The same rules by Python's own engine."""
    t = text or ""
    for kind, *a in rules:
        if kind == "lower":
            t = t.lower()
        elif kind == "plain":
            t = t.replace(*a)
        elif kind == "regex":
            t = re.sub(a[0], a[1].replace("$", "\\"), t)
        elif kind == "strip":
            t = t.strip()
        elif kind == "tokens":
            t = " ".join(w for w in t.split() if w not in wl.STOP_ADVANCED)
    return t


@pytest.mark.parametrize("name", [n for n in cl.CLEANERS if n != "enhanced"])
def test_cleaner_matches_python(spark, name):
    rules = cl.CLEANERS[name]()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", cl.clean("t", rules).alias("c")).collect()}
    for i, t in enumerate(ODD):
        assert got[i] == by_re(t, rules), (name, t)


def test_hyphens_are_not_idempotent(spark):
    once = spark.range(1).select(cl.clean(F.lit("state-of-the-art"), cl.question()).alias("c")).first()["c"]
    assert once == "state of stateof-the art theart"


def test_stemmer_published_examples():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat",
             "vietnamization": "vietnam", "electrical": "electr", "adoption": "adopt", "controll": "control", "rate": "rate", "roll": "roll", "by": "by"}
    assert {k: stem(k) for k in pairs} == pairs


def test_stem_tokens_keeps_order_and_empty(spark):
    df = spark.createDataFrame([(1, ["ponies", "x", "ponies"]), (2, []), (3, None)], "k int, t array<string>")
    got = {r["k"]: r["t"] for r in tk.stem_tokens(df, "k", "t").collect()}
    assert got == {1: ["poni", "x", "poni"], 2: [], 3: []}


def test_negations(spark):
    t = F.array(*[F.lit(x) for x in "not good never no bad not end".split()])
    assert spark.range(1).select(cl.mark_negations(t).alias("t")).first()["t"] == ["not", "NOT_good", "never", "no", "NOT_bad", "not", "end"]


def test_ngrams_of_short_lists(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "c"],)], "t array<string>")
    got = [r["g"] for r in df.select(tk.ngrams(F.col("t"), 1, 3).alias("g")).collect()]
    assert got == [[], ["a"], ["a", "b", "c", "a b", "b c", "a b c"]]


def test_whole_numbers(spark):
    cases = {" 0501": 501, "501.0": 501, "\t501\r": 501, "+501": 501, "501.5": None, "": None, " ": None, "x1": None, None: None, "9" * 30: None, "　 7 ": 7, "5e2": 500}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "k string, v long")
    for r in df.select("k", "v", whole_number("k").alias("n"), blank("k").alias("b")).collect():
        assert r["n"] == r["v"], r
        assert r["b"] == ((r["k"] or "").strip() == "")


def test_composed_tokenizers(spark):
    """Expected by hand from the rules: stop lists, Porter's stems, then synonyms of the stems."""
    df = spark.createDataFrame([(1, "The doctors weren't treating 25 swollen knees!"), (2, None), (3, "")], "i int, t string")
    for name in tk.COMPOSED:
        got = {r["i"]: r["tokens"] for r in tk.composed(df, "t", name).collect()}
        assert got[2] == [] and got[3] == []
        base, synonyms = tk.COMPOSED[name]
        words = df.filter("i = 1").select(base("t").alias("w")).first()["w"]
        assert got[1] == [synonyms.get(stem(w), stem(w)) for w in words]
        assert "treat" in got[1] or "treat" in synonyms
    assert tk.composed(df.limit(0), "t", "serving").count() == 0


def test_limits_count_documents(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "1", "text": " "}\n\nbroken\n{"id": "2", "text": "a"}\n{"id": "3"}\n{"id": "4", "text": "b"}\n{"id": "5", "text": "c"}\n')
    from millrace.sources import readers

    assert [r["id"] for r in readers.normalise(readers.read_jsonl(spark, str(p), 2)).collect()] == ["2", "4"]
