import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import components
from millrace.llm.components import connected_components, label_by_least
from millrace.llm.topn import top_n_per_group


def union_find(edges):
    up = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up.setdefault(a, a)
        up.setdefault(b, b)
        up[root(a)] = root(b)
    groups = {}
    for x in up:
        groups.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def groups_of(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {}
    for r in connected_components(df, "a", "b").collect():
        got.setdefault(r["root"], []).append(r["record"])
    for g in got.values():
        assert len(g) == len(set(g))
    return {frozenset(g) for g in got.values()}


def shapes():
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(70)]
    cycle = [(100 + i, 100 + (i + 1) % 12) for i in range(12)]
    star = [(200, 201 + i) for i in range(50)]
    clique = [(300 + i, 300 + j) for i in range(7) for j in range(i)]
    dense = [(400 + rng.randrange(60), 400 + rng.randrange(60)) for _ in range(90)]
    bridge = [(300, 500), (500, 501), (501, 502), (502, 400)]
    theta = [(600, 601), (601, 602), (602, 603), (600, 604), (604, 603), (600, 605), (605, 606), (606, 603)]
    loop = [(700, 701), (701, 702), (702, 703), (703, 701), (800, 800), (701, 701)]
    lasso = [(900, 901), (901, 902), (902, 900), (900, 903), (903, 904)]
    return {"path": path, "cycle": cycle, "star": star, "clique": clique, "all": path + cycle + star + clique + dense + bridge + theta + loop + lasso}


@pytest.mark.parametrize("core", [0, 1_000_000])
@pytest.mark.parametrize("name", ["path", "cycle", "star", "all"])
def test_components(spark, monkeypatch, name, core):
    monkeypatch.setattr(components, "CORE_ARCS", core)
    edges = shapes()[name]
    again = edges + [(b, a) for a, b in edges[::3]] + edges[::4]
    assert groups_of(spark, again) == union_find(edges)


def test_components_of_odd_edges(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("c", "c"), ("d", "e")], "a string, b string").withColumn("record", F.lit(1))
    got = {r["record"]: r["root"] for r in connected_components(df, "a", "b").collect()}
    assert got["c"] == "c" and got["d"] == got["e"] and set(got) == {"c", "d", "e"}
    assert connected_components(df.limit(0), "a", "b").count() == 0
    assert connected_components(df.filter("a = 'c'"), "a", "b").count() == 1


def test_least_label(spark):
    m = spark.createDataFrame([("x", "r", 5), ("y", "r", None), ("z", "s", None)], "record string, root string, value int")
    assert {r["record"]: r["label"] for r in label_by_least(m, "value").collect()} == {"x": 5, "y": 5, "z": None}


def brute(rows, n):
    best = {}
    for g, it, s, r in rows:
        if g is None or it is None:
            continue
        key = (-s, r if r is not None else 10**9, it)
        if (g, it) not in best or key < best[g, it]:
            best[g, it] = key
    out = {}
    for (g, it), key in best.items():
        out.setdefault(g, []).append((key, it))
    return {(g, it) for g, v in out.items() for _, it in sorted(v)[:n]}


@pytest.mark.parametrize("n,parts", [(1, 1), (3, 7), (10, 3)])
def test_top_n(spark, n, parts):
    rng = random.Random(n)
    rows = [(rng.choice(["hot"] * 5 + [f"g{i}" for i in range(40)] + [None]), rng.choice([*range(60), None]), rng.randrange(5) / 4, rng.choice([1, 2, None])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, item int, score double, rank int").withColumn("extra", F.lit("g")).repartition(parts)
    got = top_n_per_group(df, "g", "item", [("score", "desc"), ("rank", "asc")], n).collect()
    assert len(got) == len({(r["g"], r["item"]) for r in got})
    assert {(r["g"], r["item"]) for r in got} == brute(rows, n)


def test_top_n_within_and_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("a", i % 9, 1.0, None) for i in range(100)] + [("b", i, float(i), 1) for i in range(30)]
        df = spark.createDataFrame(rows, "g string, item int, score double, rank int")
        got = top_n_per_group(df, "g", "item", [("score", "desc"), ("rank", "asc")], 5)
        assert {(r["g"], r["item"]) for r in got.collect()} == brute(rows, 5)
        only = spark.createDataFrame([("b",), ("b",), (None,)], "g string")
        assert {r["g"] for r in top_n_per_group(df, "g", "item", [("score", "desc")], 5, within=only).collect()} == {"b"}
        assert top_n_per_group(df.limit(0), "g", "item", [("score", "desc")], 5).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    with pytest.raises(ValueError):
        top_n_per_group(df, "g", "item", [("score", "desc")], 0)
