import datetime as dt

import pytest

from millrace.operators.references import orphan_references, orphan_report


def rows(spark):
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 2), (4, None, None), (5, "z", 1), (6, "a", 9), (6, "a", 9)], "id int, k string, n int")
    parents = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None)], "k string, n int, id string")
    return refs, parents


@pytest.mark.parametrize("match,want", [("simple", [5, 6, 6]), ("partial", [5, 6, 6]), ("full", [2, 3, 5, 6, 6])])
def test_match_rules(spark, match, want):
    refs, parents = rows(spark)
    got = orphan_references(refs, parents, [("k", "k"), ("n", "n")], match)
    assert sorted(r["id"] for r in got.collect()) == want
    assert got.columns == [*refs.columns, "null_mask"]


def test_partial_needs_the_rest_to_match(spark):
    refs, parents = rows(spark)
    more = refs.unionByName(spark.createDataFrame([(7, "q", None), (8, None, 77)], refs.schema))
    got = {(r["id"], r["null_mask"]) for r in orphan_references(more, parents, [("k", "k"), ("n", "n")], "partial").collect()}
    assert {(7, 2), (8, 1)} <= got


def test_times(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    parents = spark.createDataFrame([(1, t(5), None), (2, t(1), t(10)), (3, None, None)], "id long, since timestamp, gone timestamp")
    refs = spark.createDataFrame([(10, 1, t(4)), (11, 1, t(5)), (12, 2, t(9)), (13, 2, t(10)), (14, 3, t(1)), (15, 4, t(1)), (16, 2, None)], "id long, ref long, at timestamp")
    got = orphan_references(refs, parents, [("ref", "id")], ref_time="at", valid_from="since", valid_to="gone")
    assert sorted(r["id"] for r in got.collect()) == [10, 13, 15]
    report = orphan_report(got.withColumn("tbl", got["ref"].cast("string")), "tbl", "at").collect()
    assert sum(r["n_orphans"] for r in report) == 3


def test_empty_tables(spark):
    refs, parents = rows(spark)
    assert orphan_references(refs.limit(0), parents, [("k", "k")]).count() == 0
    assert orphan_references(refs, parents.limit(0), [("k", "k")]).count() == 5
    assert orphan_references(refs.filter("k IS NULL"), parents, [("k", "k")]).count() == 0
    with pytest.raises(ValueError):
        orphan_references(refs, parents, [("k", "k")], "some")
