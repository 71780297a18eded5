"""Every query of the core against its SQL on the smallest tables; those without SQL run and give their columns."""

import pytest

from millrace.plans import registry
from tests.oracle import compare

D = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, D)
    if name in SQL:
        compare(df, SQL[name], D)
    else:
        assert df.count() >= 0 and df.columns


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
