import pytest

from millrace.llm import queries as q
from tests.oracle import compare

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, name):
    df = q.QUERIES[name](spark, D)
    if name in q.SQL:
        compare(df, q.SQL[name], D)
    else:
        assert df.count() >= 0
