import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import both  # noqa: E402
from conftest import SF  # noqa: E402

from askmill.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got, want = both(spark, SF, QUERIES[name], SQL[name])
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    # no column is all NULL, and running it again gives the same rows
    assert all(any(r[c] is not None for r in rows) for c in df.columns)
    assert sorted(map(str, rows)) == sorted(map(str, QUERIES[name](spark, SF).collect()))
