"""Every registered query with an oracle: Spark result equals DuckDB result
(row count, column names, order-insensitive values) on the sf0.001 tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_check import compare, duck

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
SLOW: set = set()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SLOW))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert compare(rows, df.columns, drows, dcols) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"slm", "tts_model", "txt_cond", "accuracy", "accuracy_proxy"} <= set(df.columns)
