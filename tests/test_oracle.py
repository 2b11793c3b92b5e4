"""Every registered query equals its DuckDB SQL twin (sf0.001)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, rows

from .conftest import SMOKE
from .test_plans import plan_text

# Two more outputs of the stream that stream_alerts runs: see test_streaming.py and tools/oracle_check.py.
KEYS = sorted(set(E.catalog.QUERIES) - {"stream_outbox", "stream_gauges"})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(E.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test data not present")
@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SMOKE)
    plan = plan_text(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = df.toPandas()
    exp = duck.execute(E.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert rows(got) == rows(exp)
