"""Driver contract smoke checks."""

import __spark_entry__ as E


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert E.entry(spark).schema == df.schema
    assert {"ts", "severity", "total_score", "triggers"} <= set(df.columns)


def test_registry_and_oracle_keys():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 50 and set(o) <= set(q)
