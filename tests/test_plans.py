"""Physical-plan guards: bounds and column pruning reach the parquet scan, and
windows over series are split.  (That no registered query has a cartesian product
or nested-loop join is checked where each is run, in test_oracle.py.)"""

import os
import re

import pytest

import __spark_entry__ as E
from pulsewatch.sources import adapters as A

from .conftest import SMOKE


def plan_text(df) -> str:
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted")


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test data not present")
def test_trailing_window_reaches_the_scan(spark):
    """The bound of a trailing window is a filter of the scan, on the columns used."""
    text = plan_text(A.recent_transactions(spark, SMOKE, 24, "HOUR"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", text)
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", text)) == {"struct<ts:timestamp_ntz,event_type:string>"}
    assert text.count("Scan parquet") == 2  # one scan, named in the tree and in its details


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test data not present")
@pytest.mark.parametrize("key", ["rolling_volume", "rolling_error", "rolling_bands", "rolling_daily", "rolling_keyed",
                                 "rolling_keyed_supplier", "outage_periods", "anomaly_timeline", "rule_book"])
def test_series_windows_are_split(spark, key):
    """Windows over a series are partitioned by its chunks; those without such a
    partition run over the table of chunks (one row each)."""
    text = plan_text(E.queries()[key](spark, SMOKE))
    windows = re.findall(r"Arguments: \[[^\n]*windowspecdefinition\(([^\n]*)", text)
    assert windows or key in ("anomaly_timeline", "rule_book")  # written before they are read again
    for w in windows:
        assert "_chunk" in w or "_home" in w, w


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test data not present")
def test_trailing_windows_read_the_days_of_a_fact_table(spark, tmp_path):
    """Operators over a table that append_transactions wrote bound its days and stamps."""
    from pulsewatch.operators import policy, series, windows
    from pulsewatch.sources import files

    path = str(tmp_path / "tx")
    assert files.append_transactions(A.shop_transactions(spark, SMOKE), path, keys=["shop"]) > 0
    tx, newest = spark.read.parquet(path), files.newest_stamps(spark, path, ["shop"])
    frames = {"summary": windows.status_summary(tx, 24, "HOUR"), "detect": policy.policy_detect(tx, unit="HOUR"),
              "status": policy.current_status(tx, unit="HOUR"), "history": series.history_window(tx, 24, "HOUR"),
              "keyed summary": windows.status_summary(tx, 24, "HOUR", ["shop"], newest),
              "keyed detect": policy.policy_detect(tx, unit="HOUR", keys=["shop"], newest=newest)}
    for name, df in frames.items():
        text = plan_text(df)
        scans = [x for x in text.split("\n\n") if "Scan parquet" in x and "/tx]" in x and "Location" in x]
        assert scans, name
        for scan in scans:
            assert re.search(r"PartitionFilters: \[[^\]]*date#\d+ >= ", scan), (name, scan)
            assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", scan), (name, scan)
    plain = windows.status_summary(tx.drop("date"), 24, "HOUR", ["shop"])
    assert sorted(map(tuple, frames["keyed summary"].collect())) == sorted(map(tuple, plain.collect()))


def test_quiet_series_and_empty_tables_keep_their_window(spark):
    import datetime as dt

    from pulsewatch.operators import policy, windows

    t0 = dt.datetime(2025, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=m), "denied", 1) for m in range(5)] + [(2, t0 + dt.timedelta(days=9), "denied", 7)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, status string, cnt long").selectExpr("*", "to_date(ts) AS date")
    got = {(r.k, r.total, r.data_points) for r in windows.status_summary(df, 3, keys=["k"]).collect()}
    assert got == {(1, 4, 4), (2, 7, 1)}
    none = df.limit(0)
    assert windows.status_summary(none, 3).collect() == [] and windows.status_summary(none, 3, keys=["k"]).collect() == []
    assert windows.latest_stamp(none) is None and policy.current_status(none).first().eval_ts is None
