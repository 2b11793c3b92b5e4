"""File sources and sinks: append/reset of the fact table, CSV export and scans."""

import tempfile

from pyspark.sql import functions as F

from pulsewatch.operators import alerts
from pulsewatch.sources import adapters as A
from pulsewatch.sources import files

from .conftest import SMOKE


def test_append_and_reset(spark):
    path = tempfile.mkdtemp(prefix="pw-fact-", dir="/tmp") + "/fact"
    tx = A.transactions(spark, SMOKE, unit="HOUR")
    n = files.append_transactions(tx, path, reset=True)
    assert files.append_transactions(tx, path) == n
    assert spark.read.parquet(path).count() == 2 * n
    files.append_transactions(tx, path, reset=True)
    back = spark.read.parquet(path)
    assert back.count() == n and {"ingested_at", "date"} <= set(back.columns)


def test_export_and_rescan_csv(spark):
    out = tempfile.mkdtemp(prefix="pw-csv-", dir="/tmp") + "/exp"
    tx = A.transactions(spark, SMOKE, unit="HOUR").withColumnRenamed("status", "snapshot")
    files.export_by_snapshot(tx.select("ts", "snapshot", "cnt"), out)
    again = (spark.read.option("header", True).csv(out)
             .select(F.col("ts").alias("timestamp"), F.col("snapshot").alias("status"), F.col("cnt").alias("count")))
    csv = tempfile.mkdtemp(prefix="pw-csv2-", dir="/tmp") + "/tx"
    again.write.option("header", True).csv(csv)
    back = files.read_transactions_csv(spark, csv)
    assert back.count() == tx.count() and dict(back.dtypes)["cnt"] == "bigint"


def test_alert_log_levels(spark):
    import datetime as dt
    rows = [("denied", "CRITICAL", 20, 3.0, 1.5, 4.5, 4.5, dt.datetime(2025, 7, 12)),
            ("failed", "WARNING", 9, 3.0, 2.0, 3.0, 4.5, dt.datetime(2025, 7, 12))]
    a = spark.createDataFrame(rows, "status string, severity string, current_value bigint, baseline_mean double, "
                                    "baseline_std double, z_score double, score double, alert_ts timestamp_ntz")
    log = {r.level: r.message for r in alerts.alert_log(a).collect()}
    assert log["CRITICAL"].startswith("ALERT: denied transactions anomaly — count=20, z_score=4.50")
    assert log["WARNING"].startswith("ELEVATED: failed transactions above normal")
    assert alerts.outbox(a).count() == 1


def test_auth_csv_keeps_codes_as_text(spark):
    path = tempfile.mkdtemp(prefix="pw-auth-", dir="/tmp") + "/auth"
    spark.createDataFrame([("2025-07-12 14:00:00", "00", 5), ("2025-07-12 14:00:00", "05", 1)],
                          "timestamp string, auth_code string, count bigint") \
        .coalesce(1).write.option("header", True).csv(path)
    back = files.read_auth_csv(spark, path)
    assert sorted(r.auth_code for r in back.collect()) == ["00", "05"]
    assert dict(back.dtypes) == {"ts": "timestamp_ntz", "auth_code": "string", "cnt": "bigint"}


def test_header_map_round_trip(spark):
    from pulsewatch.sources import messages
    df = spark.createDataFrame([({"traceparent": "00-" + "a" * 32 + "-" + "b" * 16 + "-01", "k": "v"},)],
                               "carrier map<string,string>")
    back = df.select(messages.map_to_headers("carrier").alias("headers")).select(
        messages.headers_to_map("headers").alias("m"))
    m = back.collect()[0].m
    assert m["k"] == "v" and m["traceparent"].endswith("-01")
    tp = back.select(messages.parse_traceparent(F.col("m")["traceparent"]).alias("t")).collect()[0].t
    assert tp.valid and tp.trace_id == "a" * 32 and tp.span_id == "b" * 16
