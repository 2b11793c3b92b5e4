"""Properties: keyed runs equal per-key runs; input order does not matter."""

from pyspark.sql import functions as F

from pulsewatch.config import PolicyParams, RollingParams
from pulsewatch.operators import outages, policy, rolling, series
from pulsewatch.sources import adapters as A

from .conftest import SMOKE

COLS = ["ts", "rolling_mean", "rolling_std", "z_score", "is_anomaly"]


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_keyed_rolling_equals_per_key(spark):
    tx = A.transactions(spark, SMOKE, unit="HOUR")
    keyed = rolling.rolling_zscore(tx, "cnt", keys=["status"], params=RollingParams())
    for s in ("approved", "denied", "failed"):
        one = rolling.rolling_zscore(tx.filter(F.col("status") == s), "cnt", params=RollingParams())
        assert _same(keyed.filter(F.col("status") == s).select(*COLS), one.select(*COLS))


def test_keyed_policy_backtest_equals_per_key(spark):
    tx = A.transactions(spark, SMOKE, unit="HOUR")
    two = tx.withColumn("series", F.lit("a")).unionByName(
        tx.withColumn("series", F.lit("b")).withColumn("cnt", F.col("cnt") * 2))
    cols = ["eval_ts", "status", "current_value", "z_raw", "overall_severity"]
    keyed = policy.policy_backtest(two, PolicyParams(), unit="HOUR", keys=["series"])
    for k in ("a", "b"):
        one = policy.policy_backtest(two.filter(F.col("series") == k).drop("series"), PolicyParams(), unit="HOUR")
        assert _same(keyed.filter(F.col("series") == k).select(*cols), one.select(*cols))


def test_keyed_outages_equal_per_key(spark):
    vol = series.volume_per_stamp(A.transactions(spark, SMOKE, unit="HOUR"))
    two = vol.withColumn("k", F.lit(1)).unionByName(vol.withColumn("k", F.lit(2)).withColumn("total", F.col("total") + 1))
    keyed = outages.outage_periods(two, unit="HOUR", keys=["k"])
    for k in (1, 2):
        one = outages.outage_periods(two.filter(F.col("k") == k).drop("k"), unit="HOUR")
        assert _same(keyed.filter(F.col("k") == k).drop("k"), one)


def test_row_order_does_not_matter(spark):
    tx = A.transactions(spark, SMOKE, unit="HOUR")
    shuffled = tx.orderBy(F.rand(7)).repartition(5)
    a = policy.policy_backtest(tx, unit="HOUR").select("eval_ts", "status", "z_raw")
    b = policy.policy_backtest(shuffled, unit="HOUR").select("eval_ts", "status", "z_raw")
    assert _same(a, b)


def test_chunked_row_frame_equals_unchunked(spark):
    # sf0.001 hourly totals have gaps; 1-day chunks hold < 24 rows, so the
    # 59 preceding rows of a chunk come from several earlier chunks.
    vol = series.volume_per_stamp(A.transactions(spark, SMOKE, unit="HOUR"))
    a = rolling.rolling_zscore(vol, "total").select(*COLS)
    for secs in (86400, 3 * 86400, 40 * 86400):
        b = rolling.rolling_zscore(vol, "total", chunk_seconds=secs).select(*COLS)
        assert _same(a, b)
    keyed = A.transactions(spark, SMOKE, unit="HOUR")
    c = rolling.rolling_zscore(keyed, "cnt", keys=["status"]).select("status", *COLS)
    d = rolling.rolling_zscore(keyed, "cnt", keys=["status"], chunk_seconds=86400).select("status", *COLS)
    assert _same(c, d)


def test_chunked_signal_frame_equals_unchunked(spark):
    from pulsewatch.operators import timeline
    tx = A.transactions(spark, SMOKE, unit="HOUR")
    # zero-total stamps make the rate series differ from the volume series
    zeros = tx.select("ts").distinct().limit(40).select(
        (F.col("ts") - F.expr("INTERVAL 30 MINUTES")).alias("ts"), F.lit("approved").alias("status"),
        F.lit(0).cast("bigint").alias("cnt"))
    rates = series.rate_series(tx.unionByName(zeros))
    auth = series.auth_rates(A.auth_codes(spark, SMOKE))
    cols = ["ts", "volume_zscore", "approval_zscore", "error_zscore", "cross_signal_divergent"]
    a = timeline.signal_frame(rates, auth).select(*cols)
    for secs in (86400, 5 * 86400):
        b = timeline.signal_frame(rates, auth, chunk_seconds=secs).select(*cols)
        assert _same(a, b)


def test_chunked_outages_equal_unchunked(spark):
    # sf0.001 hourly totals are mostly near zero: long periods cross chunk edges
    vol = series.volume_per_stamp(A.transactions(spark, SMOKE, unit="HOUR"))
    a = outages.outage_periods(vol, unit="HOUR")
    assert a.count() > 10
    for units in (5, 24, 24 * 9):
        assert _same(a, outages.outage_periods(vol, unit="HOUR", chunk_units=units))
    two = vol.withColumn("k", F.lit(1)).unionByName(vol.withColumn("k", F.lit(2)).withColumn("total", F.col("total") + 1))
    assert _same(outages.outage_periods(two, unit="HOUR", keys=["k"]),
                 outages.outage_periods(two, unit="HOUR", keys=["k"], chunk_units=24))


def test_chunked_low_runs_equal_unchunked(spark):
    from pulsewatch.operators import timeline
    vol = series.volume_per_stamp(A.transactions(spark, SMOKE, unit="HOUR"))
    a = timeline.low_run_lengths(vol, "HOUR", low_volume=3).select("ts", "low_run_length")
    assert a.filter(F.col("low_run_length") >= 3).count() > 0
    for units in (2, 5, 24):
        b = timeline.low_run_lengths(vol, "HOUR", low_volume=3, chunk_units=units).select("ts", "low_run_length")
        assert _same(a, b)


def test_describe_approx_close_to_exact(spark):
    rates = series.rate_series(A.transactions(spark, SMOKE, unit="HOUR"))
    a = {r.metric: r for r in series.describe(rates, ["total"]).collect()}["total"]
    b = {r.metric: r for r in series.describe(rates, ["total"], exact=False).collect()}["total"]
    assert a.n == b.n and a.mean == b.mean and abs(a.p50 - b.p50) <= 1.0


def test_naive_rule_sql_view_equals_dataframe(spark):
    from pulsewatch.operators import checkout
    cd = A.checkout_data(spark, SMOKE)
    cols = ["snapshot", "day", "time", "pct_deviation_week", "is_naive_anomaly", "naive_severity"]
    assert _same(checkout.naive_baseline(cd).select(*cols), checkout.naive_baseline_sql(cd).select(*cols))
