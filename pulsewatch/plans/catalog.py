"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each query reads the driver's tables through ``pulsewatch.sources.adapters``
and runs one operator family over the whole tables.  Column names and types
match the SQL twin in :mod:`pulsewatch.plans.oracle`.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows
from ..session import ensure_checkpoint_dir
from ..sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    """Register a query.  The stored callable first pins the session time zone
    to UTC (stamps are wall-clock NTZ values; epoch arithmetic must not shift
    them) and makes sure a checkpoint folder is configured."""
    def deco(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        return fn
    return deco


def _recent(spark, sf, units, unit="HOUR"):
    """The series over the last ``units`` (window * statuses rows), read by one
    bounded scan and written once: the operators read it several times."""
    return A.recent_transactions(spark, sf, units, unit).checkpoint()


@register("status_summary")
def q_status_summary(spark, sf):
    return windows.status_summary(_recent(spark, sf, 24), window=24, unit="HOUR")


@register("status_rates")
def q_status_rates(spark, sf):
    return windows.status_rates(_recent(spark, sf, 24), window=24, unit="HOUR")


@register("status_distribution")
def q_status_distribution(spark, sf):
    return windows.status_distribution(_recent(spark, sf, 1), window=1, unit="HOUR")


# --- series, rates, auth codes, profiling (phase 3) ------------------------------
from ..operators import completeness, quality, quantiles, ranges, series  # noqa: E402


@register("history_window")
def q_history_window(spark, sf):
    return series.history_window(_recent(spark, sf, 60), window=60, unit="HOUR")


@register("recent_records")
def q_recent_records(spark, sf):
    tx = A.transactions(spark, sf).withColumn("ingested_at", F.col("ts"))
    return windows.recent(tx, limit=10, order=("ingested_at", "status")).select(
        "ts", "status", "cnt", "ingested_at")


@register("profile")
def q_profile(spark, sf):
    return series.profile(A.transactions(spark, sf))


@register("describe_rates")
def q_describe_rates(spark, sf):
    return series.describe(series.rate_series(A.transactions(spark, sf)),
                           ["total", "approval_rate", "error_rate"])


@register("volume_per_minute")
def q_volume_per_minute(spark, sf):
    return series.volume_per_stamp(A.transactions(spark, sf))


@register("volume_by_status")
def q_volume_by_status(spark, sf):
    return series.volume_by_status(A.transactions(spark, sf))


@register("rate_series")
def q_rate_series(spark, sf):
    return series.rate_series(A.transactions(spark, sf))


@register("auth_rates")
def q_auth_rates(spark, sf):
    return series.auth_rates(A.auth_codes(spark, sf))


@register("top_codes")
def q_top_codes(spark, sf):
    return series.top_codes(A.auth_codes(spark, sf), n=10)


@register("top_error_series")
def q_top_error_series(spark, sf):
    return series.top_code_series(A.auth_codes(spark, sf), n=5)


@register("quality_report")
def q_quality_report(spark, sf):
    tx = quality.quality_summary(A.transactions(spark, sf), "transactions", ["ts"])
    au = quality.quality_summary(A.auth_codes(spark, sf), "auth_codes", ["ts", "auth_code"],
                                 category="auth_code")
    return tx.unionByName(au)


@register("reconcile")
def q_reconcile(spark, sf):
    tx = (A.transactions(spark, sf).filter(F.col("status").isin("approved", "denied"))
          .withColumnRenamed("cnt", "total"))
    au = A.auth_codes(spark, sf).withColumnRenamed("cnt", "total")
    return quality.reconcile(tx, au)


@register("missing_slots")
def q_missing_slots(spark, sf):
    return quality.missing_stamps(A.transactions(spark, sf, unit="MINUTE"), unit="MINUTE")


@register("missing_stamps_keyed")
def q_missing_stamps_keyed(spark, sf):
    """Minutes that each shop's series lacks."""
    return quality.missing_stamps(A.shop_transactions(spark, sf, unit="MINUTE"), unit="MINUTE", keys=["shop"])


@register("completeness_keyed")
def q_completeness_keyed(spark, sf):
    return completeness.completeness(A.shop_transactions(spark, sf, unit="MINUTE"), "MINUTE", ["shop"])


@register("quality_frame")
def q_quality_frame(spark, sf):
    """One quality report of the shops' transactions and codes, with missing hours and reconciliation."""
    tx = A.shop_transactions(spark, sf).checkpoint()
    au = A.shop_auth_codes(spark, sf).checkpoint()
    paid = tx.filter(F.col("status").isin("approved", "denied")).withColumnRenamed("cnt", "total")
    return completeness.quality_frame(
        [("transactions", tx, ["ts"], "status"), ("auth_codes", au, ["ts", "auth_code"], "auth_code")],
        ("transactions - auth_codes", paid, au.withColumnRenamed("cnt", "total")), "HOUR", ["shop"])


@register("reconcile_keyed")
def q_reconcile_keyed(spark, sf):
    tx = A.shop_transactions(spark, sf).filter(F.col("status").isin("approved", "denied")).withColumnRenamed("cnt", "total")
    return quality.reconcile(tx, A.shop_auth_codes(spark, sf).withColumnRenamed("cnt", "total"), keys=["shop"])


@register("recent_records_keyed")
def q_recent_records_keyed(spark, sf):
    return windows.recent(A.shop_transactions(spark, sf), limit=7, order=("ts", "status"), keys=["shop"])


@register("top_codes_keyed")
def q_top_codes_keyed(spark, sf):
    return series.top_codes(A.shop_auth_codes(spark, sf), n=4, keys=["shop"])


@register("top_error_series_keyed")
def q_top_error_series_keyed(spark, sf):
    return series.top_code_series(A.shop_auth_codes(spark, sf), n=3, exclude=("00", "0"), keys=["shop"])


@register("auth_rates_keyed")
def q_auth_rates_keyed(spark, sf):
    return series.auth_rates(A.shop_auth_codes(spark, sf), keys=["shop"])


@register("profile_keyed")
def q_profile_keyed(spark, sf):
    return series.profile(A.shop_transactions(spark, sf), keys=["shop"])


@register("describe_keyed")
def q_describe_keyed(spark, sf):
    """Exact quartiles of each shop's series."""
    return series.describe(series.rate_series(A.shop_transactions(spark, sf), keys=["shop"]), ["total", "error_rate"], keys=["shop"])


@register("value_quantiles")
def q_value_quantiles(spark, sf):
    """Exact quantiles of a raw column: the event values of each type."""
    q = quantiles.exact_quantiles(A.table(spark, sf, "events"), "value", (0.01, 0.25, 0.5, 0.75, 0.99), ["event_type"])
    return q.select("event_type", "n", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((1, 25, 50, 75, 99))])


@register("value_sketch")
def q_value_sketch(spark, sf):
    """Daily sketches of the event values, merged per type: their medians lie within the
    sketch's error of the exact ranks."""
    ev = A.table(spark, sf, "events").select("event_type", "value", F.to_date("ts").alias("day"))
    merged = quantiles.merge_sketches(quantiles.sketch(ev, "value", ["event_type", "day"]), ["event_type"])
    q = quantiles.sketch_quantiles(merged, (0.25, 0.5, 0.75), ["event_type"])
    ranks = ev.join(q, "event_type").groupBy("event_type", "n").agg(*[
        F.avg((F.col("value") < F.col("q")[i]).cast("double")).alias(f"r{i}") for i in range(3)])
    near = lambda i, p: F.abs(F.col(f"r{i}") - p) <= 0.03
    return ranks.select("event_type", "n", (near(0, 0.25) & near(1, 0.5) & near(2, 0.75)).alias("within"))


@register("period_averages")
def q_period_averages(spark, sf):
    """Average daily volume between the order and the shipping of every line item."""
    daily = series.volume_per_stamp(A.transactions_daily(spark, sf))
    return ranges.range_averages(daily, A.shipping_periods(spark, sf), "DAY")


@register("validate_records")
def q_validate_records(spark, sf):
    return quality.validate(A.raw_records(spark, sf))


# --- rolling detectors, divergence, outages, timeline (phases 4-5) ------------
from ..config import RollingParams  # noqa: E402
from ..operators import outages, rolling, timeline  # noqa: E402

ROLL_COLS = ("rolling_mean", "rolling_std", "z_score", "is_anomaly", "is_spike", "is_drop")


def r9(df: DataFrame, cols) -> DataFrame:
    """Round order-dependent floating results (window/global double sums) to 9 dp."""
    for c in cols:
        df = df.withColumn(c, F.round(c, 9))
    return df


def _rates(spark, sf):
    return series.rate_series(A.transactions(spark, sf))


# Time chunks of the row frames: every series is split, whatever its length, so
# that the plan is the same at every size.
WEEK = 7 * 86400  # hourly series
YEAR = 365 * 86400  # daily and weekly series


def _series(df: DataFrame) -> DataFrame:
    """Write the aggregated per-stamp series once: it is tiny next to the raw
    tables, and the chunks, their copies and their counts all read it."""
    return df.checkpoint()


@register("rolling_volume")
def q_rolling_volume(spark, sf):
    rates = _series(_rates(spark, sf))
    r = rolling.rolling_zscore(rates, "total", params=RollingParams(z_threshold=3.0),
                               chunk_seconds=WEEK)
    return r.select("ts", F.col("total").alias("value"), *ROLL_COLS)


@register("rolling_approval")
def q_rolling_approval(spark, sf):
    rates = _series(_rates(spark, sf))
    r = rolling.rolling_zscore(rates, "approval_rate", dropna=True,
                               params=RollingParams(z_threshold=2.5), chunk_seconds=WEEK)
    return r9(r.select("ts", F.col("approval_rate").alias("value"), *ROLL_COLS),
              ["rolling_mean", "rolling_std", "z_score"])


@register("rolling_error")
def q_rolling_error(spark, sf):
    rates = _series(_rates(spark, sf))
    r = rolling.rolling_zscore(rates, "error_rate", dropna=True,
                               params=RollingParams(z_threshold=2.5), chunk_seconds=WEEK)
    r = r.withColumn("direction", rolling.direction())
    return r9(r.select("ts", F.col("error_rate").alias("value"), *ROLL_COLS, "direction"),
              ["rolling_mean", "rolling_std", "z_score"])


@register("rolling_bands")
def q_rolling_bands(spark, sf):
    rates = _series(_rates(spark, sf))
    r = rolling.rolling_zscore(rates, "total", params=RollingParams(z_threshold=3.0),
                               chunk_seconds=WEEK)
    r = rolling.bands(r, 3.0).withColumn("direction", rolling.direction())
    return r.select("ts", F.col("total").alias("value"), "rolling_mean", "band_lower", "band_upper",
                    "is_anomaly", "direction")


@register("rolling_keyed")
def q_rolling_keyed(spark, sf):
    r = rolling.rolling_zscore(_series(A.transactions(spark, sf)), "cnt", keys=["status"],
                               params=RollingParams(z_threshold=3.0), chunk_seconds=WEEK)
    return r.select("status", "ts", F.col("cnt").alias("value"), *ROLL_COLS)


@register("rolling_daily")
def q_rolling_daily(spark, sf):
    d = _series(series.rate_series(A.transactions_daily(spark, sf)))
    r = rolling.rolling_zscore(d, "total", params=RollingParams(z_threshold=3.0), chunk_seconds=YEAR)
    return r.select("ts", F.col("total").alias("value"), *ROLL_COLS)


@register("cross_signal")
def q_cross_signal(spark, sf):
    d = rolling.divergence(_rates(spark, sf), series.auth_rates(A.auth_codes(spark, sf)))
    return r9(d, ["threshold"])


@register("outage_periods")
def q_outage_periods(spark, sf):
    vol = _series(series.volume_per_stamp(A.transactions(spark, sf)))
    return outages.outage_periods(vol, unit="HOUR", chunk_units=7 * 24)


def _signals(spark, sf):
    base = timeline.signal_base(_rates(spark, sf), series.auth_rates(A.auth_codes(spark, sf)))
    return timeline.signal_frame(base, None, chunk_seconds=WEEK)


@register("anomaly_timeline")
def q_anomaly_timeline(spark, sf):
    return r9(timeline.anomaly_timeline(_signals(spark, sf)), ["approval_zscore", "error_zscore"])


@register("timeline_5min")
def q_timeline_5min(spark, sf):
    return timeline.resample_max(timeline.anomaly_timeline(_signals(spark, sf)), 5, unit="HOUR")


@register("severity_distribution")
def q_severity_distribution(spark, sf):
    return timeline.severity_distribution(timeline.anomaly_timeline(_signals(spark, sf)))


@register("flag_counts")
def q_flag_counts(spark, sf):
    t = timeline.anomaly_timeline(_signals(spark, sf))
    return t.agg(
        F.count(F.lit(1)).alias("n_stamps"),
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in
          ("volume_anomaly", "approval_anomaly", "error_anomaly", "cross_signal_divergent", "near_zero")],
        F.sum((F.col("total_score") > 0).cast("bigint")).alias("anomalous"),
    ).withColumn("anomalous_pct", F.lit(100.0) * F.col("anomalous").cast("double") / F.col("n_stamps").cast("double"))


@register("rule_book")
def q_rule_book(spark, sf):
    sig = _signals(spark, sf)
    return timeline.rule_book(sig, unit="HOUR", chunk_units=7 * 24)


@register("recommended_thresholds")
def q_recommended_thresholds(spark, sf):
    t = timeline.recommended_thresholds(_signals(spark, sf))
    return r9(t, ["apr_mean", "apr_std", "apr_critical", "err_mean", "err_std", "divergence_threshold"])


# --- checkout family (phase 6) ------------------------------------------------------
from ..operators import checkout  # noqa: E402

CHECKOUT_KEYS = ("snapshot", "day")
SNAPSHOTS = ("click", "error", "purchase", "signup", "view")
BASE_COLS = ("snapshot", "day", "time", "hour_of_day", "today", "yesterday", "same_day_last_week",
             "avg_last_week", "avg_last_month")
L4_COLS = ("expected", "estimated_std", "z_score", "is_zscore_anomaly", "is_low_traffic", "abs_deviation",
           "is_volume_anomaly", "is_outage", "historical_max", "is_spike", "actual_change", "expected_change",
           "change_deviation", "change_std", "change_z_score", "is_slope_anomaly", "anomaly_score",
           "severity", "is_anomalous")
L3_COLS = ("expected", "estimated_std", "z_score", "is_zscore_anomaly", "is_low_traffic", "abs_deviation",
           "pct_deviation", "is_volume_anomaly", "is_outage", "historical_max", "is_spike", "anomaly_score",
           "severity", "is_anomalous")


def _detected(spark, sf, layers=4):
    return checkout.detect_checkout(A.checkout_data(spark, sf), keys=CHECKOUT_KEYS,
                                    hour="hour_of_day", layers=layers)


@register("checkout_baselines")
def q_checkout_baselines(spark, sf):
    return A.checkout_data(spark, sf)


@register("checkout_4layer")
def q_checkout_4layer(spark, sf):
    return _detected(spark, sf).select(*BASE_COLS, *L4_COLS)


@register("checkout_3layer")
def q_checkout_3layer(spark, sf):
    return _detected(spark, sf, layers=3).select(*BASE_COLS, *L3_COLS)


@register("checkout_naive")
def q_checkout_naive(spark, sf):
    return checkout.naive_baseline(A.checkout_data(spark, sf)).select(
        "snapshot", "day", "time", "today", "avg_last_week", "avg_last_month",
        "pct_deviation_week", "is_naive_anomaly", "naive_severity")


@register("checkout_bounds")
def q_checkout_bounds(spark, sf):
    return checkout.alert_bounds(_detected(spark, sf)).select(
        "snapshot", "day", "time", "traffic_level", "expected_1dp", "lower_bound", "upper_bound")


@register("checkout_bands")
def q_checkout_bands(spark, sf):
    return checkout.confidence_bands(_detected(spark, sf)).select(
        "snapshot", "day", "hour_of_day", "today", "expected", "band1_lower", "band1_upper",
        "band2_lower", "band2_upper")


@register("checkout_ratio")
def q_checkout_ratio(spark, sf):
    return checkout.ratio_matrix(A.checkout_data(spark, sf), SNAPSHOTS)


@register("checkout_totals")
def q_checkout_totals(spark, sf):
    return r9(checkout.day_totals(A.checkout_data(spark, sf)),
              ["total_avg_week", "total_avg_month", "pct_vs_week", "pct_vs_month"])


@register("checkout_reasons")
def q_checkout_reasons(spark, sf):
    return (checkout.reasons(_detected(spark, sf))
            .select("snapshot", "day", "time", "severity", "anomaly_score", "reasons")
            .orderBy(F.desc("anomaly_score"), "snapshot", "day", "time"))


# --- policy detector, report, evaluation (phase 7) -----------------------------------
from ..config import INSERT_BUCKETS, MONITORED_STATUSES, PolicyParams  # noqa: E402
from ..operators import policy  # noqa: E402

DETAIL_COLS = ("eval_ts", "status", "current_value", "baseline_mean", "baseline_std", "z_score", "z_raw",
               "is_anomalous", "contribution", "n_history", "overall_severity", "max_z_score", "recommendation")


@register("policy_detect")
def q_policy_detect(spark, sf):
    return policy.policy_detect(_recent(spark, sf, 60), PolicyParams(), unit="HOUR").select(*DETAIL_COLS)


@register("policy_backtest")
def q_policy_backtest(spark, sf):
    return policy.policy_backtest(A.transactions(spark, sf), PolicyParams(), unit="HOUR").select(*DETAIL_COLS)


@register("analyze_report")
def q_analyze_report(spark, sf):
    return policy.analyze(_recent(spark, sf, 60), window=60, unit="HOUR").select(
        "eval_ts", "status", "severity", "z_score", "current_value", "baseline_mean", "baseline_std",
        "is_anomalous", F.col("contribution").alias("message"), "overall_severity", "max_z_score",
        "recommendation", "window", "detection_method")


@register("current_status")
def q_current_status(spark, sf):
    cs = policy.current_status(_recent(spark, sf, 60), PolicyParams(), unit="HOUR")
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{s}="), F.format_string("%.2f", F.col("statuses")[s]))
                               for s in MONITORED_STATUSES])
    return cs.select("eval_ts", "overall_severity", "max_z_score", text.alias("statuses_text"))


@register("evaluate_counts")
def q_evaluate_counts(spark, sf):
    tx = _recent(spark, sf, 60)
    obs = windows.trailing(tx, 24, "HOUR").withColumnRenamed("ts", "obs_ts")
    return policy.evaluate_counts(obs, tx, PolicyParams(), unit="HOUR")


# --- alerts and cooldown (phase 8) -----------------------------------------------------
from ..operators import alerts  # noqa: E402

COOLDOWN = 5 * 3600  # five stamps of the hourly series, as 300 s is five per-minute stamps


def _alerts(spark, sf):
    bt = policy.policy_backtest(A.transactions(spark, sf), PolicyParams(), unit="HOUR")
    return alerts.dispatch(bt, cooldown_seconds=COOLDOWN)


@register("alert_dispatch")
def q_alert_dispatch(spark, sf):
    return _alerts(spark, sf)


@register("alert_counts")
def q_alert_counts(spark, sf):
    return alerts.alert_counts(_alerts(spark, sf))


@register("alert_outbox")
def q_alert_outbox(spark, sf):
    return alerts.outbox(_alerts(spark, sf))


# --- messages, streaming, metrics, logs (phases 9-10) -----------------------------------
from ..operators import metrics  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources import messages  # noqa: E402
from ..operators import tracing  # noqa: E402
from ..streaming import late, monitor, progress, state  # noqa: E402


@register("batch_messages")
def q_batch_messages(spark, sf):
    return messages.encode_batches(A.transactions(spark, sf, unit="MINUTE"))


@register("decode_batches")
def q_decode_batches(spark, sf):
    enc = messages.encode_batches(A.transactions(spark, sf, unit="MINUTE")).withColumnRenamed("message", "value")
    good, _ = messages.decode_batches(enc)
    return good.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "cnt")


@register("stream_ingest")
def q_stream_ingest(spark, sf):
    base = scratch_path(spark, "stream-ingest")
    monitor.write_messages(A.transactions(spark, sf, unit="MINUTE"), f"{base}/src")
    q = monitor.ingest(spark, f"{base}/src", f"{base}/out", f"{base}/dead", f"{base}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "cnt")


@register("stream_minutes")
def q_stream_minutes(spark, sf):
    base = scratch_path(spark, "stream-minutes")
    monitor.write_messages(A.transactions(spark, sf, unit="MINUTE"), f"{base}/src", flush_seconds=2 * 3600)
    monitor.run_windowed_counts(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@register("ingest_counters")
def q_ingest_counters(spark, sf):
    return metrics.ingest_counters(A.transactions(spark, sf, unit="MINUTE"))


@register("duration_histogram")
def q_duration_histogram(spark, sf):
    r = A.requests(spark, sf).withColumnRenamed("path", "operation")
    return metrics.duration_histogram(r, "duration", labels=["operation"])


@register("request_counts")
def q_request_counts(spark, sf):
    return metrics.request_counts(A.requests(spark, sf))


@register("log_parse")
def q_log_parse(spark, sf):
    return metrics.parse_logs(A.log_lines(spark, sf))


@register("parse_headers")
def q_parse_headers(spark, sf):
    h = A.order_headers(spark, sf).select("o_orderkey", messages.headers_to_map("headers").alias("m"))
    tp = messages.parse_traceparent(F.col("m")["traceparent"])
    return h.select("o_orderkey", F.size("m").alias("n_headers"), F.col("m")["source"].alias("source"),
                    tp.alias("t")).select("o_orderkey", "n_headers", "source", "t.*")


def _half(tx: DataFrame):
    """Two micro-batches: the number of the half of the series that a row is in."""
    lo, hi = tx.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))), F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()
    return F.when(F.unix_seconds(F.col("ts").cast("timestamp")) > F.lit(((lo or 0) + (hi or 0)) // 2), 1).otherwise(0)


@register("stream_outages")
def q_stream_outages(spark, sf):
    """Near-zero periods in two micro-batches; the latest row of each."""
    base = scratch_path(spark, "stream-outages")
    tx = A.transactions(spark, sf, unit="MINUTE").checkpoint()
    run = lambda: monitor.run_to_parquet(state.outage_events(
        messages.decode_batches(monitor.read_messages(spark, f"{base}/src"))[0]), f"{base}/out", f"{base}/ckpt")
    monitor.replay(tx, f"{base}/src", _half(tx), run, flush_seconds=5 * 3600)
    return state.current_periods(spark.read.parquet(f"{base}/out")).drop("state")


def _keyed_stream(spark, path: str, tx: DataFrame, run) -> None:
    """Two micro-batches of (shop, ts, status, cnt) rows, and a heartbeat in a shop of its own."""
    half = tx.withColumn("part", _half(tx)).withColumn("ts", F.col("ts").cast("timestamp")).checkpoint()
    for k in (0, 1):
        half.filter(F.col("part") == k).drop("part").write.mode("append").parquet(path)
        if k:
            half.agg((F.max("ts") + F.expr("INTERVAL 5 HOURS")).alias("ts")).where("ts IS NOT NULL").select(
                F.lit(-1).cast("bigint").alias("shop"), "ts", F.lit("heartbeat").alias("status"),
                F.lit(0).cast("bigint").alias("cnt")).write.mode("append").parquet(path)
        run(spark.readStream.schema("shop bigint, ts timestamp, status string, cnt bigint").parquet(path)).awaitTermination()


@register("stream_outages_keyed")
def q_stream_outages_keyed(spark, sf):
    """Near-zero periods of each shop on a stream."""
    base = scratch_path(spark, "stream-outages-keyed")
    _keyed_stream(spark, f"{base}/src", A.shop_transactions(spark, sf, unit="MINUTE"), lambda src: monitor.run_to_parquet(
        state.outage_events(src, keys=["shop"]), f"{base}/out", f"{base}/ckpt"))
    return state.current_periods(spark.read.parquet(f"{base}/out"), ["shop"]).where("shop >= 0").drop("state")


@register("stream_baseline")
def q_stream_baseline(spark, sf):
    base = scratch_path(spark, "stream-baseline")
    tx = A.transactions(spark, sf).checkpoint()
    run = lambda: monitor.run_to_parquet(state.rolling_baseline(
        messages.decode_batches(monitor.read_messages(spark, f"{base}/src"))[0]), f"{base}/out", f"{base}/ckpt")
    # Late enough for the last hour's window, too early for the heartbeat's.
    monitor.replay(tx, f"{base}/src", _half(tx), run, flush_seconds=3600 + 180)
    out = spark.read.parquet(f"{base}/out")
    return r9(out, [c for c in out.columns if c.endswith("_mean") or c.endswith("_std")])


@register("stream_baseline_keyed")
def q_stream_baseline_keyed(spark, sf):
    """The rolling baseline of each shop on a stream."""
    base = scratch_path(spark, "stream-baseline-keyed")
    _keyed_stream(spark, f"{base}/src", A.shop_transactions(spark, sf, unit="MINUTE"), lambda src: monitor.run_to_parquet(
        state.rolling_baseline(src, keys=["shop"]), f"{base}/out", f"{base}/ckpt"))
    out = spark.read.parquet(f"{base}/out").where("shop >= 0")
    return r9(out, [c for c in out.columns if c.endswith("_mean") or c.endswith("_std")])


TRACE_SECONDS = 400 * 86400


@register("trace_links")
def q_trace_links(spark, sf):
    """Consumed records linked to what produced them, and orphans of both sides."""
    p = tracing.with_trace(A.produced_records(spark, sf))
    c = tracing.with_trace(A.consumed_records(spark, sf), prefix="producer_")
    return tracing.link_traces(p, c, TRACE_SECONDS)


@register("trace_summary")
def q_trace_summary(spark, sf):
    """Records per kind of link, with the latency histogram in days."""
    days = [float(d * 86400) for d in (1, 7, 30, 90, 180, 365)]
    return tracing.link_summary(q_trace_links(spark, sf), days)


@register("stream_traces")
def q_stream_traces(spark, sf):
    """The same links from two streams in two micro-batches each."""
    base = scratch_path(spark, "stream-traces")
    sides = {"p": A.produced_records(spark, sf), "c": A.consumed_records(spark, sf)}
    cut = F.lit("1998-06-01").cast("timestamp")
    for k in (0, 1):
        for name, rows in sides.items():
            rows.where((F.col("ts") >= cut) == F.lit(bool(k))).withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"{base}/{name}")
            if k:  # a heartbeat past every time bound, with the id of no order
                rows.agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 900 DAYS")).alias("ts")).where("ts IS NOT NULL").select(
                    *[F.lit(-1).cast("bigint").alias(n) for n in rows.columns if n == "consumer_id"], "ts",
                    A.traceparent_header(F.lit(2_000_000_000 if name == "p" else 3_000_000_000).cast("bigint"), F.lit("01")).alias("headers")
                ).write.mode("append").parquet(f"{base}/{name}")
        src = {n: spark.readStream.schema(spark.read.parquet(f"{base}/{n}").schema).parquet(f"{base}/{n}") for n in sides}
        links = tracing.link_stream(tracing.with_trace(src["p"]), tracing.with_trace(src["c"], prefix="producer_"), TRACE_SECONDS)
        monitor.run_to_parquet(links, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@register("rolling_keyed_supplier")
def q_rolling_keyed_supplier(spark, sf):
    r = rolling.rolling_zscore(_series(A.supplier_weekly(spark, sf)), "cnt", keys=["s_nationkey"],
                               params=RollingParams(z_threshold=3.0), chunk_seconds=YEAR)
    return r.select("s_nationkey", "ts", F.col("cnt").alias("value"), *ROLL_COLS)


ERROR_Z = 2.5


@register("event_heads")
def q_event_heads(spark, sf, spikes_shown=20, rows_shown=30):
    """The event reports: first 20 error-rate spikes and first 30
    CRITICAL/WARNING timeline rows, by time (the limits are the report)."""
    signals = _signals(spark, sf)
    spikes = (signals.filter(F.col("error_zscore") > ERROR_Z).orderBy("ts").limit(spikes_shown)
              .select(F.lit("error_spike").alias("report"), "ts", F.lit(None).cast("string").alias("severity"),
                      F.round("error_zscore", 9).alias("score")))
    tl = timeline.anomaly_timeline(signals)
    crit = (tl.filter(F.col("severity").isin("CRITICAL", "WARNING")).orderBy("ts").limit(rows_shown)
            .select(F.lit("critical_warning").alias("report"), "ts", "severity",
                    F.col("total_score").cast("double").alias("score")))
    return spikes.unionByName(crit)


LAST_CHECKS = 4
STREAM_PARAMS = PolicyParams(z_score_threshold=0.5, critical_threshold=1.5)  # low, so that alerts and cooldowns occur
STREAM_COOLDOWN = 2 * 3600


def _alert_stream(spark, sf) -> str:
    """Replay of the series in LAST_CHECKS micro-batches: all stamps up to the
    first check, then one stamp each."""
    base = scratch_path(spark, "stream-alerts")
    tx = A.transactions(spark, sf).checkpoint()
    ends = [r.ts for r in tx.select("ts").distinct().orderBy(F.desc("ts")).limit(LAST_CHECKS).collect()][::-1]
    part = F.lit(0)
    for k, t in enumerate(ends[:-1]):
        part = F.when(F.col("ts") > F.lit(t), k + 1).otherwise(part)
    monitor.replay(tx, f"{base}/src", part, lambda: monitor.alert_check(
        spark, f"{base}/src", f"{base}/out", f"{base}/ckpt", params=STREAM_PARAMS, unit="HOUR", cooldown_seconds=STREAM_COOLDOWN))
    return f"{base}/out"


@register("stream_alerts")
def q_stream_alerts(spark, sf):
    """The details of every periodic check."""
    return spark.read.parquet(f"{_alert_stream(spark, sf)}/details").select(*DETAIL_COLS)


@register("stream_outbox")
def q_stream_outbox(spark, sf):
    """What the periodic checks sent: critical alerts past their cooldown."""
    return monitor.read_output(spark, _alert_stream(spark, sf), "outbox").select("status", "alert_ts", "payload")


@register("stream_gauges")
def q_stream_gauges(spark, sf):
    """Score gauges per status and overall, per check."""
    return monitor.read_output(spark, _alert_stream(spark, sf), "gauges").select("eval_ts", "status", "score")


@register("stream_cooldown")
def q_stream_cooldown(spark, sf):
    """The keyed cooldown state over a stream of alert candidates that come in three
    micro-batches out of order: a third of them a batch late, within the delay."""
    base = scratch_path(spark, "stream-cooldown")
    bt = policy.policy_backtest(A.transactions(spark, sf), PolicyParams(), unit="HOUR")
    cands = alerts.alert_candidates(bt).select("status", "severity", F.col("eval_ts").cast("timestamp").alias("alert_ts"), "z_score")
    rows = cands.withColumn("ts", F.col("alert_ts").cast("timestamp_ntz")).checkpoint()
    lag = (F.pmod(F.xxhash64("status", "severity", "alert_ts"), F.lit(3)) == 0).cast("int")
    rows = rows.withColumn("part", _half(rows) + lag).drop("ts").checkpoint()
    for k in (0, 1, 2):
        rows.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{base}/src")
        if k == 2:
            rows.agg((F.max("alert_ts") + F.expr("INTERVAL 800 DAYS")).alias("alert_ts")).where("alert_ts IS NOT NULL").select(
                F.lit("heartbeat").alias("status"), F.lit("NORMAL").alias("severity"), "alert_ts",
                F.lit(0.0).alias("z_score")).write.mode("append").parquet(f"{base}/src")
        src = spark.readStream.schema(cands.schema).parquet(f"{base}/src")
        monitor.run_to_parquet(state.cooldown_stream(src, COOLDOWN, delay="400 days"), f"{base}/out", f"{base}/ckpt").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("status", "severity", F.col("alert_ts").cast("timestamp_ntz").alias("alert_ts"),
                                                    "z_score")


ALLOWED_SECONDS = 3 * 86400


@register("stream_corrections")
def q_stream_corrections(spark, sf):
    """Windowed counts with records behind the watermark: every fifth minute of the first
    half comes with the second.  Up to three days late it corrects its closed window;
    beyond that it is put aside and counted, not added."""
    base = scratch_path(spark, "stream-corrections")
    tx = A.transactions(spark, sf, unit="MINUTE").checkpoint()
    held = F.unix_seconds(F.col("ts").cast("timestamp")) % 300 == 0
    monitor.replay(tx, f"{base}/src", F.when(held, 1).otherwise(_half(tx)), lambda: late.late_counts(
        spark, monitor.read_messages(spark, f"{base}/src"), f"{base}/out", f"{base}/ckpt", allowed_seconds=ALLOWED_SECONDS),
        flush_seconds=2 * 3600)
    out = late.current_windows(spark, f"{base}/out")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    dropped = late.late_records(spark, f"{base}/out", "dropped").groupBy(hour.alias("ts")).agg(F.count(F.lit(1)).alias("dropped"))
    return out.join(dropped, "ts", "full_outer").withColumn("dropped", F.coalesce("dropped", F.lit(0)))


@register("stream_metrics")
def q_stream_metrics(spark, sf):
    """Counters of the running ingest, as observed batch by batch, and the micro-batches
    that its duration histograms hold."""
    base = scratch_path(spark, "stream-metrics")
    tx = A.transactions(spark, sf, unit="MINUTE").checkpoint()
    listener = progress.ProgressTable(spark, f"{base}/progress")
    spark.streams.addListener(listener)

    def run():
        good, _ = messages.decode_batches(monitor.read_messages(spark, f"{base}/src"))
        q = monitor.run_to_parquet(progress.observed(good), f"{base}/out", f"{base}/ckpt")
        listener.wait(q)
        return q

    try:
        monitor.replay(tx, f"{base}/src", _half(tx), run)
    finally:
        spark.streams.removeListener(listener)
    rows = progress.read_progress(spark, f"{base}/progress")
    counters = progress.running_counters(rows).select("metric", "total")
    filled = progress.running_durations(rows).where("le = '+Inf'").select(
        F.concat("operation", F.lit("_batches")).alias("metric"), F.col("bucket_count").alias("total"))
    return counters.unionByName(filled)


@register("stream_late")
def q_stream_late(spark, sf):
    """Windowed counts with late and repeated messages: every fifth stamp is sent
    again, after all others and within the delay; nothing is counted twice."""
    base = scratch_path(spark, "stream-late")
    tx = A.transactions(spark, sf, unit="MINUTE").checkpoint()
    again = F.unix_seconds(F.col("ts").cast("timestamp")) % 300 == 0
    monitor.write_messages(tx.filter(~again), f"{base}/src")
    twice = messages.encode_batches(tx.filter(again)).select("message")
    twice.unionByName(twice).write.mode("append").text(f"{base}/src")
    beat = tx.agg((F.max("ts") + F.expr("INTERVAL 800 DAYS")).alias("ts")).select(
        "ts", F.lit("heartbeat").alias("status"), F.lit(0).cast("bigint").alias("cnt"))
    messages.encode_batches(beat).select("message").write.mode("append").text(f"{base}/src")
    monitor.run_windowed_counts(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt", delay="400 days",
                                dedupe=True).awaitTermination()
    return spark.read.parquet(f"{base}/out")


# --- more of the same operators: other inputs, so that every rule fires ------------------
from ..sources import files  # noqa: E402

TIGHT = RollingParams(z_threshold=2.5, min_std=0.01)


@register("rolling_approval_tight")
def q_rolling_approval_tight(spark, sf):
    r = rolling.rolling_zscore(_series(_rates(spark, sf)), "approval_rate", dropna=True, params=TIGHT, chunk_seconds=WEEK)
    return r9(r.select("ts", F.col("approval_rate").alias("value"), *ROLL_COLS), ["rolling_mean", "rolling_std", "z_score"])


@register("rolling_error_tight")
def q_rolling_error_tight(spark, sf):
    r = rolling.rolling_zscore(_series(_rates(spark, sf)), "error_rate", dropna=True, params=TIGHT, chunk_seconds=WEEK)
    r = r.withColumn("direction", rolling.direction())
    return r9(r.select("ts", F.col("error_rate").alias("value"), *ROLL_COLS, "direction"), ["rolling_mean", "rolling_std", "z_score"])


@register("rule_book_tight")
def q_rule_book_tight(spark, sf):
    """The written policy with thresholds at which each of its rules fires."""
    base = timeline.signal_base(_rates(spark, sf), series.auth_rates(A.auth_codes(spark, sf)))
    sig = timeline.signal_frame(base, None, p=timeline.TimelineParams(rate=TIGHT), chunk_seconds=WEEK)
    return timeline.rule_book(sig, unit="HOUR", low_volume=14, low_run=3, rate_z=1.5, sigmas=1.0, chunk_units=7 * 24)


@register("insert_histogram")
def q_insert_histogram(spark, sf):
    r = A.requests(spark, sf).withColumnRenamed("path", "operation")
    return metrics.duration_histogram(r, "duration", labels=["operation"], buckets=INSERT_BUCKETS)


@register("outage_minutes")
def q_outage_minutes(spark, sf):
    vol = _series(series.volume_per_stamp(A.transactions(spark, sf, unit="MINUTE")))
    return outages.outage_periods(vol, unit="MINUTE", chunk_units=7 * 24 * 60)


@register("quality_raw")
def q_quality_raw(spark, sf):
    """The quality report over records with nulls, negatives and duplicates."""
    raw = A.raw_records(spark, sf)
    faulty = raw.select(F.when(F.col("record_id") % 11 == 0, F.lit(None)).otherwise(F.col("ts")).alias("ts"), "status", "cnt")
    return quality.quality_summary(faulty, "raw_records", ["ts", "status"])


@register("reconcile_sources")
def q_reconcile_sources(spark, sf):
    """Two sources that differ: all approvals and denials against the hours whose
    authorisation codes are below 5."""
    tx = (A.transactions(spark, sf).filter(F.col("status").isin("approved", "denied")).withColumnRenamed("cnt", "total"))
    au = A.auth_codes(spark, sf).filter(F.col("auth_code") < "05").withColumnRenamed("cnt", "total")
    return quality.reconcile(tx, au)


@register("checkout_flag_counts")
def q_checkout_flag_counts(spark, sf):
    return checkout.flag_counts(_detected(spark, sf))


@register("checkout_severity")
def q_checkout_severity(spark, sf):
    return checkout.severity_counts(_detected(spark, sf))


@register("checkout_labels")
def q_checkout_labels(spark, sf):
    return checkout.flag_labels(_detected(spark, sf)).filter("is_anomalous").select("snapshot", "day", "time", "labels")


@register("checkout_rules")
def q_checkout_rules(spark, sf):
    return checkout.rule_book(_detected(spark, sf)).select("snapshot", "day", "time", "rule", "policy_severity")


@register("missing_hours")
def q_missing_hours(spark, sf):
    """Hours without an event, per event type and day on which it has any."""
    ev = A.table(spark, sf, "events").select(F.col("event_type").alias("snapshot"), A.truncate("ts", "DAY").alias("day"),
                                             F.hour("ts").alias("hour_of_day"))
    return checkout.missing_hours(ev)


@register("checkout_low_traffic")
def q_checkout_low_traffic(spark, sf):
    """The detector where traffic is low: one of ten events counts, a few count 20."""
    ev = A.table(spark, sf, "events").select(F.col("event_type").alias("snapshot"), "ts",
                                             F.when(F.col("event_id") % 499 == 0, 20).when(F.col("event_id") % 10 == 0, 1)
                                             .otherwise(0).cast("bigint").alias("value"))
    det = checkout.detect_checkout(checkout.build_baselines(ev), keys=CHECKOUT_KEYS, hour="hour_of_day")
    return det.select("snapshot", "day", "time", "today", "is_low_traffic", "is_volume_anomaly", "severity")


@register("analyze_report_short")
def q_analyze_report_short(spark, sf):
    """The report when the history is too short: the first 20 hours."""
    tx = A.transactions(spark, sf).checkpoint()
    first = tx.filter(F.col("ts") < tx.select(F.min("ts") + F.expr("INTERVAL 20 HOURS")).scalar())
    return policy.analyze(first, window=60, unit="HOUR").select("eval_ts", "status", "severity", "overall_severity", "max_z_score", "recommendation")


@register("analyze_report_empty")
def q_analyze_report_empty(spark, sf):
    """The report when no record is of the series: only future stamps asked for."""
    tx = A.transactions(spark, sf).filter("status = 'none'")
    return policy.analyze(tx, window=60, unit="HOUR").select("status", "severity", "overall_severity", "max_z_score", "recommendation")


@register("current_status_empty")
def q_current_status_empty(spark, sf):
    cs = policy.current_status(A.transactions(spark, sf).filter("status = 'none'"), PolicyParams(), unit="HOUR")
    return cs.select("overall_severity", "max_z_score", F.coalesce(F.size("statuses"), F.lit(0)).alias("n_statuses"))


@register("evaluate_unmonitored")
def q_evaluate_unmonitored(spark, sf):
    tx = _recent(spark, sf, 60)
    obs = windows.trailing(tx, 24, "HOUR").select(F.col("ts").alias("obs_ts"), F.concat(F.lit("x_"), "status").alias("status"), "cnt")
    return policy.evaluate_counts(obs, tx, PolicyParams(), unit="HOUR").select("obs_ts", "status", "cnt", "severity", "is_anomalous", "message")


@register("alert_no_cooldown")
def q_alert_no_cooldown(spark, sf):
    bt = policy.policy_backtest(A.transactions(spark, sf), PolicyParams(), unit="HOUR")
    return alerts.dispatch(bt, cooldown_seconds=0)


@register("alert_dispatch_keyed")
def q_alert_dispatch_keyed(spark, sf):
    bt = policy.policy_backtest(A.shop_transactions(spark, sf), PolicyParams(), unit="HOUR", keys=["shop"])
    return alerts.dispatch(bt, cooldown_seconds=COOLDOWN, keys=["shop"])


@register("decode_bad_messages")
def q_decode_bad_messages(spark, sf):
    """Good records and dead letters with their reason, of messages with faults."""
    good, bad = messages.decode_batches(A.faulty_messages(spark, sf).select("value"))
    none = F.lit(None)
    return (good.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "cnt", none.cast("string").alias("reason"))
            .unionByName(bad.select(none.cast("timestamp_ntz").alias("ts"), none.cast("string").alias("status"),
                                    none.cast("bigint").alias("cnt"), "reason")))


@register("csv_transactions")
def q_csv_transactions(spark, sf):
    path = scratch_path(spark, "csv-transactions")
    A.transactions(spark, sf).select(F.col("ts").alias("timestamp"), "status", F.col("cnt").alias("count")).write.option(
        "header", True).csv(path)
    return files.read_transactions_csv(spark, path)


@register("csv_auth")
def q_csv_auth(spark, sf):
    path = scratch_path(spark, "csv-auth")
    A.auth_codes(spark, sf).select(F.col("ts").alias("timestamp"), "auth_code", F.col("cnt").alias("count")).write.option(
        "header", True).csv(path)
    return files.read_auth_csv(spark, path)


@register("csv_checkout")
def q_csv_checkout(spark, sf):
    """Checkout files of every snapshot, written per snapshot and scanned as one."""
    path = scratch_path(spark, "csv-checkout")
    rows = A.checkout_data(spark, sf).withColumn("snapshot", F.concat(F.lit("checkout_"), "snapshot"))
    files.export_by_snapshot(rows.select("snapshot", "time", "today", "yesterday", "same_day_last_week", "avg_last_week",
                                         "avg_last_month"), path)
    back = files.read_checkout_csv(spark, f"{path}/*")
    return back.groupBy("snapshot", "hour").agg(F.count(F.lit(1)).alias("n"), F.sum("today").cast("bigint").alias("today"),
                                                F.sum("yesterday").cast("bigint").alias("yesterday"))


def _facts(spark, sf, keys=()):
    """The series (of the shops) as a fact table that the library appended to, and its path."""
    path = f"{scratch_path(spark, 'facts')}/tx"
    files.append_transactions(A.shop_transactions(spark, sf) if keys else A.transactions(spark, sf), path, keys=keys)
    return spark.read.parquet(path), path


@register("facts_status_summary")
def q_facts_status_summary(spark, sf):
    """The status summary over a fact table by date: the window's days are read."""
    return windows.status_summary(_facts(spark, sf)[0], window=24, unit="HOUR")


@register("facts_policy_detect")
def q_facts_policy_detect(spark, sf):
    return policy.policy_detect(_facts(spark, sf)[0], unit="HOUR").select(*DETAIL_COLS)


@register("facts_status_summary_keyed")
def q_facts_status_summary_keyed(spark, sf):
    """Each shop's summary at its own latest stamp, which is kept beside the table."""
    tx, path = _facts(spark, sf, ["shop"])
    return windows.status_summary(tx, window=24, unit="HOUR", keys=["shop"], newest=files.newest_stamps(spark, path, ["shop"]))


@register("fact_append")
def q_fact_append(spark, sf):
    """Two appends and a reset in between: the table holds what came after."""
    path = scratch_path(spark, "facts")
    tx = A.transactions(spark, sf).checkpoint()
    files.append_transactions(tx, path)
    files.append_transactions(tx.filter("status = 'denied'"), path, reset=True)
    files.append_transactions(tx.filter("status = 'failed'"), path)
    return spark.read.parquet(path).select("ts", "status", "cnt")


@register("anomalous_insert")
def q_anomalous_insert(spark, sf):
    """Observations of the last day that are anomalous, appended to the facts."""
    tx = _recent(spark, sf, 60)
    obs = windows.trailing(tx, 24, "HOUR").withColumn("cnt", F.col("cnt") * 3)
    path = scratch_path(spark, "anomalous")
    policy.append_anomalous(policy.evaluate_counts(obs, tx, PolicyParams(), unit="HOUR"), path)
    return spark.read.parquet(path).select("ts", "status", "cnt")


@register("checkout_naive_sql")
def q_checkout_naive_sql(spark, sf):
    return checkout.naive_baseline_sql(A.checkout_data(spark, sf)).select(
        "snapshot", "day", "time", "today", "avg_last_week", "avg_last_month",
        "pct_deviation_week", "is_naive_anomaly", "naive_severity")


@register("status_values")
def q_status_values(spark, sf):
    """The distinct statuses and codes, as the profile lists them."""
    st = A.transactions(spark, sf).select(F.lit("status").alias("kind"), F.col("status").alias("value"))
    return st.unionByName(A.auth_codes(spark, sf).select(F.lit("auth_code").alias("kind"), F.col("auth_code").alias("value"))).distinct()
