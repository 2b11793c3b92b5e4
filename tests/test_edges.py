"""Edge frames: hand-made inputs for the rules the generated tables rarely hit."""

import datetime as dt
import math

import pytest

from pulsewatch.config import OutageParams, PolicyParams, RollingParams
from pulsewatch.operators import alerts, checkout, outages, policy, rolling, series
from pulsewatch.sources.messages import decode_batches

T0 = dt.datetime(2025, 7, 12, 14, 0)


def minutes(i):
    return T0 + dt.timedelta(minutes=i)


def fact(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, status string, cnt bigint")


def test_history_29_vs_30(spark):
    for n, expect in ((29, 0), (30, 5)):
        df = fact(spark, [(minutes(i), "approved", 100) for i in range(n)])
        det = policy.policy_detect(df, PolicyParams(history_window=60))
        assert det.count() == expect


def test_insufficient_history_problem_status_is_critical(spark):
    hist = fact(spark, [(minutes(i), "approved", 100) for i in range(5)])
    obs = spark.createDataFrame([("denied", 1), ("approved", 7)], "status string, cnt bigint")
    out = {r.status: r for r in policy.evaluate_counts(obs, hist).collect()}
    assert out["denied"].severity == "CRITICAL" and out["denied"].z_score == 10.0
    assert out["denied"].is_anomalous and out["denied"].baseline_mean == 0.0
    assert out["approved"].severity == "NORMAL"
    assert out["approved"].message == "Insufficient history (5 < 30) for reliable evaluation."


def test_constant_history_std_floored(spark):
    hist = fact(spark, [(minutes(i), "denied", 4) for i in range(40)])
    obs = spark.createDataFrame([("denied", 9)], "status string, cnt bigint")
    r = policy.evaluate_counts(obs, hist).collect()[0]
    assert r.baseline_std == 0.0 and r.z_score == 5.0 and r.severity == "CRITICAL"
    assert r.message == "denied count 9 is 5.0σ above baseline (mean=4.0, std=0.0)"


def test_raw_z_2503_anomalous_but_overall_normal(spark):
    rows = [(minutes(i), "denied", 0) for i in range(30)] + [(minutes(30), "denied", 1)]
    std = math.sqrt(30 / 930)
    z_target = 2.503
    min_std = (30 / 31) / z_target
    assert min_std > std
    det = policy.policy_detect(fact(spark, rows), PolicyParams(min_std=min_std))
    d = {r.status: r for r in det.collect()}["denied"]
    assert d.is_anomalous and abs(d.z_raw - 2.503) < 1e-9 and d.z_score == 2.5
    assert d.overall_severity == "NORMAL"
    # Nothing is dispatched for a NORMAL evaluation.
    assert alerts.alert_candidates(det).count() == 0


def test_negative_z_not_anomalous_but_report_critical(spark):
    # 59 stamps at 100, then the two "current" stamps at 0: z = -96.7 / 18.0.
    rows = [(minutes(i), "approved", 100) for i in range(59)]
    rows += [(minutes(59), "approved", 0), (minutes(60), "approved", 0)]
    det = policy.analyze(fact(spark, rows), window=60).collect()
    a = {r.status: r for r in det}["approved"]
    assert a.z_score < -4 and not a.is_anomalous and a.severity == "CRITICAL"


def test_zero_total_rates_null(spark):
    df = fact(spark, [(minutes(0), "approved", 0), (minutes(1), "approved", 3)])
    r = {x.ts: x for x in series.rate_series(df).collect()}
    assert r[minutes(0)].approval_rate is None and r[minutes(1)].approval_rate == 1.0


def test_outage_periods_bridge_two_minutes(spark):
    totals = {0: 1, 1: 50, 2: 0, 3: 40, 4: 40, 5: 3}
    vol = spark.createDataFrame([(minutes(i), v) for i, v in totals.items()], "ts timestamp_ntz, total bigint")
    got = sorted(outages.outage_periods(vol, unit="MINUTE").collect(), key=lambda r: r.start_ts)
    assert [(r.start_ts, r.end_ts, r.duration, r.severity) for r in got] == [
        (minutes(0), minutes(2), 3, "WARNING"), (minutes(5), minutes(5), 1, "INFO")]
    assert got[0].avg_volume == pytest.approx(17.0)


def test_outage_threshold_is_inclusive(spark):
    vol = spark.createDataFrame([(minutes(0), 5), (minutes(10), 6)], "ts timestamp_ntz, total bigint")
    got = outages.outage_periods(vol, unit="MINUTE", params=OutageParams()).collect()
    assert len(got) == 1 and got[0].start_ts == minutes(0)


def _cands(spark, secs, severity="WARNING", status="denied"):
    return spark.createDataFrame([(status, severity, T0 + dt.timedelta(seconds=s)) for s in secs],
                                 "status string, severity string, eval_ts timestamp_ntz")


def test_cooldown_fold(spark):
    out = alerts.cooldown_filter(_cands(spark, [0, 100, 300, 350, 650]), cooldown_seconds=300)
    got = sorted((r.eval_ts - T0).seconds for r in out.collect())
    assert got == [0, 300, 650]


def test_escalation_fires_within_cooldown(spark):
    c = _cands(spark, [0]).unionByName(_cands(spark, [60], severity="CRITICAL"))
    assert alerts.cooldown_filter(c, cooldown_seconds=300).count() == 2


def test_naive_unknown_when_weekly_avg_zero(spark):
    df = spark.createDataFrame([("00h", 3, 0, 0, 0.0, 0.0)],
                               "time string, today bigint, yesterday bigint, same_day_last_week bigint, "
                               "avg_last_week double, avg_last_month double")
    r = checkout.naive_baseline(df).collect()[0]
    assert r.naive_severity == "UNKNOWN" and r.pct_deviation_week is None and not r.is_naive_anomaly


def test_expected_zero_gives_null_pct_deviation(spark):
    df = spark.createDataFrame([("checkout_x", 0, 3, 0, 0, 0.0, 0.0)],
                               "snapshot string, hour int, today bigint, yesterday bigint, "
                               "same_day_last_week bigint, avg_last_week double, avg_last_month double")
    r = checkout.detect_checkout(df, keys=["snapshot"], layers=3).collect()[0]
    assert r.expected == 0.0 and r.pct_deviation is None and not r.is_volume_anomaly


def test_malformed_message_goes_to_dead_letter(spark):
    msgs = spark.createDataFrame([('{"records":[{"timestamp":"2025-07-12T14:00:00","status":"approved","count":3}]}',),
                                  ("not json",)], "value string")
    good, bad = decode_batches(msgs)
    assert good.count() == 1 and [(r.raw, r.reason) for r in bad.collect()] == [("not json", "no records")]


def test_rolling_min_periods_and_floor(spark):
    df = spark.createDataFrame([(minutes(i), 10) for i in range(40)], "ts timestamp_ntz, total bigint")
    r = rolling.rolling_zscore(df, "total", params=RollingParams(min_periods=30)).orderBy("ts").collect()
    assert r[28].rolling_mean is None and r[29].rolling_mean == 10.0 and r[29].rolling_std == 1.0
    assert not any(x.is_anomaly for x in r)


def test_chunked_backtest_equals_unchunked(spark):
    from pulsewatch.sources import adapters as A
    tx = A.transactions(spark, "/root/testdata/sf0.001", unit="HOUR")
    cols = ["eval_ts", "status", "current_value", "z_raw", "n_history", "overall_severity"]
    a = policy.policy_backtest(tx, unit="HOUR", chunk_units=10 ** 9).select(*cols)
    b = policy.policy_backtest(tx, unit="HOUR", chunk_units=24).select(*cols)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_cooldown_with_no_candidates(spark):
    empty = _cands(spark, [0]).limit(0)
    assert alerts.cooldown_filter(empty, cooldown_seconds=300).count() == 0


def test_no_cooldown_fires_all_and_sub_second_stamps_count(spark):
    c = _cands(spark, [0, 0.6, 299.2, 300, 300.1])
    assert alerts.cooldown_filter(c, cooldown_seconds=0).count() == 5
    got = sorted((r.eval_ts - T0).total_seconds() for r in alerts.cooldown_filter(c, cooldown_seconds=300).collect())
    assert got == [0, 300]


def test_equal_stamps_fire_once(spark):
    c = _cands(spark, [0, 0, 0]).unionByName(_cands(spark, [0], severity="CRITICAL"))
    assert alerts.cooldown_filter(c, cooldown_seconds=300).count() == 2


def test_every_series_has_its_own_cooldown(spark):
    rows = [(m, "denied", minutes(i)) for i, m in enumerate(["m1", "m2"])]
    d = spark.createDataFrame([(m, s, t, 9, 1.0, 1.0, 5.0, 5.0, "CRITICAL", True) for m, s, t in rows],
                              "merchant string, status string, eval_ts timestamp_ntz, current_value bigint, baseline_mean double, "
                              "baseline_std double, z_score double, max_z_score double, overall_severity string, is_anomalous boolean")
    assert alerts.dispatch(d, 300).count() == 1
    keyed = alerts.dispatch(d, 300, keys=["merchant"])
    assert sorted(r.merchant for r in keyed.collect()) == ["m1", "m2"]


def test_reports_always_answer(spark):
    none = fact(spark, [])
    r = policy.analyze(none).collect()
    assert len(r) == 1 and r[0].recommendation == policy.NO_DATA and r[0].overall_severity == "NORMAL"
    assert r[0].status is None and r[0].eval_ts is None
    short = fact(spark, [(minutes(i), "approved", 100) for i in range(5)])
    r = policy.analyze(short).collect()
    assert len(r) == 1 and r[0].overall_severity == "NORMAL" and r[0].eval_ts == minutes(4)
    cs = policy.current_status(none).collect()
    assert len(cs) == 1 and cs[0].overall_severity == "NORMAL" and cs[0].max_z_score == 0.0 and cs[0].statuses is None


def test_unmonitored_status_is_rejected(spark):
    hist = fact(spark, [(minutes(i), "denied", 4) for i in range(60)])
    obs = spark.createDataFrame([("refunded", 9), (None, 1)], "status string, cnt bigint")
    for r in policy.evaluate_counts(obs, hist).collect():
        assert r.severity == "INVALID" and not r.is_anomalous and "is not monitored" in r.message


def test_faulty_records_go_to_dead_letter(spark):
    m = '{"records":[{"timestamp":%s,"status":%s,"count":%s}]}'
    msgs = [m % ('"garbage"', '"denied"', 1), m % ('"2025-07-12T14:00:00.250000"', '"denied"', 1),
            m % ('"2025-07-12 14:00:00"', '"denied"', '"2"'), m % ('"2025-07-12T14:00:00"', '"denied"', '"two"'),
            m % ('"2025-07-12T14:00:00"', "null", 1), m % ('"2025-07-12T14:00:00"', '"denied"', "null"),
            m % ('"2025-07-12T14:00:00"', '"denied"', -1), "[]", "{}", "", None]
    good, bad = decode_batches(spark.createDataFrame([(x,) for x in msgs], "value string"))
    assert sorted(r.cnt for r in good.collect()) == [1, 2]
    assert sorted(r.reason for r in bad.collect()) == sorted(
        ["bad timestamp", "bad count", "no status", "bad count", "negative count"] + ["no records"] * 4)


def test_messages_keep_every_record(spark):
    from pulsewatch.sources.messages import encode_batches
    df = fact(spark, [(minutes(0), "denied", 3)] * 5 + [(minutes(0), "approved", 1)])
    good, _ = decode_batches(encode_batches(df, records_per_message=2).withColumnRenamed("message", "value"))
    assert good.count() == 6 and encode_batches(df, records_per_message=2).count() == 3


def test_logs_keep_every_line(spark):
    from pulsewatch.operators.metrics import parse_logs
    lines = ["plain text", '{"message": "no level"}', '{"level": "INFO", "message": "m", "timestamp": 1.5}', "[1]", ""]
    got = {(r.level, r.message) for r in parse_logs(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {(None, "plain text"), (None, "no level"), ("INFO", "m"), (None, "[1]"), (None, "")}


def test_parameter_bounds(spark):
    from pulsewatch.operators import windows
    df = fact(spark, [(minutes(0), "denied", 3)])
    for bad in (0, 1441, 1.5):
        with pytest.raises(ValueError):
            windows.status_summary(df, window=bad)
    with pytest.raises(ValueError):
        windows.recent(df, limit=101)
    with pytest.raises(ValueError):
        policy.analyze(df, window=4)
