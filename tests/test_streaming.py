"""Streams equal their batch twins; keyed cooldown state equals the fold."""

import datetime as dt
import json
import random
import statistics
import tempfile

from pyspark.sql import functions as F

from pulsewatch.operators import alerts, outages, series, tracing
from pulsewatch.sources import adapters as A
from pulsewatch.sources.messages import decode_batches
from pulsewatch.streaming import facts, late, monitor, progress, state

from .conftest import SMOKE

T0 = dt.datetime(2025, 7, 12)


def _base():
    return tempfile.mkdtemp(prefix="pw-stream-", dir="/tmp")


def test_stream_ingest_equals_batch(spark):
    b = _base()
    tx = A.transactions(spark, SMOKE, unit="MINUTE")
    monitor.write_messages(tx, f"{b}/src")
    # one malformed message next to the good ones
    spark.createDataFrame([("{oops",), ('{"records":[{"timestamp":"garbage","status":"x","count":1}]}',)], "value string").write.mode("append").text(f"{b}/src")
    monitor.ingest(spark, f"{b}/src", f"{b}/out", f"{b}/dead", f"{b}/ck").awaitTermination()
    got = spark.read.parquet(f"{b}/out").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "cnt")
    assert got.exceptAll(tx).count() == 0 and tx.exceptAll(got).count() == 0
    assert spark.read.parquet(f"{b}/dead").count() == 2


def test_windowed_counts_equal_batch(spark):
    b = _base()
    monitor.write_messages(A.transactions(spark, SMOKE, unit="MINUTE"), f"{b}/src", flush_seconds=7200)
    monitor.run_windowed_counts(spark, f"{b}/src", f"{b}/out", f"{b}/ck").awaitTermination()
    got = spark.read.parquet(f"{b}/out")
    hourly = series.wide(A.transactions(spark, SMOKE, unit="HOUR"))
    exp = hourly
    assert got.select(*exp.columns).exceptAll(exp).count() == 0
    assert exp.exceptAll(got.select(*exp.columns)).count() == 0


def _run(df, base):
    monitor.run_to_parquet(df, f"{base}/out", f"{base}/ck").awaitTermination()


def test_cooldown_state_of_shuffled_batches_equals_batch(spark):
    """Rows come out of order across four micro-batches, with ties; idle keys are forgotten."""
    b, r = _base(), random.Random(1)
    rows = [(r.choice("ab"), r.choice("xy"), T0 + dt.timedelta(seconds=r.randint(0, 5000)), r.random(), "kept") for _ in range(400)]
    rows += rows[:20]
    order = sorted(range(len(rows)), key=lambda i: rows[i][2].timestamp() + r.randint(0, 600))
    schema = "status string, severity string, alert_ts timestamp, z_score double, note string"
    for k in range(4):
        part = [rows[i] for i in order[k * 105:(k + 1) * 105]]
        if k == 3:
            part.append(("end", "end", T0 + dt.timedelta(days=1), 0.0, None))
        spark.createDataFrame(part, schema).repartition(3).write.parquet(f"{b}/in/{k}")
        _run(state.cooldown_stream(spark.readStream.schema(schema).parquet(f"{b}/in/*"), 300, delay="30 minutes"), b)
    got = sorted((x.status, x.severity, x.alert_ts, x.z_score, x.note) for x in spark.read.parquet(f"{b}/out").collect())
    batch = alerts.cooldown_filter(spark.createDataFrame(rows, schema).withColumnRenamed("alert_ts", "eval_ts"), cooldown_seconds=300)
    assert [x[:3] for x in got] == sorted((x.status, x.severity, x.eval_ts) for x in batch.collect()) and len(got) > 20
    assert {x[4] for x in got} == {"kept"}


def _records(seed=2):
    r = random.Random(seed)
    return [(s, T0 + dt.timedelta(hours=h, minutes=r.randint(0, 59)), r.choice(["denied", "approved", "other"]), r.choice([0, 1, 2, 9, 30]))
            for h in range(200) if h % 90 < 25 for s in (1, 2, 3) for _ in range(2) if r.random() < 0.8]


RECORDS = "shop int, ts timestamp, status string, cnt bigint"


def _keyed(spark, b, build):
    rec = _records()
    for k in (0, 1):
        part = [x for x in rec if (x[1] >= T0 + dt.timedelta(hours=100)) == bool(k)]
        if k:
            part.append((99, T0 + dt.timedelta(hours=212), "heartbeat", 0))
        spark.createDataFrame(part, RECORDS).repartition(3).write.parquet(f"{b}/in/{k}")
        _run(build(spark.readStream.schema(RECORDS).parquet(f"{b}/in/*")), b)
    hourly = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return spark.createDataFrame(rec, RECORDS).withColumn("ts", hourly), spark.read.parquet(f"{b}/out")


def test_keyed_outages_equal_batch_per_key(spark):
    tx, events = _keyed(spark, _base(), lambda src: state.outage_events(src, keys=["shop"]))
    got = state.current_periods(events, ["shop"])
    assert {r.state for r in got.collect()} == {"closed"}
    exp = outages.outage_periods(series.volume_per_stamp(tx, ["shop"]), unit="HOUR", keys=["shop"])
    cols = got.drop("state").columns
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, exp.select(*cols).collect()))


def test_open_periods_are_reported_as_they_grow(spark):
    b = _base()
    for k, rows in enumerate([[(0, 1), (1, 2)], [(2, 0), (3, 50)], [(4, 3), (9, 80)]]):
        spark.createDataFrame([(1, T0 + dt.timedelta(hours=h), "denied", n) for h, n in rows], RECORDS).coalesce(1).write.parquet(f"{b}/in/{k}")
        _run(state.outage_events(spark.readStream.schema(RECORDS).parquet(f"{b}/in/*"), keys=["shop"]), b)
    got = [(r.state, r.duration, r.outage_stamps) for r in spark.read.parquet(f"{b}/out").orderBy("duration", F.col("state") == "closed").collect()]
    assert got == [("open", 2, 2), ("grown", 5, 4), ("closed", 5, 4)]


def test_rolling_baseline_equals_windows_per_key(spark):
    tx, out = _keyed(spark, _base(), lambda src: state.rolling_baseline(src, history_units=30, keys=["shop"], statuses=["denied", "approved"]))
    units = {}
    for r in tx.collect():
        u = units.setdefault((r.shop, r.ts), {"denied": 0, "approved": 0})
        if r.status in u:
            u[r.status] += r.cnt
    want = {}
    for shop in (1, 2, 3):
        mine = {t: u for (s, t), u in units.items() if s == shop}
        at = min(mine)
        while at <= max(mine):
            held = [u for t, u in mine.items() if at - dt.timedelta(hours=30) <= t <= at]
            if held:
                vals = {s: [u[s] for u in held] for s in ("denied", "approved")}
                want[shop, at] = [len(held)] + [x for s in vals for x in (
                    statistics.fmean(vals[s]), statistics.stdev(vals[s]) if len(held) > 1 else None)]
            at += dt.timedelta(hours=1)
    got = {(r.shop, r.ts): list(r)[2:] for r in out.where("shop < 99").collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(got[k], v)), (k, got[k], v)


def test_late_records_correct_their_window_or_are_put_aside(spark):
    b = _base()
    message = lambda t, n: json.dumps({"records": [{"timestamp": t.isoformat(), "status": "denied", "count": n}]})
    hour = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    batches = [[(hour(0), 1), (hour(10), 2), (hour(30), 3)],
               [(hour(0, 5), 10), (hour(10, 5), 20), (hour(31), 4)],  # hour 0 is beyond a day late
               [(hour(12), 7), (hour(10, 9), 100)],                    # a window that had none, one corrected again
               [(hour(40), 0)]]
    for rows in batches:
        spark.createDataFrame([(message(t, n),) for t, n in rows], "value string").write.mode("append").text(f"{b}/src")
        late.late_counts(spark, monitor.read_messages(spark, f"{b}/src"), f"{b}/out", f"{b}/ck").awaitTermination()
    got = {r.ts: (r.denied, r.records, r.late_records, r.corrections) for r in late.current_windows(spark, f"{b}/out").collect()}
    assert got == {hour(0): (1, 1, 0, 0), hour(10): (122, 3, 2, 2), hour(12): (7, 1, 1, 1), hour(30): (3, 1, 0, 0), hour(31): (4, 1, 0, 0)}
    assert [(r.cnt, r.ts) for r in late.late_records(spark, f"{b}/out", "dropped").collect()] == [(10, hour(0, 5))]
    assert sorted(r.cnt for r in late.late_records(spark, f"{b}/out").collect()) == [7, 20, 100]


def test_fact_folders_are_replaced_and_merged(spark):
    b = _base()
    day, schema = T0.date(), "ts timestamp, v int"
    for n in range(5):
        rows = [(T0 + dt.timedelta(hours=n), n), (T0 + dt.timedelta(days=1), n)]
        for _ in range(2 if n == 3 else 1):  # a batch that runs again
            facts.put(spark.createDataFrame(rows, schema), f"{b}/f", n)
    read = lambda *days: sorted((r.v, r.batch_id) for r in facts.read(spark, f"{b}/f", schema, days).collect())
    every = [(n, n) for n in range(5)]
    assert read(day) == every and read(day, day + dt.timedelta(days=1)) == sorted(every * 2) and read(day - dt.timedelta(days=1)) == []
    assert not facts.compact(spark, f"{b}/f", schema, day, 3, most=4)
    assert facts.compact(spark, f"{b}/f", schema, day, 3, most=2) and read(day) == every
    assert facts._numbers(spark, f"{b}/f/live/date={day}", "batch_id") == [4]
    facts.put(spark.createDataFrame([(T0, 9)], schema), f"{b}/f", 2)  # left over from a job that was lost
    assert read(day) == every
    for n in (5, 6, 7):
        facts.put(spark.createDataFrame([(T0, n)], schema), f"{b}/f", n)
    assert facts.compact(spark, f"{b}/f", schema, day, 6, most=1) and read(day) == [(n, n) for n in range(8)]
    assert facts._numbers(spark, f"{b}/f/compact/date={day}", "upto") == [6]
    assert facts.last_day(spark, f"{b}/f") == day + dt.timedelta(days=1)


def test_traces_link_once_in_batch_and_stream(spark):
    b = _base()
    s = lambda n: T0 + dt.timedelta(seconds=n)
    produced = [("t1", "s1", s(0)), ("t1", "s1", s(5)), ("t2", "s2", s(10)), (None, None, s(11)), ("t3", "s3", s(12))]
    consumed = [(1, "t1", "s1", s(3)), (2, "t1", "s1", s(70)), (3, "t2", "s2", s(9)), (4, None, None, s(20)), (5, "t9", "s9", s(21)),
                (6, "t3", "s3", s(12)), (7, "t3", "s3", s(72))]
    p = spark.createDataFrame(produced, "trace_id string, span_id string, ts timestamp")
    c = spark.createDataFrame(consumed, "consumer_id int, producer_trace_id string, producer_span_id string, ts timestamp")
    want = [(1, "linked", 3.0), (2, "no producer", None), (3, "no producer", None), (4, "no producer", None), (5, "no producer", None),
            (6, "linked", 0.0), (7, "linked", 60.0), (None, "no consumer", None), (None, "no consumer", None)]
    key = lambda r: (r[0] is None, r[0] or 0)
    got = tracing.link_traces(p, c, 60).collect()
    assert sorted(((r.consumer_id, r.link, r.latency) for r in got), key=key) == want
    assert sorted(r.trace_id or "" for r in got if r.link == "no consumer") == ["", "t2"]
    end = [("x", "x", s(9000))]
    p.union(spark.createDataFrame(end, p.schema)).write.parquet(f"{b}/p")
    c.union(spark.createDataFrame([(0, "y", "y", s(9000))], c.schema)).write.parquet(f"{b}/c")
    src = {n: spark.readStream.schema(df.schema).parquet(f"{b}/{n}") for n, df in (("p", p), ("c", c))}
    _run(tracing.link_stream(src["p"], src["c"], 60), b)
    streamed = [(r.consumer_id, r.link) for r in spark.read.parquet(f"{b}/out").collect()]
    # Which of two records with one span comes first is not told apart by a stream; ids are.
    assert sorted(streamed, key=key)[1:] == [w[:2] for w in want][1:] and len(streamed) == len(want)


def test_trace_stream_holds_buckets_not_rows(spark):
    """Two micro-batches with ids in both, repeats, records without ids or stamp: the links of
    the batch operator, from a state of a row per bucket."""
    b = _base()
    s = lambda n: T0 + dt.timedelta(seconds=n)
    halves = ([], []), ([], [])
    for i in range(600):
        k = i // 300
        halves[k][0].append((f"t{i}", f"s{i}", s(20 * i)))
        if i % 7 == 0:  # an at-least-once producer
            halves[k][0].append((f"t{i}", f"s{i}", s(20 * i + 1)))
        for j in range(i % 4):
            at = s(20 * i + 40 * j) if i < 597 else s(20 * i)
            halves[int(at >= s(6000))][1].append((10 * i + j, f"t{i}", f"s{i}", at))
        halves[k][1].append((10 * i + 9, None, None, s(20 * i)))
    halves[1][0].append((None, None, s(7000)))
    halves[1][1].extend([(8001, "t7", None, s(7000)), (8002, "t7", "s7", None), (None, "t8", "s8", s(7000))])
    ps, cs = "trace_id string, span_id string, ts timestamp", "consumer_id bigint, producer_trace_id string, producer_span_id string, ts timestamp"
    held = []
    for k, (p, c) in enumerate(halves):
        end = [("x", "x", s(90000))], [(-1, "y", "y", s(90000))]
        spark.createDataFrame(p + (end[0] if k else []), ps).write.mode("append").parquet(f"{b}/p")
        spark.createDataFrame(c + (end[1] if k else []), cs).write.mode("append").parquet(f"{b}/c")
        src = [spark.readStream.schema(spark.read.parquet(f"{b}/{n}").schema).parquet(f"{b}/{n}") for n in ("p", "c")]
        q = monitor.run_to_parquet(tracing.link_stream(*src, 60, buckets=16), f"{b}/out", f"{b}/ck")
        q.awaitTermination()
        held += [sum(o["numRowsTotal"] for o in r["stateOperators"]) for r in q.recentProgress]
    assert max(held) <= 16
    batch = tracing.link_traces(spark.createDataFrame(halves[0][0] + halves[1][0], ps), spark.createDataFrame(halves[0][1] + halves[1][1], cs), 60)
    want = sorted(map(tuple, batch.collect()), key=repr)
    assert sorted(map(tuple, spark.read.parquet(f"{b}/out").collect()), key=repr) == want
    assert {r[-1] for r in want} == {"linked", "no producer", "no consumer"}


def test_trace_headers_of_several_keys(spark):
    tp = b"00-" + b"a" * 32 + b"-" + b"b" * 16 + b"-01"
    rows = [(0, [("k", b"v"), ("traceparent", tp)]), (1, [("k", None), ("k", b"v"), ("traceparent", tp)]), (2, [("traceparent", None)]),
            (3, [("traceparent", None), ("traceparent", tp)]), (4, [("traceparent", tp + b"\n")]), (5, [("k", tp)]), (6, None), (7, [(None, None), ("traceparent", tp)])]
    df = spark.createDataFrame(rows, "i int, headers array<struct<key:string, value:binary>>")
    got = {r.i: r.trace_id for r in tracing.with_trace(df).collect()}
    assert got == {i: "a" * 32 if i in (0, 1, 3, 7) else None for i in range(8)}


def test_trace_headers_without_ids_are_no_links(spark):
    tp = ["00-" + "a" * 32 + "-" + "b" * 16 + "-01", "00-" + "0" * 32 + "-" + "b" * 16 + "-01", "00-xyz-1-01", None]
    rows = [(i, [("traceparent", t.encode() if t else None)]) for i, t in enumerate(tp)] + [(9, [])]
    df = spark.createDataFrame(rows, "i int, headers array<struct<key:string, value:binary>>")
    got = {r.i: (r.trace_id, r.span_id) for r in tracing.with_trace(df).collect()}
    assert got == {0: ("a" * 32, "b" * 16), 1: (None, None), 2: (None, None), 3: (None, None), 9: (None, None)}


def test_progress_rows_add_up(spark):
    from pulsewatch.sources import messages

    b = _base()
    tx = A.transactions(spark, SMOKE, unit="MINUTE").checkpoint()
    listener = progress.ProgressTable(spark, f"{b}/progress")
    spark.streams.addListener(listener)
    try:
        part = F.pmod(F.xxhash64("ts"), F.lit(3))

        def run():
            good, _ = messages.decode_batches(monitor.read_messages(spark, f"{b}/src"))
            q = monitor.run_to_parquet(progress.observed(good), f"{b}/out", f"{b}/ck")
            listener.wait(q)
            return q

        monitor.replay(tx, f"{b}/src", part, run)
    finally:
        spark.streams.removeListener(listener)
    rows = progress.read_progress(spark, f"{b}/progress")
    assert rows.count() == 3
    totals = {r.metric: r.total for r in progress.running_counters(rows).collect()}
    exp = tx.agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("c"), F.sum(F.when(F.col("status") == "denied", F.col("cnt"))).alias("d")).first()
    assert (totals["records"], totals["cnt"], totals["denied"]) == (exp.n, exp.c, exp.d)
    hist = {(r.operation, r.le): r for r in progress.running_durations(rows).collect()}
    assert hist["consume", "+Inf"].bucket_count == 3 and hist["insert", "+Inf"].sum > 0


def test_alert_check_stream_matches_batch_detector(spark):
    from pulsewatch.config import PolicyParams
    from pulsewatch.operators import policy

    b = _base()
    tx = A.transactions(spark, SMOKE, unit="HOUR").checkpoint()
    mid = tx.select(F.expr("min(ts) + (max(ts) - min(ts)) / 2")).collect()[0][0]
    monitor.replay(tx, f"{b}/src", F.when(F.col("ts") > F.lit(mid), 1).otherwise(0), lambda: monitor.alert_check(
        spark, f"{b}/src", f"{b}/out", f"{b}/ck", params=PolicyParams(), unit="HOUR"))
    got = spark.read.parquet(f"{b}/out/details")
    assert got.select("batch_id").distinct().count() == 2
    cols = ["eval_ts", "status", "current_value", "z_score", "overall_severity"]
    exp = policy.policy_detect(tx, PolicyParams(), unit="HOUR").unionByName(
        policy.policy_detect(tx.filter(F.col("ts") <= F.lit(mid)), PolicyParams(), unit="HOUR"))
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, exp.select(*cols).collect()))
    assert spark.read.parquet(f"{b}/out/facts/live").count() == tx.count()


def test_alert_cooldown_is_carried_across_batches(spark):
    from pulsewatch.config import PolicyParams

    b = _base()
    calm = [(T0 + dt.timedelta(minutes=i), "denied", 2) for i in range(40)]
    loud = [(T0 + dt.timedelta(minutes=40 + i), "denied", 500 * (i + 1) ** 2) for i in range(8)]
    tx = spark.createDataFrame(calm + loud, "ts timestamp_ntz, status string, cnt bigint")
    part = F.greatest(F.lit(0), (F.unix_seconds(F.col("ts").cast("timestamp"))
                                 - F.lit(int(T0.replace(tzinfo=dt.timezone.utc).timestamp()))) / 60 - 39).cast("int")
    check = lambda: monitor.alert_check(spark, f"{b}/src", f"{b}/out", f"{b}/ck", params=PolicyParams(), unit="MINUTE",
                                        cooldown_seconds=180)
    monitor.replay(tx, f"{b}/src", part, check)
    spark.createDataFrame([('{"records":[{"timestamp":"poison","status":"denied","count":1}]}',)], "value string") \
        .coalesce(1).write.mode("append").text(f"{b}/src")
    check().awaitTermination()
    crit = spark.read.parquet(f"{b}/out/details").filter("is_anomalous and z_score > 4").select("eval_ts").distinct()
    stamps = sorted(r.eval_ts for r in crit.collect())
    want, last = [], None
    for t in stamps:
        if last is None or (t - last).total_seconds() >= 180:
            want.append(t)
            last = t
    fired = monitor.read_output(spark, f"{b}/out", "alerts").filter("severity = 'CRITICAL'")
    assert sorted(r.alert_ts for r in fired.collect()) == want and 1 < len(want) < len(stamps)
    assert monitor.read_output(spark, f"{b}/out", "outbox").count() == len(want)
    assert monitor.read_output(spark, f"{b}/out", "log").filter("level = 'CRITICAL'").count() == len(want)
    assert monitor.read_output(spark, f"{b}/out", "gauges").filter("status = 'overall'").count() >= len(stamps)
    assert spark.read.parquet(f"{b}/out/dead").collect()[0].reason == "bad timestamp"


def test_ingest_counters_per_batch(spark):
    b = _base()
    tx = A.transactions(spark, SMOKE, unit="MINUTE")
    monitor.write_messages(tx, f"{b}/src")
    monitor.ingest(spark, f"{b}/src", f"{b}/out", f"{b}/dead", f"{b}/ck").awaitTermination()
    c = spark.read.parquet(f"{b}/out_counters").groupBy("status").agg(F.sum("cnt").alias("c")).collect()
    exp = {r.status: r.c for r in tx.groupBy("status").agg(F.sum("cnt").alias("c")).collect()}
    assert {r.status: r.c for r in c} == exp


def test_windowed_counts_drop_replayed_records(spark):
    b = _base()
    tx = A.transactions(spark, SMOKE, unit="MINUTE")
    monitor.write_messages(tx, f"{b}/src")
    again = spark.read.text(f"{b}/src").limit(50).collect()  # some messages come again
    spark.createDataFrame(again, "value string").write.mode("append").text(f"{b}/src")
    monitor.run_windowed_counts(spark, f"{b}/src", f"{b}/out", f"{b}/ck", delay="2 hours",
                                dedupe=True).awaitTermination()
    got = spark.read.parquet(f"{b}/out")
    exp = series.wide(A.transactions(spark, SMOKE, unit="HOUR"))
    # every released window equals the batch counts (replayed records not double counted)
    joined = got.join(exp.select("ts", F.col("total").alias("t2")), "ts")
    assert joined.count() > 100
    assert joined.filter(F.col("total") != F.col("t2")).count() == 0


def test_outage_sessions_bridge_like_the_batch_periods(spark):
    b = _base()
    totals = {0: 1, 1: 50, 2: 0, 3: 40, 4: 40, 5: 3, 9: 2, 10: 1, 11: 5, 12: 0, 13: 4, 14: 60}
    rows = [(T0 + dt.timedelta(hours=h), "denied", n) for h, n in totals.items()]
    tx = spark.createDataFrame(rows, "ts timestamp_ntz, status string, cnt bigint")
    monitor.write_messages(tx, f"{b}/src", flush_seconds=5 * 3600)
    good, _ = decode_batches(monitor.read_messages(spark, f"{b}/src"))
    _run(state.outage_events(good), b)
    periods = state.current_periods(spark.read.parquet(f"{b}/out")).drop("state")
    got = sorted(periods.collect(), key=lambda r: r.start_ts)
    exp = outages.outage_periods(series.volume_per_stamp(tx), unit="HOUR").select(*periods.columns)
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted(exp.collect(), key=lambda r: r.start_ts)]
    assert [(r.duration, r.severity) for r in got] == [(3, "WARNING"), (1, "INFO"), (5, "CRITICAL")]
