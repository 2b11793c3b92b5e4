"""Quantiles, period averages, completeness and keyed reports against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsewatch.operators import completeness, quality, quantiles, ranges, series, windows

T0 = dt.datetime(2025, 1, 1)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_exact_quantiles(spark, parts):
    r = random.Random(parts)
    rows = [("a", float(r.randint(0, 9))) for _ in range(500)]          # many ties
    rows += [("b", r.random()) for _ in range(301)] + [("c", 4.5), ("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {x.k: (x.n, x.q) for x in quantiles.exact_quantiles(df, "v", probs, ["k"], parts).collect()}
    assert got.keys() == {"a", "b", "c"}
    for k, (n, q) in got.items():
        vals = [v for g, v in rows if g == k and v is not None]
        assert n == len(vals) and np.allclose(q, np.quantile(vals, probs), rtol=1e-12, atol=1e-12)
    one = quantiles.exact_quantiles(df, "v", [0.5], parts=parts).collect()
    assert len(one) == 1 and one[0].q[0] == pytest.approx(float(np.median([v for _, v in rows if v is not None])))
    assert quantiles.exact_quantiles(df.limit(0), "v", [0.5], ["k"], parts).collect() == []


def test_no_task_holds_a_group_of_values(spark):
    """The ranges split a group that has nearly all values."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.rand(3).alias("v"))
    ranged = df.groupBy("k", "v").count().repartitionByRange(8, "k", "v").withColumn("p", F.spark_partition_id())
    assert max(r["count"] for r in ranged.groupBy("p").count().collect()) < 6_000
    q = quantiles.exact_quantiles(df, "v", [0.5], ["k"], 8).first().q[0]
    assert abs(q - 0.5) < 0.02


def test_describe_of_a_metric_without_values(spark):
    df = spark.createDataFrame([(1, None), (3, None)], "a long, b double")
    got = {r.metric: r for r in series.describe(df, ["a", "b"]).collect()}
    assert (got["a"].n, got["a"].p50) == (2, 2.0) and (got["b"].n, got["b"].p50, got["b"].mean) == (0, None, None)


def test_merged_sketches_stay_within_their_error(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 30).alias("day"), F.rand(5).alias("v"))
    merged = quantiles.merge_sketches(quantiles.sketch(df, "v", ["k", "day"]), ["k"])
    for r in quantiles.sketch_quantiles(merged, (0.25, 0.5, 0.75), ["k"]).collect():
        vals = np.array([x.v for x in df.where(F.col("k") == r.k).collect()])
        assert r.n == len(vals)
        assert all(abs((vals < q).mean() - p) < 0.03 for q, p in zip(r.q, (0.25, 0.5, 0.75)))


@pytest.mark.parametrize("radix,levels", [(2, 12), (3, 4), (16, 3), (10, 1)])
def test_period_averages(spark, radix, levels):
    r = random.Random(radix)
    hours = sorted(r.sample(range(-700, 700), 600))
    rows = [(k, T0 + dt.timedelta(hours=h), r.randint(0, 50)) for k in (1, 2) for h in hours if r.random() < 0.9]
    spans = []
    for i in range(150):
        a, n = r.randint(-800, 800), r.choice([0, 1, 5, 40, 300, 1500])
        spans.append((i, r.choice([1, 2, 3]), T0 + dt.timedelta(hours=a, minutes=r.randint(0, 59)), T0 + dt.timedelta(hours=a + n)))
    spans += [(900, 1, T0, T0 - dt.timedelta(hours=9)), (901, 1, None, T0), (902, 1, T0, None), spans[0]]
    s = spark.createDataFrame(rows, "k int, ts timestamp_ntz, total long")
    p = spark.createDataFrame(spans, "i int, k int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    df = ranges.range_averages(s, p, "HOUR", keys=["k"], radix=radix, levels=levels)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    floor = lambda t: t.replace(minute=0) if t else None
    want = []
    for i, k, a, b in spans:
        held = [v for g, t, v in rows if g == k and a and b and floor(a) <= t <= floor(b)]
        want.append((i, len(held), sum(held) if held else None, sum(held) / len(held) if held else None))
    got = [(x.i, x.n_stamps, x.sum_volume, x.avg_volume) for x in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_completeness_and_missing_stamps(spark):
    r = random.Random(4)
    held = {"a": sorted(r.sample(range(5_000), 3_000)), "b": [7], "c": [0, 70_000], "d": [-40_000, -39_999, 3]}
    rows = [(k, T0 + dt.timedelta(minutes=m), 1) for k, ms in held.items() for m in ms for _ in range(1 + m % 2)] + [("a", None, 1)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, cnt long").repartition(4)
    got = {x.k: (x.n_expected, x.n_present, x.n_missing, x.min_ts, x.max_ts) for x in completeness.completeness(df, "MINUTE", ["k"]).collect()}
    at = lambda m: T0 + dt.timedelta(minutes=m)
    assert got == {k: (ms[-1] - ms[0] + 1, len(ms), ms[-1] - ms[0] + 1 - len(ms), at(ms[0]), at(ms[-1])) for k, ms in held.items()}
    gaps = {(x.k, x.ts) for x in quality.missing_stamps(df, "MINUTE", keys=["k"]).collect()}
    assert gaps == {(k, at(m)) for k, ms in held.items() for m in set(range(ms[0], ms[-1])) - set(ms)}
    plain = quality.missing_stamps(df.where("k = 'a'"), "MINUTE")
    assert plain.count() == len(set(range(held["a"][0], held["a"][-1])) - set(held["a"]))
    assert quality.missing_stamps(df.limit(0), "MINUTE").collect() == [] and completeness.completeness(df.limit(0)).collect() == []


def test_quality_frame_without_keys(spark):
    tx = spark.createDataFrame([(T0, "a", 1), (T0, "a", -2), (T0 + dt.timedelta(hours=3), None, 5)], "ts timestamp_ntz, status string, cnt long")
    au = spark.createDataFrame([(T0, "00", -1)], "ts timestamp_ntz, auth_code string, cnt long")
    totals = lambda df: df.withColumnRenamed("cnt", "total")
    got = {(r.dataset, r.measure): r.value for r in completeness.quality_frame(
        [("tx", tx, ["ts", "status"], "status"), ("au", au, ["ts"], "auth_code")], ("tx - au", totals(tx), totals(au))).collect()}
    assert {m: v for (d, m), v in got.items() if d == "tx"} == {
        "rows": 3, "null_cells": 1, "negative_values": 1, "categories": 1, "repeated_rows": 1, "stamps": 2, "missing_stamps": 2}
    assert got["au", "missing_stamps"] == 0 and got["tx - au", "n_mismatch"] == 1 and got["tx - au", "left_total"] == 4


def test_recent_records_of_a_hot_key_are_cut_before_the_shuffle(spark):
    df = spark.range(10_000).select((F.col("id") % 100 == 0).cast("int").alias("k"), F.col("id").alias("ingested_at"), F.lit(0).alias("ingest_seq"))
    got = windows.recent(df, 3, keys=["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # once before the exchange, once after
    assert sorted((r.k, r.ingested_at) for r in got.collect()) == [(0, 9997), (0, 9998), (0, 9999), (1, 9700), (1, 9800), (1, 9900)]


def test_each_series_has_its_own_approval_code(spark):
    rows = [(1, "00", 5), (1, "0", 9), (2, "0", 1), (2, "07", 9), (3, "07", 4), (3, "05", 4)]
    auth = spark.createDataFrame([(k, T0, c, n) for k, c, n in rows], "k int, ts timestamp_ntz, auth_code string, cnt long")
    got = {r.k: (r.approval_code, r.approved_cnt) for r in series.auth_rates(auth, ["k"]).collect()}
    assert got == {1: ("00", 5), 2: ("0", 1), 3: ("05", 4)}
    top = [(r.k, r.auth_code) for r in series.top_codes(auth, 1, keys=["k"]).orderBy("k").collect()]
    assert top == [(1, "0"), (2, "07"), (3, "05")]
