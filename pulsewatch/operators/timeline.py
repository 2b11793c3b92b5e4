"""Consolidated anomaly timeline, severity distribution, resampled score,
rule book and recommended thresholds.

The timeline is one wide frame per stamp: the status series (with rates)
left-joined once to the auth-code rates; the three rolling detectors, the
divergence flag and the near-zero flag are columns of it.  The rate detectors
form their frames over non-null rates only (NULL rows sit in their own window
partition), which equals dropping them before the window, without a join back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SEVERITIES, TimelineParams, unit_seconds
from ..functions.columns import as_int, exact_std, flag, flag_list, safe_div
from .quality import stamp_grid
from .rolling import row_frame_chunks, with_rolling


def signal_base(rates: DataFrame, auth: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """The per-stamp inputs of the timeline (status series with rates and the
    auth approval rate), written once with a reliable checkpoint.

    It is one row per stamp, tiny next to the raw tables, and the detectors,
    thresholds and flags all read it: the raw tables are scanned once per
    source instead of once per consumer (the scalar thresholds would
    otherwise re-derive the series from the raw scans)."""
    return rates.join(auth.select(*keys, ts, "auth_approval_rate"), [*keys, ts], "left").checkpoint()


def signal_frame(rates: DataFrame, auth: DataFrame | None, ts: str = "ts",
                 keys: Sequence[str] = (), p: TimelineParams = TimelineParams(),
                 chunk_seconds: int | None = None) -> DataFrame:
    """Per stamp: total, rates, rolling z of each signal, divergence and flags.
    ``auth=None`` when ``rates`` already carries ``auth_approval_rate``
    (see :func:`signal_base`).  ``chunk_seconds`` splits a long series into
    exact time chunks for the three row frames (see
    :func:`pulsewatch.operators.rolling.row_frame_chunks`)."""
    df = rates
    if auth is not None:
        df = df.join(auth.select(*keys, ts, "auth_approval_rate"), [*keys, ts], "left")
    elif "auth_approval_rate" not in df.columns:
        df = df.withColumn("auth_approval_rate", F.lit(None).cast("double"))
    part = list(keys)
    if chunk_seconds:
        df = row_frame_chunks(df, ts, keys, max(p.volume.window, p.rate.window), chunk_seconds,
                              sequences=[None, F.col("approval_rate").isNotNull(),
                                         F.col("error_rate").isNotNull()])
        part.append("_chunk")
    for name, value, prm, exact, skip in (
            ("volume", "total", p.volume, True, False),
            ("approval", "approval_rate", p.rate, False, True),
            ("error", "error_rate", p.rate, False, True)):
        df = with_rolling(df, value, ts, part, prm, exact, skip_nulls_as_rows=skip,
                          mean_col="_m", std_col="_sd")
        df = (df.withColumn(f"{name}_zscore", (F.col(value) - F.col("_m")) / F.col("_sd"))
              .drop("_m", "_sd"))
    if chunk_seconds:
        df = df.filter(~F.col("_copy")).drop("_chunk", "_copy")
    div = F.abs(F.col("approval_rate") - F.col("auth_approval_rate"))
    df = df.withColumn("divergence", div)
    both = F.col("divergence").isNotNull()
    if keys:
        wk = Window.partitionBy(*keys)
        thr = F.avg(F.when(both, F.col("divergence"))).over(wk) + F.lit(p.divergence_sigmas) * \
            F.stddev_samp(F.when(both, F.col("divergence"))).over(wk)
    else:
        thr = df.filter(both).agg(
            F.avg("divergence") + F.lit(p.divergence_sigmas) * F.stddev_samp("divergence")).scalar()
    # One row per stamp, read several times by the timeline consumers (scores,
    # run lengths, thresholds, resampling): written once.
    return (df.withColumn("divergence_threshold", thr)
            .withColumn("volume_anomaly", as_int(F.abs(F.col("volume_zscore")) > p.volume.z_threshold))
            .withColumn("approval_anomaly", as_int(F.abs(F.col("approval_zscore")) > p.rate.z_threshold))
            .withColumn("error_anomaly", as_int(F.abs(F.col("error_zscore")) > p.rate.z_threshold))
            .withColumn("cross_signal_divergent",
                        as_int(F.col("divergence") > F.col("divergence_threshold")))
            .withColumn("near_zero", as_int(F.col("total") <= p.outage.zero_threshold))
            .checkpoint())


def classify(score, near_zero):
    return (F.when(F.col(near_zero) == 1, "CRITICAL").when(F.col(score) >= 3, "CRITICAL")
            .when(F.col(score) >= 2, "WARNING").when(F.col(score) >= 1, "INFO").otherwise("NORMAL"))


def anomaly_timeline(signals: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    score = (F.col("volume_anomaly") + F.col("approval_anomaly") + F.col("error_anomaly")
             + F.col("cross_signal_divergent") + F.lit(2) * F.col("near_zero"))
    triggers = flag_list([(F.col("volume_anomaly") == 1, "VOL"), (F.col("approval_anomaly") == 1, "APR"),
                          (F.col("error_anomaly") == 1, "ERR"), (F.col("cross_signal_divergent") == 1, "XSIG"),
                          (F.col("near_zero") == 1, "OUTAGE")])
    return (signals.withColumn("total_score", score.cast("int"))
            .withColumn("severity", classify("total_score", "near_zero"))
            .withColumn("triggers", triggers)
            .select(*keys, ts, "volume_zscore", "volume_anomaly", "approval_zscore", "approval_anomaly",
                    "error_zscore", "error_anomaly", "cross_signal_divergent", "near_zero",
                    "total_score", "severity", "triggers"))


def severity_distribution(timeline: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count and percent per severity, zero-filled, in one aggregation."""
    aggs = [F.sum((F.col("severity") == s).cast("bigint")).alias(s) for s in SEVERITIES]
    wide = timeline.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("_n"))
    stack = F.explode(F.array(*[F.struct(F.lit(s).alias("severity"),
                                         F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias("cnt"))
                                for s in SEVERITIES])).alias("e")
    return (wide.select(*keys, "_n", stack).select(*keys, "e.severity", "e.cnt", "_n")
            .withColumn("pct", F.lit(100.0) * safe_div("cnt", "_n")).drop("_n"))


def resample_max(timeline: DataFrame, bucket_units: int = 5, unit: str = "MINUTE",
                 value: str = "total_score", ts: str = "ts") -> DataFrame:
    """Max score per bucket of ``bucket_units`` anchored at midnight of the first
    day; empty buckets between the first and last are 0."""
    step = bucket_units * unit_seconds(unit)
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    origin = timeline.agg(F.unix_seconds(F.date_trunc("day", F.min(ts)).cast("timestamp"))).scalar()
    b = origin + F.floor((sec - origin) / F.lit(step)).cast("bigint") * F.lit(step)
    agg = (timeline.select(b.alias("_b"), F.col(value))
           .groupBy("_b").agg(F.max(value).alias("max_score")))
    grid = stamp_grid(agg, "_b", step)
    return (grid.join(agg, "_b", "left")
            .select(F.timestamp_seconds("_b").cast("timestamp_ntz").alias("bucket_start"),
                    F.coalesce("max_score", F.lit(0)).cast("int").alias("max_score")))


def low_run_lengths(df: DataFrame, unit: str, keys: Sequence[str] = (), ts: str = "ts",
                    low_volume: int = 5, chunk_units: int | None = None) -> DataFrame:
    """``low_run_length``: how many consecutive stamps (one unit apart) up to
    and including this one have ``total < low_volume`` (0 when not low).

    Computed from row indices: length = index - index of the last break + 1.
    With ``chunk_units`` one long series is split into time chunks: the
    previous row, the index offset and the last break before a chunk come
    from chunk-level tables (one row per chunk), so the result is exact.
    """
    step = unit_seconds(unit)
    low = F.col("total") < F.lit(low_volume)
    base = df.withColumn("_s", F.unix_seconds(F.col(ts).cast("timestamp"))).withColumn("_low", low)
    part = list(keys)
    if chunk_units:
        base = base.withColumn("_home", F.floor(F.col("_s") / F.lit(chunk_units * step)))
        part.append("_home")
    w = Window.partitionBy(*part).orderBy("_s")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    li = F.row_number().over(w)
    prev_s, prev_low = F.lag("_s").over(w), F.lag("_low").over(w)
    if chunk_units:
        wk = Window.partitionBy(*keys).orderBy("_home")
        chunks = (base.groupBy(*keys, "_home").agg(
            F.count(F.lit(1)).alias("_n"), F.max("_s").alias("_last_s"),
            F.max_by("_low", "_s").alias("_last_low"))
            .withColumn("_prev_s", F.lag("_last_s").over(wk))
            .withColumn("_prev_low", F.lag("_last_low").over(wk))
            .withColumn("_off", F.coalesce(F.sum("_n").over(wk.rowsBetween(Window.unboundedPreceding, -1)),
                                           F.lit(0)))
            .select(*keys, "_home", "_prev_s", "_prev_low", "_off"))
        base = base.join(chunks, [*keys, "_home"])
        first = li == 1
        prev_s = F.when(first, F.col("_prev_s")).otherwise(prev_s)
        prev_low = F.when(first, F.col("_prev_low")).otherwise(prev_low)
        idx = li + F.col("_off")
    else:
        idx = li
    brk = (~F.col("_low") | prev_s.isNull() | (F.col("_s") - prev_s != F.lit(step))
           | ~F.coalesce(prev_low, F.lit(False)))
    m = base.withColumn("_idx", idx).withColumn("_brk", brk)
    last_brk = F.max(F.when(F.col("_brk"), F.col("_idx"))).over(upto)
    m = m.withColumn("_last_brk", last_brk)
    if chunk_units:
        wk = Window.partitionBy(*keys).orderBy("_home")
        carry = (m.groupBy(*keys, "_home").agg(F.max(F.when(F.col("_brk"), F.col("_idx"))).alias("_cb"))
                 .withColumn("_carry_brk", F.max("_cb").over(wk.rowsBetween(Window.unboundedPreceding, -1)))
                 .select(*keys, "_home", "_carry_brk"))
        m = (m.join(carry, [*keys, "_home"])
             .withColumn("_last_brk", F.coalesce(F.col("_last_brk"), F.col("_carry_brk"))))
    length = F.when(F.col("_low"), F.col("_idx") - F.col("_last_brk") + 1).otherwise(F.lit(0)).cast("bigint")
    return m.withColumn("low_run_length", length).drop(
        "_s", "_low", "_home", "_prev_s", "_prev_low", "_off", "_idx", "_brk", "_last_brk", "_carry_brk")


def rule_book(signals: DataFrame, unit: str = "MINUTE", keys: Sequence[str] = (), ts: str = "ts",
              low_volume: int = 5, low_run: int = 5, volume_z: float = 3.0, rate_z: float = 2.5,
              sigmas: float = 3.0, chunk_units: int | None = None) -> DataFrame:
    """The written alerting policy applied per stamp.

    CRITICAL: volume < ``low_volume`` for ``low_run`` consecutive stamps, or
    approval rate below max(0, mean - 3 std).  WARNING: abs(volume z) > 3,
    approval z < -2.5, error z > 2.5, or divergence above its threshold.
    """
    df = low_run_lengths(signals, unit, keys, ts, low_volume, chunk_units)
    if keys:
        wk = Window.partitionBy(*keys)
        floor_ = F.greatest(F.lit(0.0), F.avg("approval_rate").over(wk)
                            - F.lit(sigmas) * F.stddev_samp("approval_rate").over(wk))
    else:
        floor_ = signals.agg(F.greatest(F.lit(0.0), F.avg("approval_rate")
                                        - F.lit(sigmas) * F.stddev_samp("approval_rate"))).scalar()
    r = {
        "volume_outage": flag(F.col("low_run_length") >= low_run),
        "approval_floor": flag(F.col("approval_rate") < floor_),
        "volume_z": flag(F.abs(F.col("volume_zscore")) > volume_z),
        "approval_drop": flag(F.col("approval_zscore") < -rate_z),
        "error_rise": flag(F.col("error_zscore") > rate_z),
        "divergence": flag(F.col("divergence") > F.col("divergence_threshold")),
    }
    for k, v in r.items():
        df = df.withColumn(k, v)
    crit = F.col("volume_outage") | F.col("approval_floor")
    warn = F.col("volume_z") | F.col("approval_drop") | F.col("error_rise") | F.col("divergence")
    sev = F.when(crit, "CRITICAL").when(warn, "WARNING").otherwise("NORMAL")
    fired = flag_list([(F.col(k), k) for k in r])
    return df.select(*keys, ts, "low_run_length", *r.keys(), sev.alias("severity"), fired.alias("rules"))


def recommended_thresholds(signals: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Global mean/std of volume and rates with derived alert thresholds."""
    n = F.count("total")
    s1 = F.sum("total")
    s2 = F.sum(F.col("total").cast("decimal(38,0)") * F.col("total").cast("decimal(38,0)"))
    both = F.col("divergence").isNotNull()
    g = signals.agg(
        (s1.cast("double") / n.cast("double")).alias("vol_mean"),
        exact_std(n, s1, s2).alias("vol_std"),
        F.avg("approval_rate").alias("apr_mean"), F.stddev_samp("approval_rate").alias("apr_std"),
        F.avg("error_rate").alias("err_mean"), F.stddev_samp("error_rate").alias("err_std"),
        (F.avg(F.when(both, F.col("divergence")))
         + F.lit(sigmas) * F.stddev_samp(F.when(both, F.col("divergence")))).alias("divergence_threshold"))
    k = F.lit(sigmas)
    return g.select(
        "vol_mean", "vol_std",
        F.greatest(F.lit(0.0), F.col("vol_mean") - k * F.col("vol_std")).alias("vol_lower"),
        (F.col("vol_mean") + k * F.col("vol_std")).alias("vol_upper"),
        "apr_mean", "apr_std",
        F.greatest(F.lit(0.0), F.col("apr_mean") - k * F.col("apr_std")).alias("apr_critical"),
        "err_mean", "err_std", "divergence_threshold")
