"""Per-status policy z-score detector, its backtest, single-observation
evaluation (as a table), the analysis report and the current status.

Rules (parameters in :class:`pulsewatch.config.PolicyParams`):

* history: every stamp in ``[anchor - history_window, anchor]`` with any
  status; a status absent at a stamp counts 0; ``n_history`` = stamps.
* current: per-status sum over ``[anchor - current_window, anchor]``.
* ``z = (current - mean) / max(std, min_std)``, sample std (0 when n < 2).
* one-sided: ``is_anomalous = z > z_score_threshold`` on the unrounded z.
* overall severity from the 2-decimal z with strict ``>`` at the critical and
  warning thresholds; fewer than ``min_history`` stamps -> NORMAL, no details.

Everything is computed in the wide form (one row per evaluation stamp, one
column group per status), so the per-status stats, the overall severity and
the recommendation come from one aggregation (or one window pass for the
backtest) without a join or a second shuffle; the details are then unpivoted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MONITORED_STATUSES, PROBLEM_STATUSES, PolicyParams, check_range, unit_seconds
from ..functions.columns import exact_std, fmt1, round_half_up, sum_sq
from .series import wide
from .windows import latest_stamp, trailing


def _stats(n: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    mean = F.when(n > 0, s1.cast("double") / n.cast("double")).otherwise(F.lit(0.0))
    std = F.coalesce(exact_std(n, s1, s2), F.lit(0.0))
    return mean, std


# The wide form repeats each rule per status; as SQL text one rule is one call.

def _rounded(x: str, digits: int) -> str:
    """SQL of ``round_half_up``."""
    scale = f"{float(10 ** digits)!r}D"
    return f"(CAST(floor({x} * {scale} + 0.5D) AS DOUBLE) / {scale})"


def _text1(x: str) -> str:
    """SQL of ``fmt1``."""
    return f"format_string('%.1f', {_rounded(x, 1)})"


def _moments(s: str) -> tuple[str, str]:
    """SQL of ``_stats`` over a status's column group."""
    n, s1, s2 = ("CAST(n_history AS DECIMAL(38,0))", f"CAST(`{s}__s1` AS DECIMAL(38,0))", f"CAST(`{s}__s2` AS DECIMAL(38,0))")
    mean = f"CASE WHEN n_history > 0 THEN CAST(`{s}__s1` AS DOUBLE) / CAST(n_history AS DOUBLE) ELSE 0.0D END"
    std = (f"coalesce(CASE WHEN n_history >= 2 THEN sqrt(CAST({n} * {s2} - {s1} * {s1} AS DOUBLE) "
           "/ (CAST(n_history AS DOUBLE) * CAST(n_history - 1 AS DOUBLE))) END, 0.0D)")
    return mean, std


def _score(frame: DataFrame, p: PolicyParams, statuses: Sequence[str]) -> DataFrame:
    """From ``n_history`` and per-status ``{s}__cur/__s1/__s2`` columns add
    mean, std, z (raw and 2 dp), anomaly flag and message per status, then
    the overall severity, max z and the recommendation text."""
    warn, crit = f"{float(p.z_score_threshold)!r}D", f"{float(p.critical_threshold)!r}D"
    moments = [f"{sql} AS `{s}__{name}`" for s in statuses for name, sql in zip(("mean", "std"), _moments(s))]
    raw = [f"(CAST(`{s}__cur` AS DOUBLE) - `{s}__mean`) / greatest(`{s}__std`, {float(p.min_std)!r}D) AS `{s}__zraw`" for s in statuses]
    judged = [x for s in statuses for x in (_rounded(f"`{s}__zraw`", 2) + f" AS `{s}__z`", f"`{s}__zraw` > {warn} AS `{s}__anom`")]
    frame = frame.selectExpr("*", *moments).selectExpr("*", *raw).selectExpr("*", *judged)
    enough = f"n_history >= {int(p.min_history)}"
    above = lambda t: "greatest(" + ", ".join(f"`{s}__z` > {t}" for s in statuses) + ")"
    max_z = "greatest(" + ", ".join(f"`{s}__z`" for s in statuses) + ")"
    names = "array_join(array_compact(array(" + ", ".join(f"CASE WHEN `{s}__anom` THEN '{s}' END" for s in statuses) + ")), ', ')"
    return frame.selectExpr(
        "*", f"{enough} AS sufficient_history", f"CASE WHEN {enough} THEN {_rounded(max_z, 2)} ELSE 0.0D END AS max_z_score",
        f"CASE WHEN NOT ({enough}) THEN 'NORMAL' WHEN {above(crit)} THEN 'CRITICAL' WHEN {above(warn)} THEN 'WARNING' "
        "ELSE 'NORMAL' END AS overall_severity",
    ).selectExpr("*", f"""CASE overall_severity
        WHEN 'CRITICAL' THEN concat('ALERT: Critical anomaly detected in ', {names},
            '. Immediate investigation recommended. Check payment gateway status and system health.')
        WHEN 'WARNING' THEN concat('WARNING: Elevated anomaly in ', {names},
            '. Monitor closely. Consider pre-emptive investigation if trend continues.')
        ELSE 'All transaction statuses within normal parameters.' END AS recommendation""")


def _details(frame: DataFrame, keys: Sequence[str], statuses: Sequence[str],
             extra: Sequence[str] = ()) -> DataFrame:
    """Unpivot the per-status column groups into one row per status."""
    items = ", ".join(f"""named_struct('status', '{s}', 'current_value', CAST(`{s}__cur` AS BIGINT),
        'baseline_mean', {_rounded(f"`{s}__mean`", 2)}, 'baseline_std', {_rounded(f"`{s}__std`", 2)},
        'z_score', `{s}__z`, 'z_raw', `{s}__zraw`, 'is_anomalous', `{s}__anom`,
        'contribution', CASE WHEN `{s}__anom` THEN concat('{s} count ', CAST(`{s}__cur` AS STRING), ' is ', {_text1(f"`{s}__zraw`")},
            'σ above baseline (mean=', {_text1(f"`{s}__mean`")}, ', std=', {_text1(f"`{s}__std`")}, ')') ELSE '' END)""" for s in statuses)
    rest = ["n_history", "overall_severity", "max_z_score", "recommendation"]
    return (frame.filter("sufficient_history").select(*keys, *extra, *rest, F.expr(f"explode(array({items}))").alias("d"))
            .select(*keys, *extra, "d.*", *rest))


def _cols_for(statuses, wide_src: DataFrame, cur_cond: Column) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("n_history")]
    for s in statuses:
        aggs += [F.sum(F.when(cur_cond, F.col(s)).otherwise(F.lit(0))).cast("bigint").alias(f"{s}__cur"),
                 F.sum(F.col(s)).alias(f"{s}__s1"), F.sum(sum_sq(s)).alias(f"{s}__s2")]
    return aggs


def policy_snapshot(df: DataFrame, params: PolicyParams = PolicyParams(), unit: str = "MINUTE",
                    keys: Sequence[str] = (), statuses: Sequence[str] = MONITORED_STATUSES,
                    newest: DataFrame | None = None) -> DataFrame:
    """One row per key: the detector at the latest stamp (wide form).  Without
    keys there is always a row: an empty table has no history and no stamp."""
    p = params
    step = unit_seconds(unit)
    latest = None if keys else latest_stamp(df)
    hist = wide(trailing(df, p.history_window, unit, keys, latest=latest, newest=newest), statuses=statuses, keys=keys, with_total=False)
    if keys:
        hist = hist.withColumn("eval_ts", F.max("ts").over(Window.partitionBy(*keys)))
    else:
        hist = hist.withColumn("eval_ts", F.lit(latest).cast(df.schema["ts"].dataType))
    cur = F.col("ts") >= F.col("eval_ts") - F.expr(f"INTERVAL {p.current_window * step} SECONDS")
    aggs = _cols_for(statuses, hist, cur)
    frame = hist.groupBy(*keys).agg(F.max("eval_ts").alias("eval_ts"), *aggs)
    filled = [c for s in statuses for c in (f"{s}__cur", f"{s}__s1", f"{s}__s2")]
    types = dict(frame.dtypes)
    frame = frame.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(types[c])) for c in filled})
    return _score(frame, p, statuses)


def policy_detect(df: DataFrame, params: PolicyParams = PolicyParams(), unit: str = "MINUTE",
                  keys: Sequence[str] = (), statuses: Sequence[str] = MONITORED_STATUSES,
                  newest: DataFrame | None = None) -> DataFrame:
    """Per-status details at the latest stamp (none when history is short)."""
    return _details(policy_snapshot(df, params, unit, keys, statuses, newest), keys, statuses, extra=("eval_ts",))


def policy_backtest(df: DataFrame, params: PolicyParams = PolicyParams(), unit: str = "MINUTE",
                    keys: Sequence[str] = (), statuses: Sequence[str] = MONITORED_STATUSES,
                    chunk_units: int | None = None) -> DataFrame:
    """The detector evaluated at every stamp: time-range frames over the
    zero-filled wide series (``[t - history, t]`` and ``[t - current, t]``).

    The frames are split exactly into time chunks of ``chunk_units`` so that
    one long series is spread over many tasks: each row is copied into the
    later chunks whose rows can reach back to it (at most ``history`` away),
    windows run per (keys, chunk), and only the rows in their own chunk are
    kept.  Default: max(1440, 24 x history) units per chunk, i.e. under 5 %
    copied rows, with keys and without.
    """
    p = params
    step = unit_seconds(unit)
    hist_s = p.history_window * step
    w0 = wide(df, statuses=statuses, keys=keys, with_total=False).withColumn(
        "_s", F.unix_seconds(F.col("ts").cast("timestamp")))
    span = (chunk_units or max(1440, 24 * p.history_window)) * step
    home = F.floor(F.col("_s") / F.lit(span))
    reach = F.floor((F.col("_s") + F.lit(max(hist_s, p.current_window * step))) / F.lit(span))
    w0 = (w0.withColumn("_home", home)
          .withColumn("_chunk", F.explode(F.sequence(F.col("_home"), reach))))
    base = Window.partitionBy(*keys, "_chunk").orderBy("_s")
    wh = base.rangeBetween(-hist_s, 0)
    wc = base.rangeBetween(-p.current_window * step, 0)
    frame = w0.withColumn("n_history", F.count(F.lit(1)).over(wh))
    for s in statuses:
        frame = (frame.withColumn(f"{s}__cur", F.sum(s).over(wc))
                 .withColumn(f"{s}__s1", F.sum(s).over(wh))
                 .withColumn(f"{s}__s2", F.sum(sum_sq(s)).over(wh)))
    frame = frame.filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")
    frame = _score(frame.withColumnRenamed("ts", "eval_ts"), p, statuses)
    return _details(frame, keys, statuses, extra=("eval_ts",))


def detail_severity(z: str = "z_score", critical: float = 4.0, warning: float = 2.5) -> Column:
    """Per-status severity from abs(z) (report and dispatch)."""
    a = F.abs(F.col(z))
    return F.when(a > critical, "CRITICAL").when(a > warning, "WARNING").otherwise("NORMAL")


# Fixed text of the report without data.
NO_DATA = "No transaction data available for analysis."


def analyze(df: DataFrame, window: int = 60, unit: str = "MINUTE", params: PolicyParams = PolicyParams(),
            keys: Sequence[str] = ()) -> DataFrame:
    """Analysis report: details + per-status severity + recommendation.  It
    always answers: with no data, or a history that is too short, it is one row
    with NORMAL and no status; without data the text says so."""
    check_range("window", window, 5, 1440)
    p = PolicyParams(**{**params.__dict__, "history_window": window})
    snap = policy_snapshot(df, p, unit, keys)
    d = _details(snap, keys, MONITORED_STATUSES, extra=("eval_ts",))
    full = (d.withColumn("severity", detail_severity("z_score", p.critical_threshold, p.z_score_threshold)))
    short = snap.filter(~F.col("sufficient_history")).withColumn(
        "recommendation", F.when(F.col("n_history") == 0, NO_DATA).otherwise(F.col("recommendation")))
    answer = short.select(*[
        F.col(c) if c in short.columns else
        (F.lit("NORMAL") if c == "severity" else F.lit(None)).cast(full.schema[c].dataType).alias(c) for c in full.columns])
    return (full.unionByName(answer).withColumn("window", F.lit(window))
            .withColumn("detection_method", F.lit("policy_zscore")))


def current_status(df: DataFrame, params: PolicyParams = PolicyParams(), unit: str = "MINUTE",
                   keys: Sequence[str] = (), statuses: Sequence[str] = MONITORED_STATUSES) -> DataFrame:
    """Overall severity, max z and a status -> z map (one row per key)."""
    snap = policy_snapshot(df, params, unit, keys, statuses)
    zmap = F.when(F.col("sufficient_history"), F.map_from_arrays(
        F.array(*[F.lit(s) for s in statuses]), F.array(*[F.col(f"{s}__z") for s in statuses])))
    return snap.select(*keys, "eval_ts", "overall_severity", "max_z_score", zmap.alias("statuses"))


def evaluate_counts(observations: DataFrame, history: DataFrame, params: PolicyParams = PolicyParams(),
                    unit: str = "MINUTE", statuses: Sequence[str] = MONITORED_STATUSES,
                    problem: Sequence[str] = PROBLEM_STATUSES) -> DataFrame:
    """Evaluate a table of observations ``(obs_id, status, cnt)`` against the
    trailing baseline of ``history`` (one row per monitored status, so the
    broadcast side has a fixed size bound).  A status that isn't monitored is
    rejected: severity INVALID, no score, and a message that names the status."""
    p = params
    hist = wide(trailing(history, p.history_window, unit), statuses=statuses, with_total=False)
    aggs = [F.count(F.lit(1)).alias("n")]
    for s in statuses:
        aggs += [F.sum(s).alias(f"{s}__s1"), F.sum(sum_sq(s)).alias(f"{s}__s2")]
    one = hist.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"{s}__s1").alias("s1"),
                                        F.col(f"{s}__s2").alias("s2")) for s in statuses]))
    base = one.select("n", rows.alias("b")).select("n", "b.*")
    mean, std = _stats(F.col("n"), F.col("s1"), F.col("s2"))
    base = base.select("status", "n", mean.alias("mean"), std.alias("std"))
    o = observations.join(F.broadcast(base), "status", "left")
    o = o.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("mean", F.coalesce("mean", F.lit(0.0))) \
         .withColumn("std", F.coalesce("std", F.lit(0.0)))
    known = F.coalesce(F.col("status").isin(*statuses), F.lit(False))
    short = F.col("n") < p.min_history
    prob = F.col("status").isin(*problem) & (F.col("cnt") > 0)
    z = (F.col("cnt").cast("double") - F.col("mean")) / F.greatest(F.col("std"), F.lit(p.min_std))
    o = o.withColumn("_z", z)
    sev = (F.when(~known, "INVALID").when(short & prob, "CRITICAL").when(short, "NORMAL")
           .when(F.col("_z") > p.critical_threshold, "CRITICAL")
           .when(F.col("_z") > p.z_score_threshold, "WARNING").otherwise("NORMAL"))
    anom = F.when(~known, F.lit(False)).when(short, prob).otherwise(F.col("_z") > p.z_score_threshold)
    msg = (F.when(~known, F.concat(F.lit("Status '"), F.coalesce("status", F.lit("")), F.lit(
        f"' is not monitored. Valid statuses: {', '.join(statuses)}")))
           .when(short & prob, F.concat(F.col("status"), F.lit(" count "), F.col("cnt").cast("string"),
                                         F.lit(" detected with no historical baseline (problem status should be rare/zero)")))
           .when(short, F.concat(F.lit("Insufficient history ("), F.col("n").cast("string"), F.lit(" < "),
                                 F.lit(str(p.min_history)), F.lit(") for reliable evaluation.")))
           .when(F.col("_z") > p.z_score_threshold, F.concat(
               F.col("status"), F.lit(" count "), F.col("cnt").cast("string"), F.lit(" is "), fmt1(F.col("_z")),
               F.lit("σ above baseline (mean="), fmt1(F.col("mean")), F.lit(", std="), fmt1(F.col("std")), F.lit(")")))
           .otherwise(F.lit("")))
    return o.select(
        *[c for c in observations.columns],
        sev.alias("severity"),
        F.when(~known, F.lit(0.0)).when(short & prob, F.lit(10.0)).when(short, F.lit(0.0)).otherwise(round_half_up("_z", 2)).alias("z_score"),
        F.when(short, F.lit(0.0)).otherwise(round_half_up("mean", 2)).alias("baseline_mean"),
        F.when(short, F.lit(0.0)).otherwise(round_half_up("std", 2)).alias("baseline_std"),
        anom.alias("is_anomalous"), msg.alias("message"))


def append_anomalous(evaluated: DataFrame, path: str) -> DataFrame:
    """Append the anomalous observations ``(ts, status, cnt)`` to the fact table
    and return what was appended (the conditional insert)."""
    from ..sources.files import append_transactions
    rows = anomalous_observations(evaluated).select("ts", "status", "cnt").checkpoint()
    append_transactions(rows, path)
    return rows


def anomalous_observations(evaluated: DataFrame) -> DataFrame:
    """Observations to append to the fact table: only the anomalous ones."""
    return evaluated.filter(F.col("is_anomalous"))
