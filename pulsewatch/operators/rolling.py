"""Rolling z-score detectors (volume, approval rate, error rate) and the
cross-signal divergence check.

``rolling_zscore`` is a trailing *row* frame: the current row and the
``window - 1`` rows before it, within each key.  Statistics are NULL until
``min_periods`` non-null values are in the frame; the std is floored at
``min_std``.  Integer series use an exact sum/sum-of-squares form so that the
result does not depend on summation order.

Scale: the frame is a sliding buffer of ``window`` rows, so one sort per key
and O(window) memory per task.  Series are aggregated to their grain first
(partial aggregation), so a key's window sees at most one row per stamp.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RollingParams
from ..functions.columns import exact_std, flag, sum_sq


def rolling_stats(value: str, order: str, keys: Sequence[str], p: RollingParams,
                  exact: bool, skip_nulls_as_rows: bool = False) -> dict[str, Column]:
    """Column expressions: rolling_mean, rolling_std, z_score and flags.

    ``skip_nulls_as_rows`` builds the frame over the non-null rows only (the
    series is "dropna'd" before the window) by putting NULL rows in their own
    window partition, so no filter + join-back is needed.
    """
    part = list(keys) + ([F.col(value).isNull()] if skip_nulls_as_rows else [])
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(-(p.window - 1), 0)
    v = F.col(value)
    n = F.count(v).over(w)
    if exact:
        s1 = F.sum(v).over(w)
        s2 = F.sum(sum_sq(v)).over(w)
        mean = s1.cast("double") / n.cast("double")
        std = exact_std(n, s1, s2)
    else:
        mean = F.avg(v).over(w)
        std = F.stddev_samp(v).over(w)
    ok = n >= F.lit(p.min_periods)
    if skip_nulls_as_rows:
        ok = ok & v.isNotNull()
    r_mean = F.when(ok, mean)
    r_std = F.when(ok & std.isNotNull(), F.greatest(std, F.lit(float(p.min_std))))
    return {"rolling_mean": r_mean, "rolling_std": r_std}


def with_rolling(df: DataFrame, value: str, order: str, keys: Sequence[str], p: RollingParams,
                 exact: bool, skip_nulls_as_rows: bool = False, mean_col: str = "rolling_mean",
                 std_col: str = "rolling_std") -> DataFrame:
    """Add the trailing-row-frame mean and floored std of ``value``.

    Integer series (``exact``) use running sums: the frame's count, sum and
    sum of squares are the running totals minus the running totals ``window``
    rows back.  The totals are exact integers (DECIMAL(38,0)), so the
    difference is exact and the result equals the sliding frame bit for bit,
    in O(1) per row instead of re-adding the whole frame for every row.
    Doubles keep the sliding frame (a difference of float running sums would
    cancel).
    """
    if not exact:
        st = rolling_stats(value, order, keys, p, exact, skip_nulls_as_rows)
        return df.withColumn(mean_col, st["rolling_mean"]).withColumn(std_col, st["rolling_std"])
    part = list(keys) + ([F.col(value).isNull()] if skip_nulls_as_rows else [])
    w = Window.partitionBy(*part).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col(value)
    d = "decimal(38,0)"
    t = {"n": "_rn", "s1": "_rs1", "s2": "_rs2"}
    df = (df.withColumn(t["n"], F.count(v).over(run))
          .withColumn(t["s1"], F.sum(F.coalesce(v.cast(d), F.lit(0).cast(d))).over(run))
          .withColumn(t["s2"], F.sum(F.coalesce(sum_sq(v), F.lit(0).cast(d))).over(run)))

    def frame(c, zero):
        return F.col(c) - F.coalesce(F.lag(c, p.window).over(w), zero)

    df = (df.withColumn("_fn", frame(t["n"], F.lit(0).cast("bigint")))
          .withColumn("_fs1", frame(t["s1"], F.lit(0).cast(d)))
          .withColumn("_fs2", frame(t["s2"], F.lit(0).cast(d))))
    n, s1, s2 = F.col("_fn"), F.col("_fs1"), F.col("_fs2")
    ok = n >= F.lit(p.min_periods)
    if skip_nulls_as_rows:
        ok = ok & v.isNotNull()
    std = exact_std(n, s1, s2)
    return (df.withColumn(mean_col, F.when(ok, s1.cast("double") / n.cast("double")))
            .withColumn(std_col, F.when(ok & std.isNotNull(), F.greatest(std, F.lit(float(p.min_std)))))
            .drop(*t.values(), "_fn", "_fs1", "_fs2"))


def row_frame_chunks(df: DataFrame, ts: str, keys: Sequence[str], window: int,
                     chunk_seconds: int, sequences: Sequence[Column | None] = (None,)) -> DataFrame:
    """Split each series into time chunks for an exact trailing row frame.

    Adds ``_chunk`` (the window partition) and ``_copy``.  Every row stays in
    its own chunk; in addition the ``window - 1`` rows that precede a chunk's
    first row are copied into it (they may come from several earlier, sparse
    chunks).  Which rows to copy follows from a per-chunk count table (one row
    per chunk): a tail row is copied into a later chunk while fewer than
    ``window - 1`` rows lie between them.  Windows over (keys, _chunk) then see
    exactly the rows the unsplit frame would; drop ``_copy`` rows afterwards.

    ``sequences`` lists the row subsets that form frames (``None`` = all rows,
    or a predicate such as ``value IS NOT NULL`` for a frame over non-null
    rows); the copies cover each of them.  Extra copies are always older than
    the rows a frame needs, so they never enter a frame.
    """
    k = window - 1
    home = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(chunk_seconds))
    base = df.withColumn("_home", home)
    own = base.withColumn("_chunk", F.col("_home")).withColumn("_copy", F.lit(False)).drop("_home")
    if k <= 0:
        return own
    wc = Window.partitionBy(*keys).orderBy("_home")
    copies = None
    for seq in sequences:
        sub = base if seq is None else base.filter(seq)
        ranked = sub.withColumn("_rd", F.row_number().over(
            Window.partitionBy(*keys, "_home").orderBy(F.desc(ts))))
        chunks = (sub.groupBy(*keys, "_home").agg(F.count(F.lit(1)).alias("_n"))
                  .withColumn("_cum", F.sum("_n").over(wc.rowsBetween(Window.unboundedPreceding, 0)))
                  .withColumn("_next", F.collect_list(F.struct(
                      F.col("_home").alias("target"), (F.col("_cum") - F.col("_n")).alias("start")))
                      .over(wc.rowsBetween(1, k)))
                  .select(*keys, "_home", "_cum", "_next"))
        tails = ranked.filter(F.col("_rd") <= k).join(chunks, [*keys, "_home"])
        between = F.col("_t.start") - F.col("_cum") + F.col("_rd") - 1
        c = (tails.withColumn("_t", F.explode("_next")).filter(between < k)
             .withColumn("_chunk", F.col("_t.target")).withColumn("_copy", F.lit(True))
             .drop("_t", "_next", "_cum", "_rd", "_home"))
        copies = c if copies is None else copies.unionByName(c)
    if len(sequences) > 1:
        copies = copies.dropDuplicates([*keys, ts, "_chunk"])
    return own.unionByName(copies)


def rolling_zscore(df: DataFrame, value: str, ts: str = "ts", keys: Sequence[str] = (),
                   params: RollingParams = RollingParams(), exact: bool | None = None,
                   dropna: bool = False, chunk_seconds: int | None = None) -> DataFrame:
    """Add rolling_mean, rolling_std, z_score, is_anomaly, is_spike, is_drop.

    ``dropna=True`` removes rows whose value is NULL before the frame is
    formed (rate series), otherwise NULL rows occupy frame positions.
    ``chunk_seconds`` splits each series into time chunks (see
    :func:`row_frame_chunks`) so one long series spreads over many tasks;
    the result is identical.
    """
    if exact is None:
        exact = dict(df.dtypes)[value] in ("bigint", "int", "smallint", "tinyint")
    src = df.filter(F.col(value).isNotNull()) if dropna else df
    part = list(keys)
    if chunk_seconds:
        src = row_frame_chunks(src, ts, keys, params.window, chunk_seconds)
        part.append("_chunk")
    out = with_rolling(src, value, ts, part, params, exact)
    if chunk_seconds:
        out = out.filter(~F.col("_copy")).drop("_chunk", "_copy")
    z = (F.col(value) - F.col("rolling_mean")) / F.col("rolling_std")
    t = F.lit(float(params.z_threshold))
    return (out.withColumn("z_score", z)
            .withColumn("is_anomaly", flag(F.abs(F.col("z_score")) > t))
            .withColumn("is_spike", flag(F.col("z_score") > t))
            .withColumn("is_drop", flag(F.col("z_score") < -t)))


def bands(df: DataFrame, k: float, mean: str = "rolling_mean", std: str = "rolling_std") -> DataFrame:
    """Confidence band mean +/- k*std, lower clipped at 0."""
    lo = F.col(mean) - F.lit(k) * F.col(std)
    return (df.withColumn("band_lower", F.when(lo.isNotNull(), F.greatest(lo, F.lit(0.0))))
            .withColumn("band_upper", F.col(mean) + F.lit(k) * F.col(std)))


def direction(z: str = "z_score", up: str = "SPIKE", down: str = "DROP") -> Column:
    return F.when(F.col(z) > 0, up).when(F.col(z) < 0, down)


def divergence(status_rates: DataFrame, auth_rates: DataFrame, sigmas: float = 3.0,
               ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Stamps with both approval rates, their absolute gap, and a flag when the
    gap exceeds mean + sigmas * std of all gaps (a scalar subquery)."""
    j = (status_rates.select(*keys, ts, F.col("approval_rate").alias("status_approval_rate"))
         .join(auth_rates.select(*keys, ts, "auth_approval_rate"), [*keys, ts], "inner")
         .na.drop(subset=["status_approval_rate", "auth_approval_rate"])
         .withColumn("divergence", F.abs(F.col("status_approval_rate") - F.col("auth_approval_rate"))))
    # One row per stamp, read by the threshold and by the flags: write it once.
    j = j.checkpoint()
    if keys:
        th = j.groupBy(*keys).agg(
            (F.avg("divergence") + F.lit(sigmas) * F.stddev_samp("divergence")).alias("threshold"))
        j = j.join(th, list(keys))
    else:
        thr = j.agg(F.avg("divergence") + F.lit(sigmas) * F.stddev_samp("divergence")).scalar()
        j = j.withColumn("threshold", thr)
    return j.withColumn("is_divergent", flag(F.col("divergence") > F.col("threshold")))
