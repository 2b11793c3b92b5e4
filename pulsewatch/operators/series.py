"""Per-stamp series: the zero-filled wide frame, rates, auth-code rates,
profiling, descriptive stats and top-k code reports.

The wide frame is built with conditional sums over a fixed status list (the
same plan as ``pivot`` with explicit values: one partial + final hash
aggregate, no extra distinct job, and valid on streams).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import APPROVAL_CODE, ERROR_STATUSES, MONITORED_STATUSES, check_range
from ..functions.columns import safe_div
from .quantiles import describe_exact
from .windows import trailing


def wide(df: DataFrame, statuses: Sequence[str] = MONITORED_STATUSES,
         keys: Sequence[str] = (), with_total: bool = True) -> DataFrame:
    """One row per (keys, ts): a BIGINT column per status (0 when absent) and
    ``total`` over *all* statuses present (monitored or not)."""
    aggs = [F.sum(F.when(F.col("status") == s, F.col("cnt")).otherwise(F.lit(0)))
            .cast("bigint").alias(s) for s in statuses]
    if with_total:
        aggs.append(F.sum("cnt").cast("bigint").alias("total"))
    return df.groupBy(*keys, "ts").agg(*aggs)


def with_rates(w: DataFrame, error_statuses: Sequence[str] = ERROR_STATUSES) -> DataFrame:
    """approval_rate = approved/total, error_rate = (denied+failed)/total; NULL at total 0."""
    err = sum((F.col(s) for s in error_statuses[1:]), F.col(error_statuses[0]))
    return (w.withColumn("approval_rate", safe_div("approved", "total"))
            .withColumn("error_rate", safe_div(err, F.col("total"))))


def rate_series(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return with_rates(wide(df, keys=keys))


def history_window(df: DataFrame, window: int = 60, unit: str = "MINUTE",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Trailing window pivoted to one row per stamp, oldest first."""
    check_range("window", window, 1, 1440)
    return wide(trailing(df, window, unit, keys), keys=keys, with_total=False).orderBy(*keys, "ts")


def volume_per_stamp(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "ts").agg(F.sum("cnt").cast("bigint").alias("total"))


def volume_by_status(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (df.groupBy(*keys, "status").agg(F.sum("cnt").cast("bigint").alias("total"))
            .orderBy(*keys, F.desc("total"), "status"))


def profile(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, volume, first/last stamp, distinct stamps and statuses in one pass."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("cnt").cast("bigint").alias("total_cnt"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.countDistinct("ts").alias("n_stamps"),
        F.countDistinct("status").alias("n_statuses"),
    )


def describe(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, exact interpolated quartiles, max per metric; the values
    of a metric stay spread (see ``quantiles``, also for sketches of raw columns)."""
    return describe_exact(df, metrics, keys)


# --- auth codes -----------------------------------------------------------------

def code_totals(auth: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return auth.groupBy(*keys, "auth_code").agg(F.sum("cnt").cast("bigint").alias("total"))


def _approval_pick() -> Column:
    return F.coalesce(
        F.max(F.when(F.col("auth_code") == APPROVAL_CODE, F.col("auth_code"))),
        F.max(F.when(F.col("auth_code") == "0", F.col("auth_code"))),
        F.min_by("auth_code", F.struct(-F.col("total"), F.col("auth_code"))))


def approval_code(auth: DataFrame):
    """Scalar column: '00' if present, else '0', else the largest-volume code
    (the smaller of equals)."""
    return code_totals(auth).agg(_approval_pick()).scalar()


def auth_rates(auth: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Approval rate per (keys, stamp); with keys every series has an approval code of its own."""
    if keys:
        codes = code_totals(auth, keys).groupBy(*keys).agg(_approval_pick().alias("approval_code"))
        auth, code = auth.join(codes, list(keys)), F.col("approval_code")
    else:
        code = approval_code(auth)
    out = (auth.groupBy(*keys, "ts").agg(
        F.sum(F.when(F.col("auth_code") == code, F.col("cnt")).otherwise(0)).cast("bigint").alias("approved_cnt"),
        F.sum("cnt").cast("bigint").alias("auth_total"), *([F.first("approval_code").alias("approval_code")] if keys else []))
        .withColumn("auth_approval_rate", safe_div("approved_cnt", "auth_total")))
    return out if keys else out.withColumn("approval_code", code)


def top_codes(auth: DataFrame, n: int = 10, exclude: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Top-n codes by volume (code as tie-break): TakeOrderedAndProject; with keys of each
    series, over totals that have one row per (keys, code)."""
    a = auth.filter(~F.col("auth_code").isin(*exclude)) if exclude else auth
    if keys:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("total"), "auth_code"))
        return code_totals(a, keys).withColumn("place", place).where(F.col("place") <= n)
    return code_totals(a).orderBy(F.desc("total"), "auth_code").limit(n)


def top_code_series(auth: DataFrame, n: int = 5, exclude: Sequence[str] = (APPROVAL_CODE,), keys: Sequence[str] = ()) -> DataFrame:
    """Per-stamp counts of the top-n non-approval codes, zero-filled.

    The top-n list is an n-element scalar array (a proven size bound); each
    stamp that has any of those codes is expanded over it, then joined to the
    counts.  No cross join and nothing collected to the driver.
    """
    if keys:
        keys = list(keys)
        top = top_codes(auth, n, exclude, keys).groupBy(*keys).agg(F.sort_array(F.collect_list("auth_code")).alias("top"))  # n codes
        hit = auth.join(top, keys).filter(F.array_contains("top", F.col("auth_code")))
        counts = hit.groupBy(*keys, "ts", "auth_code").agg(F.sum("cnt").cast("bigint").alias("cnt"))
        grid = hit.select(*keys, "ts", "top").distinct().select(*keys, "ts", F.explode("top").alias("auth_code"))
        return (grid.join(counts, [*keys, "ts", "auth_code"], "left")
                .select(*keys, "ts", "auth_code", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")))
    top = top_codes(auth, n, exclude).agg(F.sort_array(F.collect_list("auth_code"))).scalar()
    hit = auth.filter(F.array_contains(top, F.col("auth_code")))
    counts = hit.groupBy("ts", "auth_code").agg(F.sum("cnt").cast("bigint").alias("cnt"))
    grid = hit.select("ts").distinct().select("ts", F.explode(top).alias("auth_code"))
    return (grid.join(counts, ["ts", "auth_code"], "left")
            .select("ts", "auth_code", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")))
