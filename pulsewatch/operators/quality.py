"""Data-quality report: nulls, duplicates, negatives, distinct values, missing
stamps, validation of incoming records and reconciliation of two sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MONITORED_STATUSES, unit_seconds


def quality_summary(df: DataFrame, name: str, key: Sequence[str], value: str = "cnt",
                    category: str = "status", ts: str = "ts") -> DataFrame:
    """One row: rows, null cells, rows beyond the first per ``key``, negative
    values, distinct categories, first/last stamp.  Two aggregations: the
    per-key counts (for duplicates, as a scalar) and the one-pass totals."""
    cols = df.columns
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    dups = per_key.agg(F.sum(F.col("_n") - 1).cast("bigint")).scalar()
    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        sum((F.sum(F.col(c).isNull().cast("bigint")) for c in cols[1:]),
            F.sum(F.col(cols[0]).isNull().cast("bigint"))).alias("null_cells"),
        F.sum((F.col(value) < 0).cast("bigint")).alias("negative_values"),
        F.countDistinct(category).alias("n_distinct"),
        F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
    # The duplicate count is a scalar subquery over the per-key counts.
    return (totals.withColumn("dup_rows", dups)
            .select(F.lit(name).alias("dataset"), "n_rows", "null_cells",
                    F.coalesce("dup_rows", F.lit(0)).cast("bigint").alias("dup_rows"),
                    F.coalesce("negative_values", F.lit(0)).cast("bigint").alias("negative_values"),
                    "n_distinct", "min_ts", "max_ts"))


def stamp_grid(df: DataFrame, col: str, step: int, chunk_steps: int = 4096) -> DataFrame:
    """Every multiple of ``step`` seconds from min(col) to max(col) (BIGINT
    epoch seconds), generated in parallel: the bounds row expands to chunk
    starts, the chunks are spread over the cluster, and each chunk expands its
    own stamps, so no single task builds the whole grid."""
    chunk = step * chunk_steps
    bounds = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    starts = bounds.select("_lo", "_hi", F.explode(F.sequence(
        F.col("_lo"), F.col("_hi"), F.lit(chunk).cast("bigint"))).alias("_c"))
    starts = starts.repartition("_c")
    return starts.select(F.explode(F.sequence(
        F.col("_c"), F.least(F.col("_c") + F.lit(chunk - step), F.col("_hi")),
        F.lit(step).cast("bigint"))).alias(col))


def expected_stamps(df: DataFrame, unit: str = "MINUTE", ts: str = "ts") -> DataFrame:
    """Every stamp between the first and last one (see :func:`stamp_grid`)."""
    secs = df.select(F.unix_seconds(F.col(ts).cast("timestamp")).alias("_s"))
    grid = stamp_grid(secs, "_s", unit_seconds(unit))
    return grid.select(F.timestamp_seconds("_s").cast("timestamp_ntz").alias(ts))


def missing_stamps(df: DataFrame, unit: str = "MINUTE", ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Expected stamps absent from the data, of each series (see ``completeness``)."""
    from . import completeness
    return completeness.missing_stamps(df, unit, keys, ts)


def validate(records: DataFrame, statuses: Sequence[str] = MONITORED_STATUSES) -> DataFrame:
    """Flag each record valid or rejected with a reason (first failing rule)."""
    reason = (F.when(F.col("ts").isNull(), "missing timestamp")
              .when(F.col("status").isNull(), "missing status")
              .when(F.col("cnt").isNull(), "missing count")
              .when(F.col("cnt") < 0, "negative count")
              .when(~F.col("status").isin(*statuses), "unmonitored status"))
    return records.withColumn("reject_reason", reason).withColumn(
        "is_valid", F.col("reject_reason").isNull())


def reconcile(left: DataFrame, right: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Compare two per-stamp totals (``total`` columns) of each series: stamps on each
    side, mismatching stamps (missing on one side counts), the first mismatch and
    both grand totals."""
    l = left.groupBy(*keys, ts).agg(F.sum("total").cast("bigint").alias("l_total"))
    r = right.groupBy(*keys, ts).agg(F.sum("total").cast("bigint").alias("r_total"))
    j = l.join(r, [*keys, ts], "full_outer")
    bad = ~F.col("l_total").eqNullSafe(F.col("r_total"))
    return j.groupBy(*keys).agg(
        F.count("l_total").alias("n_left"), F.count("r_total").alias("n_right"),
        F.sum(bad.cast("bigint")).alias("n_mismatch"),
        F.min(F.when(bad, F.col(ts))).alias("first_mismatch"),
        F.sum("l_total").cast("bigint").alias("left_total"),
        F.sum("r_total").cast("bigint").alias("right_total"))
