"""Trailing-window queries over the fact table ``(ts, status, cnt)``.

The trailing window is anchored at the data's own latest stamp, not the wall
clock, and both ends are inclusive: a 60-unit window spans 61 stamps and a
1-unit window sums two stamps.  The anchor is looked up first and bounds the
scan as a literal (see ``trailing``).  With keys each series is anchored at its own
latest stamp, by a table of one row per key joined back on the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import check_range, unit_seconds


def _interval(window: int, unit: str):
    return F.expr(f"INTERVAL {int(window) * unit_seconds(unit)} SECONDS")


def _literal(df: DataFrame, ts: str, text: str) -> Column:
    return F.lit(text).cast(df.schema[ts].dataType)


def _day(df: DataFrame) -> bool:
    """Whether a column ``date`` holds the day of the stamps, as tables that
    ``sources.files.append_transactions`` writes do."""
    return "date" in df.columns and isinstance(df.schema["date"].dataType, T.DateType)


def latest_stamp(df: DataFrame, ts: str = "ts") -> str | None:
    """The latest stamp of a table as text.  With days, only the last one's stamps are read."""
    if _day(df):
        day = df.agg(F.max("date")).first()[0]
        if day is None:
            return None
        df = df.filter(F.col("date") == F.lit(day))
    return df.agg(F.max(ts).cast("string")).first()[0]


def since(df: DataFrame, bound: str | None, ts: str = "ts") -> DataFrame:
    """Rows from a stamp on, bounded by literals on the stored columns, so that files, row
    groups and days before it aren't read; none without a stamp."""
    if bound is None:
        return df.filter(F.lit(False))
    df = df.filter(F.col(ts) >= _literal(df, ts, bound))
    return df.filter(F.col("date") >= F.lit(bound[:10]).cast("date")) if _day(df) else df


def trailing(df: DataFrame, window: int, unit: str = "MINUTE", keys: Sequence[str] = (), ts: str = "ts",
             latest: str | None = None, newest: DataFrame | None = None) -> DataFrame:
    """Rows with ``ts >= max(ts) - window units`` (inclusive).

    The anchor is one value, ``latest`` (by default looked up first), and the bound a literal
    of the scan.  With keys each series has its own: ``newest`` is a table (keys, newest),
    as ``sources.files.newest_stamps`` keeps it (by default grouped from ``df``); the scan is
    bounded by the oldest of them, so a series that went quiet loses nothing."""
    back = lambda c: c - _interval(window, unit)
    if not keys:
        latest = latest or latest_stamp(df, ts)
        bound = None if latest is None else df.sparkSession.range(1).select(back(_literal(df, ts, latest)).cast("string")).first()[0]
        return since(df, bound, ts)
    if newest is None:
        newest = df.groupBy(*keys).agg(F.max(ts).alias("newest"))
    last = newest.groupBy(*keys).agg(F.max("newest").alias("_anchor"))
    oldest = last.agg(back(F.min("_anchor")).cast("string")).first()[0]
    return (since(df, oldest, ts).join(last, list(keys))
            .filter(F.col(ts) >= back(F.col("_anchor"))).drop("_anchor"))


def status_summary(df: DataFrame, window: int = 60, unit: str = "MINUTE",
                   keys: Sequence[str] = (), newest: DataFrame | None = None) -> DataFrame:
    """Per status: total, avg per stamp (2 dp), max, min, data points, by total desc.

    ``total_points`` repeats the sum of data points over the result.
    """
    check_range("window", window, 1, 1440)
    w = trailing(df, window, unit, keys, newest=newest)
    out = w.groupBy(*keys, "status").agg(
        F.sum("cnt").alias("total"),
        F.round(F.avg("cnt"), 2).alias("avg_cnt"),
        F.max("cnt").alias("max_cnt"),
        F.min("cnt").alias("min_cnt"),
        F.count(F.lit(1)).alias("data_points"),
    )
    # The aggregate has one row per (keys, status): a tiny window.
    out = out.withColumn("total_points",
                         F.sum("data_points").over(Window.partitionBy(*keys)))
    return out.orderBy(*keys, F.desc("total"), "status")


def status_rates(df: DataFrame, window: int = 60, unit: str = "MINUTE",
                 keys: Sequence[str] = (), newest: DataFrame | None = None) -> DataFrame:
    """Per stamp and status counts over the trailing window, ordered."""
    check_range("window", window, 1, 1440)
    w = trailing(df, window, unit, keys, newest=newest)
    return (w.groupBy(*keys, "ts", "status").agg(F.sum("cnt").alias("cnt"))
            .orderBy(*keys, "ts", "status"))


def status_distribution(df: DataFrame, window: int = 1, unit: str = "MINUTE",
                        keys: Sequence[str] = (), newest: DataFrame | None = None) -> DataFrame:
    """Status totals over the trailing window plus the grand total."""
    check_range("window", window, 1, 1440)
    w = trailing(df, window, unit, keys, newest=newest)
    out = w.groupBy(*keys, "status").agg(F.sum("cnt").alias("total"))
    return out.withColumn("grand_total", F.sum("total").over(Window.partitionBy(*keys)))


def recent(df: DataFrame, limit: int = 10, order: Sequence[str] = ("ingested_at", "ingest_seq"),
           keys: Sequence[str] = ()) -> DataFrame:
    """Latest ``limit`` records (a top-k: TakeOrderedAndProject, no full sort).  With keys
    of each series: every task keeps its ``limit`` latest of a key before the shuffle, so
    a hot key sends ``limit`` rows a task."""
    check_range("limit", limit, 1, 100)
    if keys:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
        return df.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    return df.orderBy(*[F.desc(c) for c in order]).limit(limit)


def total_records(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_records"))
