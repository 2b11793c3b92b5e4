"""Batch-written tables laid out by date first, for streams that read them back.

``<base>/live/date=D/batch_id=N`` holds what batch N added to day D.  A batch is
written with dynamic partition overwrite, so one that runs again replaces its own
rows and nothing else.  A reader names the days it wants: only their folders are
listed, however many days and batches the table has.

``compact`` rewrites a day's batches up to N as ``<base>/compact/date=D/upto=N``.
From the moment its ``_SUCCESS`` is there a reader takes it instead of these batches,
and what it replaced can be deleted at any time; a job lost in between leaves
nothing twice.  A day thus has at most ``most`` live folders and one compact one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file that compaction writes, about.
FILE_ROWS = 4_000_000


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, folder: str, name: str, complete: bool = False) -> list[int]:
    """The numbers N of the folders ``name=N`` in a folder, ascending; the folder may be missing."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(f"{name}=")]
    if complete:
        found = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in found)


def at(x: dt.datetime) -> Column:
    """A wall-clock stamp of the session's time zone as TIMESTAMP literal."""
    return F.lit(x.isoformat(sep=" ")).cast("timestamp")


def days(first: dt.date, last: dt.date) -> list[dt.date]:
    return [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]


def put(df: DataFrame, base: str, batch_id: int, ts: str = "ts") -> None:
    """Write a batch; rows without a stamp go to the day ``__HIVE_DEFAULT_PARTITION__``."""
    (df.withColumn("date", F.to_date(ts)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch_id").parquet(f"{base}/live"))


def _leaves(spark: SparkSession, base: str, dates: Iterable[dt.date]) -> tuple[list[str], list[str]]:
    """Folders that hold the days: compact ones, and the live ones after them."""
    compact, live = [], []
    for d in dates:
        done = _numbers(spark, f"{base}/compact/date={d}", "upto", complete=True)
        if done:
            compact.append(f"{base}/compact/date={d}/upto={done[-1]}")
        live += [f"{base}/live/date={d}/batch_id={n}" for n in _numbers(spark, f"{base}/live/date={d}", "batch_id")
                 if not done or n > done[-1]]
    return compact, live


def read(spark: SparkSession, base: str, schema: str, dates: Iterable[dt.date]) -> DataFrame:
    """Rows of the days: the columns of ``schema`` and ``batch_id``.  Only folders of these days are listed."""
    compact, live = _leaves(spark, base, dates)
    whole = f"{schema}, batch_id bigint"
    out = spark.createDataFrame([], whole)
    if compact:
        out = out.unionByName(spark.read.schema(whole).parquet(*compact))
    if live:
        out = out.unionByName(spark.read.schema(f"{whole}, date date").option("basePath", f"{base}/live").parquet(*live).drop("date"))
    return out


def compact(spark: SparkSession, base: str, schema: str, date: dt.date, upto: int, most: int = 64) -> bool:
    """Merge a day's batches up to ``upto`` (all of them finished) if it has more than
    ``most``, and drop what is merged.  Returns whether it did."""
    done = _numbers(spark, f"{base}/compact/date={date}", "upto", complete=True)
    live = [n for n in _numbers(spark, f"{base}/live/date={date}", "batch_id") if n <= upto]
    fresh = [n for n in live if not done or n > done[-1]]
    if len(fresh) > most:
        rows = read(spark, base, schema, [date]).where(F.col("batch_id") <= upto)
        files = max(1, -(-rows.count() // FILE_ROWS))
        rows.repartition(files).write.mode("overwrite").parquet(f"{base}/compact/date={date}/upto={upto}")
        done.append(upto)
    for n in live:
        if done and n <= done[-1]:
            _drop(spark, f"{base}/live/date={date}/batch_id={n}")
    for n in done[:-1]:
        _drop(spark, f"{base}/compact/date={date}/upto={n}")
    return len(fresh) > most


def last_day(spark: SparkSession, base: str) -> dt.date | None:
    """The latest day that has rows: a listing of the days' folders."""
    found = []
    for tree in ("live", "compact"):
        fs, at = _fs(spark, f"{base}/{tree}")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        found += [n[5:] for n in names if n.startswith("date=") and n[5:6].isdigit()]
    return dt.date.fromisoformat(max(found)) if found else None


def _drop(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def output(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table whose batches write only when they have rows: empty if none had."""
    fs, at = _fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)
