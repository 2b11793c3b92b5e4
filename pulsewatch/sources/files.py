"""File sources and sinks: checkout / transactions / auth-code CSV scans,
fact-table append and reset, per-snapshot CSV export.

Every reader passes an explicit schema (no inference pass over the data)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKOUT_SCHEMA = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("today", T.LongType()),
    T.StructField("yesterday", T.LongType()),
    T.StructField("same_day_last_week", T.LongType()),
    T.StructField("avg_last_week", T.DoubleType()),
    T.StructField("avg_last_month", T.DoubleType()),
])

TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("count", T.LongType()),
])

AUTH_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("auth_code", T.StringType()),  # '00' must stay text
    T.StructField("count", T.LongType()),
])


def read_checkout_csv(spark: SparkSession, path: str) -> DataFrame:
    """Multi-file checkout scan; ``hour`` from ``'07h'`` and ``snapshot`` from
    the file name (``checkout_1``)."""
    df = spark.read.schema(CHECKOUT_SCHEMA).option("header", True).csv(path)
    return (df.withColumn("hour", F.regexp_replace("time", "h", "").cast("int"))
            .withColumn("snapshot", F.regexp_extract(F.input_file_name(), r"(checkout_[^/.]+)", 1)))


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """``timestamp,status,count`` -> ``(ts, status, cnt)``."""
    df = spark.read.schema(TRANSACTIONS_SCHEMA).option("header", True).csv(path)
    return df.select(F.col("timestamp").alias("ts"), "status", F.col("count").alias("cnt"))


def read_auth_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(AUTH_SCHEMA).option("header", True).csv(path)
    return df.select(F.col("timestamp").alias("ts"), "auth_code", F.col("count").alias("cnt"))


def append_transactions(df: DataFrame, path: str, reset: bool = False, keys: Sequence[str] = ()) -> int:
    """Append records to the fact table stamped with ``ingested_at``,
    partitioned by date; ``reset=True`` replaces the table.  Returns the
    number of rows written, observed in the write itself (the input is computed
    once).  With ``keys`` the newest stamp of each series is written beside the table,
    before its rows are: it may run ahead of them, never behind."""
    if keys:
        df = df.checkpoint()
        (df.groupBy(*keys).agg(F.max("ts").alias("newest")).coalesce(1)
         .write.mode("overwrite" if reset else "append").parquet(newest_path(path)))
    seen = Observation()
    out = (df.withColumn("ingested_at", F.current_timestamp().cast("timestamp_ntz"))
           .withColumn("date", F.to_date("ts")).observe(seen, F.count(F.lit(1)).alias("rows")))
    out.write.mode("overwrite" if reset else "append").partitionBy("date").parquet(path)
    return seen.get["rows"]


def newest_path(path: str) -> str:
    return f"{path.rstrip('/')}_newest"


def newest_stamps(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """(keys, newest): the latest stamp of each series of a fact table, without reading the
    table; a row per key and append."""
    return spark.read.parquet(newest_path(path)).groupBy(*keys).agg(F.max("newest").alias("newest"))


def export_by_snapshot(df: DataFrame, path: str) -> None:
    """One CSV folder per snapshot (header on)."""
    df.write.mode("overwrite").option("header", True).partitionBy("snapshot").csv(path)
