"""Operational rollups: ingest counters and gauges, duration histograms,
request counts, alert counters, and structured log parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CONSUME_BUCKETS, IGNORED_PATHS


def ingest_counters(records: DataFrame, batch: str = "ts") -> DataFrame:
    """Per status: records consumed, cumulative count, and the gauge = the
    status's count in the latest batch that contained it."""
    per = records.groupBy(batch, "status").agg(F.count(F.lit(1)).alias("_r"), F.sum("cnt").alias("_c"))
    return per.groupBy("status").agg(
        F.sum("_r").cast("bigint").alias("records_consumed"),
        F.sum("_c").cast("bigint").alias("cumulative_count"),
        F.max_by("_c", F.col(batch)).cast("bigint").alias("last_batch_count"),
        F.max(batch).alias("last_batch"))


def duration_histogram(df: DataFrame, value: str, labels: Sequence[str] = (),
                       buckets: Sequence[float] = CONSUME_BUCKETS) -> DataFrame:
    """Cumulative bucket counts (``le``), plus ``+Inf`` = count, sum and count,
    in one aggregation; long output (labels, le, bucket_count, sum, count)."""
    aggs = [F.sum((F.col(value) <= F.lit(float(b))).cast("bigint")).alias(f"b{i}") for i, b in enumerate(buckets)]
    g = df.groupBy(*labels).agg(*aggs, F.sum(value).alias("sum"), F.count(value).alias("count"))
    items = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("bucket_count"))
             for i, b in enumerate(buckets)]
    items.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return (g.select(*labels, "sum", "count", F.explode(F.array(*items)).alias("e"))
            .select(*labels, "e.le", F.coalesce("e.bucket_count", F.lit(0)).cast("bigint").alias("bucket_count"),
                    "sum", "count"))


def request_counts(requests: DataFrame, ignored: Sequence[str] = IGNORED_PATHS) -> DataFrame:
    return (requests.filter(~F.col("path").isin(*ignored))
            .groupBy("method", "path", "status").agg(F.count(F.lit(1)).alias("requests")))


LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("level", T.StringType()),
    T.StructField("logger", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("otelTraceID", T.StringType()),
    T.StructField("otelSpanID", T.StringType()),
    T.StructField("otel.trace_id", T.StringType()),
    T.StructField("otel.span_id", T.StringType()),
])


def parse_logs(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON log lines -> (ts, level, logger, message, trace_id, span_id).
    Accepts both trace field spellings (``otelTraceID`` / ``otel.trace_id``).
    Every line is kept: one that isn't a JSON object has NULL fields and is its
    own message."""
    p = lines.select(F.col(value).alias("v"), F.from_json(F.col(value), LOG_SCHEMA).alias("j"))
    is_object = F.coalesce(F.get_json_object("v", "$").rlike(r"^\s*\{"), F.lit(False))
    return p.select(
        F.timestamp_micros((F.col("j.timestamp") * 1e6).cast("bigint")).cast("timestamp_ntz").alias("ts"),
        F.col("j.level").alias("level"), F.col("j.logger").alias("logger"), F.when(is_object, F.col("j.message")).otherwise(F.col("v")).alias("message"),
        F.coalesce(F.col("j.otelTraceID"), F.col("j.`otel.trace_id`")).alias("trace_id"),
        F.coalesce(F.col("j.otelSpanID"), F.col("j.`otel.span_id`")).alias("span_id"))
