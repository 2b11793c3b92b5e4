"""Windowed counts with late records: quarantine, corrections, drops that are counted.

A streaming aggregate drops what comes behind its watermark and says so only in a
metric.  Here every micro-batch is split at the watermark that the batches before it
left (the latest stamp less ``delay``):

* on time: counted in its window;
* late but wanted (at most ``allowed`` behind the watermark): put aside in ``late``, counted,
  and the closed window is given out again as a correction;
* too late: put aside in ``dropped`` and not counted.

Counts are kept as sums per (window, status) and batch, by date (``facts``), so a batch that
runs again replaces what it wrote.  A window's row is given out once when the
watermark passes its end and again for each batch that corrects it, numbered by batch:
an upsert by window.  On-time and corrected counts add up to the batch's.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MONITORED_STATUSES
from ..sources.messages import decode_batches
from . import facts

SUMS = "ts timestamp, status string, cnt bigint, records bigint, late_records bigint"
LATE = "ts timestamp, status string, cnt bigint, mark timestamp, batch_id bigint"
MARKS = "latest timestamp, batch_id bigint"


def windows_schema(statuses: Sequence[str] = MONITORED_STATUSES) -> str:
    return ("ts timestamp, " + ", ".join(f"{s} bigint" for s in statuses)
            + ", total bigint, records bigint, late_records bigint, version bigint, correction boolean")


def late_counts(spark: SparkSession, stream: DataFrame, base: str, checkpoint: str, unit_seconds: int = 3600,
                delay_seconds: int = 120, allowed_seconds: int = 86400, statuses: Sequence[str] = MONITORED_STATUSES):
    """Start the query (``availableNow``) over a stream of messages; tables under ``base``:
    sums, windows, late, dropped, marks."""
    known: dict[str, dt.datetime | None] = {}

    def mark_before(batch_id: int):
        """The latest stamp of the batches before; read back after a restart only."""
        if "latest" not in known:
            known["latest"] = facts.output(spark, f"{base}/marks", MARKS).where(F.col("batch_id") < batch_id).agg(
                F.max("latest").cast("timestamp_ntz")).first()[0]
        return known["latest"]

    def put(df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")

    def sink(batch: DataFrame, batch_id: int) -> None:
        good, _ = decode_batches(batch)
        before = mark_before(batch_id)
        mark = None if before is None else before - dt.timedelta(seconds=delay_seconds)
        start = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / unit_seconds) * unit_seconds)
        if mark is None:
            late, wanted = F.lit(False), F.lit(True)
        else:
            late = F.unix_seconds(start) + unit_seconds <= F.unix_seconds(facts.at(mark))
            wanted = F.col("ts") >= facts.at(mark - dt.timedelta(seconds=allowed_seconds))
        rows = good.withColumn("start", start).withColumn("late", late).withColumn("wanted", ~late | wanted).persist()
        seen = rows.agg(F.max("ts").cast("timestamp_ntz").alias("latest"),
                        F.min(F.when(F.col("wanted"), F.col("start"))).cast("timestamp_ntz").alias("first"), F.sum(F.col("late").cast("int")).alias("late"),
                        F.sum((~F.col("wanted")).cast("int")).alias("dropped")).first()
        if seen["latest"] is None:
            rows.unpersist()
            return
        if seen["first"] is None:  # all of them dropped
            seen = seen.asDict() | {"first": mark}
        sums = rows.where("wanted").groupBy(F.col("start").alias("ts"), "status").agg(
            F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("records"), F.sum(F.col("late").cast("bigint")).alias("late_records"))
        facts.put(sums, f"{base}/sums", batch_id)
        for name, count, cond in (("late", seen["late"], "late AND wanted"), ("dropped", seen["dropped"], "NOT wanted")):
            if count:
                put(rows.where(cond).select("ts", "status", "cnt", facts.at(mark).alias("mark")), name, batch_id)
        latest = max(x for x in (before, seen["latest"]) if x is not None)
        # Windows that the new watermark closes, and closed ones that late records changed:
        # none of them starts before both the last open window and the earliest late record.
        closes = latest - dt.timedelta(seconds=delay_seconds)
        changed = rows.where("late AND wanted").select(F.col("start").alias("ts")).distinct()
        first = seen["first"] if mark is None else min(seen["first"], mark - dt.timedelta(seconds=unit_seconds))
        sums_since = facts.read(spark, f"{base}/sums", SUMS, facts.days(first.date(), closes.date()))
        ends = F.unix_seconds("ts") + unit_seconds
        closing = (ends <= F.unix_seconds(facts.at(closes))) & (F.lit(True) if mark is None else ends > F.unix_seconds(facts.at(mark)))
        marked = changed.withColumn("correction", F.lit(True))
        given = (sums_since.groupBy("ts").agg(
            *[F.sum(F.when(F.col("status") == s, F.col("cnt")).otherwise(0)).cast("bigint").alias(s) for s in statuses],
            F.sum("cnt").alias("total"), F.sum("records").alias("records"), F.sum("late_records").alias("late_records"))
            .join(marked, "ts", "left").where(closing | F.col("correction"))
            .withColumn("version", F.lit(batch_id).cast("bigint")).withColumn("correction", F.coalesce("correction", F.lit(False))))
        put(given, "windows", batch_id)
        put(spark.range(1).select(facts.at(latest).alias("latest")), "marks", batch_id)
        known["latest"] = latest
        rows.unpersist()

    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_windows(spark: SparkSession, base: str, statuses: Sequence[str] = MONITORED_STATUSES) -> DataFrame:
    """Each window as last given out, with how often it was corrected."""
    rows = facts.output(spark, f"{base}/windows", windows_schema(statuses))
    values = [*statuses, "total", "records", "late_records"]
    return (rows.groupBy("ts").agg(F.max_by(F.struct(*values), "version").alias("w"),
                                   F.sum(F.col("correction").cast("bigint")).alias("corrections"))
            .select(F.col("ts").cast("timestamp_ntz").alias("ts"), "w.*", "corrections"))


def late_records(spark: SparkSession, base: str, name: str = "late") -> DataFrame:
    """Records put aside: ``late`` (counted as corrections) or ``dropped`` (not counted)."""
    return facts.output(spark, f"{base}/{name}", LATE)
