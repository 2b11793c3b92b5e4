"""Structured Streaming: ingest of JSON batch messages, per-unit windowed
counts with a watermark, and the periodic alert check (keyed state: ``state``).

Sources are any text stream of JSON messages (Kafka ``value`` cast to string
in production; a folder of text files here, the Kafka connector not being on
this classpath).  Every query takes an explicit checkpoint location under the
shared ``spark.checkpoint.dir``; sinks are idempotent per micro-batch (files
by the streaming file sink, ``foreachBatch`` outputs keyed by ``batch_id``),
so a restarted query after an executor or driver loss neither loses nor
duplicates rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import MONITORED_STATUSES, PolicyParams, unit_seconds
from ..sources.messages import decode_batches, encode_batches
from . import facts
from .state import rocksdb


#: How long late records are waited for.
DELAY = "2 minutes"


def write_messages(tx: DataFrame, path: str, flush_seconds: int | None = None, append: bool = False) -> None:
    """Replay source: messages written as text files in time order.

    ``flush_seconds``: a heartbeat (status ``heartbeat``, count 0) so long after the
    latest stamp closes the replay: it moves the watermark past all windows that hold
    records, and its own window stays open.
    """
    (encode_batches(tx).repartitionByRange("ts").sortWithinPartitions("ts").select("message")
     .write.mode("append" if append else "overwrite").text(path))
    if flush_seconds is not None:
        beat = tx.agg((F.max("ts") + F.expr(f"INTERVAL {flush_seconds} SECONDS")).alias("ts")).select(
            "ts", F.lit("heartbeat").alias("status"), F.lit(0).cast("bigint").alias("cnt")).filter("ts is not null")
        encode_batches(beat).select("message").write.mode("append").text(path)


def replay(tx: DataFrame, path: str, part: Column, run: Callable, flush_seconds: int | None = None) -> None:
    """Replay in micro-batches: the rows of each ``part`` (a number) are written, by as many
    tasks as they need, and ``run()`` starts a query that takes what is new and ends."""
    parts = tx.withColumn("part", part).checkpoint()
    numbers = [r.part for r in parts.select("part").distinct().orderBy("part").collect()]
    for k, n in enumerate(numbers):
        write_messages(parts.filter(F.col("part") == n).drop("part"), path, append=k > 0,
                       flush_seconds=flush_seconds if n == numbers[-1] else None)
        run().awaitTermination()


def read_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Text stream of messages.  Files are taken in modification-time order,
    not event-time order, so with a watermark keep ``max_files`` unset (or
    large) on replays; a live source appends in time order."""
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def _start(writer, available_now: bool):
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def ingest(spark: SparkSession, src: str, out: str, dead: str, checkpoint: str,
           available_now: bool = True):
    """Continuous ingest: decode each micro-batch, append records (with
    ``ingested_at`` and ``batch_id``) and dead letters.  Each batch writes
    under its own ``batch_id`` folder in overwrite mode, so a replayed batch
    replaces its own output instead of duplicating it."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read three times
        good, bad = decode_batches(batch)
        (good.withColumn("ingested_at", F.current_timestamp().cast("timestamp_ntz"))
         .withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"))
        bad.write.mode("overwrite").parquet(f"{dead}/batch_id={batch_id}")
        # Running metrics: per-batch records and counts by status (the gauge is
        # the latest batch, the counters are sums over the batch folders).
        (good.groupBy("status").agg(F.count(F.lit(1)).alias("records"), F.sum("cnt").alias("cnt"))
         .withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{out}_counters/batch_id={batch_id}"))
        batch.unpersist()

    return _start(read_messages(spark, src).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint),
                  available_now)


def windowed_counts(stream: DataFrame, unit: str = "1 hour", delay: str = DELAY,
                    statuses: Sequence[str] = MONITORED_STATUSES, dedupe: bool = False) -> DataFrame:
    """Per-unit tumbling counts by status (wide) with a watermark: a window
    is emitted once the watermark passes its end (append mode).

    ``dedupe=True`` drops messages that come again within the watermark delay (an
    at-least-once producer): a record is known by its message and its place in it,
    so two genuine records of one stamp and status both count."""
    good, _ = decode_batches(stream, with_ids=True)
    good = good.withWatermark("ts", delay)
    if dedupe:
        good = good.dropDuplicatesWithinWatermark(["message_id", "place"])
    aggs = [F.sum(F.when(F.col("status") == s, F.col("cnt")).otherwise(F.lit(0))).cast("bigint").alias(s)
            for s in statuses]
    return (good.groupBy(F.window("ts", unit))
            .agg(*aggs, F.sum("cnt").cast("bigint").alias("total"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("ts"), *statuses, "total"))


def run_windowed_counts(spark: SparkSession, src: str, out: str, checkpoint: str,
                        unit: str = "1 hour", delay: str = DELAY, dedupe: bool = False):
    q = (windowed_counts(read_messages(spark, src), unit, delay, dedupe=dedupe).writeStream.outputMode("append")
         .format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    return q


FACTS = "ts timestamp, status string, cnt bigint"
ALERT = ("status string, severity string, current_value bigint, baseline_mean double, baseline_std double, z_score double, "
         "score double, alert_ts timestamp_ntz")
OUTPUTS = {
    "alerts": ALERT,
    "outbox": "status string, alert_ts timestamp_ntz, payload string",
    "dead": "raw string, reason string",
}
#: Fact folders of a day and alerts folders of a day before they are merged.
MOST_FOLDERS = 64


def read_facts(spark: SparkSession, base: str, first: dt.date, last: dt.date) -> DataFrame:
    """The records of the days from ``first`` to ``last``."""
    return facts.read(spark, f"{base}/facts", FACTS, facts.days(first, last))


def read_output(spark: SparkSession, base: str, name: str) -> DataFrame:
    """All rows of an output of ``alert_check``; empty if no check wrote any."""
    from ..operators.alerts import alert_log
    if name == "log":
        return alert_log(read_output(spark, base, "alerts"))
    if name == "gauges":  # score per status and overall
        details = facts.output(spark, f"{base}/details", "eval_ts timestamp_ntz, status string, z_score double, max_z_score double")
        scores = details.select("eval_ts", "status", F.col("z_score").alias("score"))
        overall = details.groupBy("eval_ts").agg(F.max("max_z_score").alias("score")).withColumn("status", F.lit("overall"))
        return scores.unionByName(overall)
    path = f"{base}/{name}/live" if name == "alerts" else f"{base}/{name}"
    return facts.output(spark, path, f"{OUTPUTS[name]}, batch_id bigint")


def alert_check(spark: SparkSession, src: str, base: str, checkpoint: str, params: PolicyParams = PolicyParams(),
                unit: str = "MINUTE", cooldown_seconds: int = 300, max_files: int | None = None,
                service: str = "monitor", available_now: bool = True):
    """Periodic check.  Each micro-batch is added to the fact table, the detector runs
    at the table's latest stamp over its history window, and what it finds is dispatched.

    Tables under ``base``: facts and alerts (fired; both by date first, see ``facts``),
    details, dead and outbox; ``read_output`` also derives the log and the gauges.  A check
    lists and reads the days of its window only, and merges their folders as they
    become many.  The cooldown is carried across batches by the fired alerts of the last
    ``cooldown_seconds``.  Every output is keyed by ``batch_id`` and overwritten by a
    replayed batch, which sees only the alerts of batches before it.

    What a check finds is at most a row per monitored status: it comes to the driver
    once and is written from there.
    """
    from ..operators.alerts import alert_candidates, outbox
    from ..operators.policy import policy_detect
    step = unit_seconds(unit)
    latest: dict[str, dt.datetime] = {}

    def put(df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")

    def anchor(newest: dt.datetime) -> dt.datetime:
        """The latest stamp of the table: this batch's or an earlier one's, which is
        looked up after a restart only."""
        if "ts" not in latest:
            day = facts.last_day(spark, f"{base}/facts")
            latest["ts"] = read_facts(spark, base, day, day).agg(F.max("ts").cast("timestamp_ntz")).first()[0]
        latest["ts"] = max(newest, latest["ts"])
        return latest["ts"]

    def check(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        good, bad = decode_batches(batch)
        seen, faults = Observation(), Observation()
        facts.put(good.observe(seen, F.max("ts").cast("timestamp_ntz").alias("newest")), f"{base}/facts", batch_id)
        lost = bad.persist()
        if lost.observe(faults, F.count(F.lit(1)).alias("n")).count():
            put(lost, "dead", batch_id)
        lost.unpersist()
        batch.unpersist()
        newest = seen.get["newest"]
        if newest is None:
            return
        at = anchor(newest)
        first = at - dt.timedelta(seconds=params.history_window * step)
        for day in facts.days(first.date(), at.date()):
            facts.compact(spark, f"{base}/facts", FACTS, day, batch_id - 1, MOST_FOLDERS)
            facts.compact(spark, f"{base}/alerts", ALERT, day, batch_id - 1, MOST_FOLDERS)
        window = read_facts(spark, base, first.date(), at.date()).filter(F.col("ts").between(facts.at(first), facts.at(at)))
        found = policy_detect(window.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "cnt"), params, unit)
        details = spark.createDataFrame(found.collect(), found.schema)  # a row per monitored status
        put(details, "details", batch_id)
        cands = alert_candidates(details, params.critical_threshold, params.z_score_threshold)
        fired = cands.select("status", "severity", "current_value", "baseline_mean", "baseline_std", "z_score",
                             F.col("max_z_score").alias("score"), F.col("eval_ts").alias("alert_ts"))
        if cooldown_seconds:
            recent = at - dt.timedelta(seconds=cooldown_seconds)
            before = facts.read(spark, f"{base}/alerts", ALERT, facts.days(recent.date(), at.date())).filter(
                (F.col("batch_id") < batch_id) & (F.col("alert_ts") > facts.at(recent).cast("timestamp_ntz")))
            fired = fired.join(before.select("status", "severity"), ["status", "severity"], "left_anti")
        rows = fired.collect()
        if rows:
            fired = spark.createDataFrame(rows, ALERT)
            facts.put(fired, f"{base}/alerts", batch_id, ts="alert_ts")
            put(outbox(fired, service), "outbox", batch_id)

    return _start(read_messages(spark, src, max_files).writeStream.foreachBatch(check)
                  .option("checkpointLocation", checkpoint), available_now)


def run_to_parquet(df: DataFrame, out: str, checkpoint: str):
    """Start ``availableNow`` into a parquet sink; state in RocksDB."""
    with rocksdb(df.sparkSession):
        return (df.writeStream.outputMode("append").format("parquet").option("path", out)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
