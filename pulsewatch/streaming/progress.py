"""Running metrics: what each micro-batch counted and how long it took.

The records are counted inside the query itself (``observe``: one pass, no job of its
own), and a listener writes a row per micro-batch as it ends, with the figures observed
and the durations of its steps.  Counters are sums over these rows, gauges the latest
of them, and the durations fill the latency histograms.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..config import CONSUME_BUCKETS, INSERT_BUCKETS, MONITORED_STATUSES
from ..operators.metrics import duration_histogram

NAME = "ingest"
PROGRESS = "query string, batch_id bigint, input_rows bigint, figures map<string, bigint>, durations map<string, double>"


def observed(records: DataFrame, statuses: Sequence[str] = MONITORED_STATUSES) -> DataFrame:
    """Count records (status, cnt) on their way: ``records``, ``cnt`` and the count of each status."""
    return records.observe(NAME, F.count(F.lit(1)).alias("records"), F.sum("cnt").alias("cnt"), *[
        F.sum(F.when(F.col("status") == s, F.col("cnt"))).alias(s) for s in statuses])


class ProgressTable(StreamingQueryListener):
    """Writes PROGRESS rows under ``path``, a folder per query and micro-batch: one that
    is reported again replaces its row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(NAME)
        figures = {k: int(v or 0) for k, v in seen.asDict().items()} if seen is not None else {}
        if not p.numInputRows and not figures.get("records"):
            return
        row = (str(p.id), p.batchId, p.numInputRows, figures, {k: v / 1000 for k, v in p.durationMs.items()})
        (self.spark.createDataFrame([row], PROGRESS).drop("query", "batch_id").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/query={p.id}/batch_id={p.batchId}"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, query, seconds: float = 60) -> None:
        """Until the query has ended and all it reported is written."""
        query.awaitTermination()
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no end of query {query.id} within {seconds} s")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).parquet(path)


def running_counters(progress: DataFrame) -> DataFrame:
    """(metric, total, latest): sums over all micro-batches, and the last one's figure."""
    rows = progress.select("batch_id", F.explode("figures").alias("metric", "value"))
    return rows.groupBy("metric").agg(F.sum("value").alias("total"), F.max_by("value", "batch_id").alias("latest"))


def running_durations(progress: DataFrame) -> DataFrame:
    """Cumulative histograms of the seconds of a micro-batch (``consume``) and of
    running and writing it (``insert``)."""
    out = [duration_histogram(progress.select(F.lit(name).alias("operation"), F.col("durations")[step].alias("s")), "s", ["operation"], buckets)
           for name, step, buckets in (("consume", "triggerExecution", CONSUME_BUCKETS), ("insert", "addBatch", INSERT_BUCKETS))]
    return out[0].unionByName(out[1])
