"""Target-distribution importance resampling (operator 13).

Documents are drawn so that their features are distributed like a target's.
Features are runs of one and two words, hashed to ``buckets`` buckets.  One pass
counts the buckets of all documents (each task returns an array of counts, a
partial aggregate adds them up), another those of the target; the log ratio of
the two smoothed distributions is one gain per bucket, an array that goes out with
the second pass, which scores every document by look-ups.  Gumbel noise keyed by
the document's id turns the highest scores into a draw without replacement in
proportion to the weights.

Ranks come from parallel sorting by regular sampling: tasks sort their runs,
regular samples of the sorted runs give splitters, rows are exchanged by the segment
between two splitters and merged there, and the counts of the segments before give
each its first rank.  The order is (score descending, doc_id, row), so ties, however many,
are split like other rows; segments beyond the draw aren't exchanged at all.  The
driver holds the gains, at most about ``SAMPLES`` samples plus one a task, and a
count per segment.

Defined results: a NULL or empty text has no features and weighs 0; a row with a
NULL id has no score, isn't counted among the eligible and is never drawn; rows
with one id are ranked each, in a fixed order; an empty target gains alike in all
buckets it lacks; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

# Words: runs of ASCII digits and letters and of anything beyond ASCII, which in
# UTF-8 is bytes from 0x80 on.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SAMPLES = 1 << 16
SEGMENT_ROWS = 1 << 20

SCORED = "doc_id bigint, n_features bigint, n_words bigint, weight bigint"


def features(text: str | None) -> tuple[np.ndarray, int]:
    """CRC-32 of each run of one or two words, and the number of words.

    The sum of a pair goes on from that of its first word and the space."""
    words = _WORD.findall((text or "").encode("utf-8", "replace").lower())  # bytes.lower: A-Z only
    if not words:
        return np.zeros(0, dtype=np.uint32), 0
    one = list(map(crc32, words))
    two = map(crc32, words[1:], map(crc32, repeat(b" "), one))
    return np.fromiter((*one, *two), np.uint32, 2 * len(words) - 1), len(words)


def bucket_counts(texts: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Features per bucket over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import resample as R
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(R.features(t.as_py())[0] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    found = texts.select(texts[text].cast("string")).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floor of 1000 times the log of a bucket's smoothed share of the target over its
    smoothed share of the documents."""
    n, m, b = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1) * (n + b) / ((s + 1) * (m + b))))
                     for s, t in zip(map(float, raw.tolist()), map(float, target.tolist()))], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str, doc_id: str) -> DataFrame:
    """SCORED of every row: the floored mean of its features' gains."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import resample as R
        for batch in batches:
            rows = []
            for t in batch.column(1):
                f, n = R.features(t.as_py())
                rows.append((len(f), n, int(gain[f % len(gain)].sum()) // len(f) if len(f) else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))],
                                             names=["doc_id", "n_features", "n_words", "weight"])

    return docs.select(docs[doc_id].cast("bigint"), docs[text].cast("string")).mapInArrow(run, SCORED)


def noise(doc_id: str, seed: str):
    """Floor of 1000 times a Gumbel variate keyed by the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def _regular(runs: DataFrame, stride: int) -> list[tuple]:
    """Every ``stride``-th row of each sorted run, the first by the number of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        skip = (TaskContext.get().partitionId() * 0x9E3779B1 + stride // 2) % stride
        for batch in batches:
            yield batch.take(pa.array(np.arange(skip, batch.num_rows, stride)))
            skip = (skip - batch.num_rows) % stride

    return [tuple(r) for r in runs.mapInArrow(run, "score bigint, doc_id bigint, row bigint").collect()]


def _segment(batch: pa.RecordBatch, splitters: list[tuple]) -> np.ndarray:
    """Number of splitters at or before each row in the order."""
    s = np.array(splitters, dtype=np.int64).reshape(-1, 3)
    n = batch.num_rows
    key = [np.concatenate([s[:, i], batch.column(c).to_numpy()]) for i, c in enumerate(("score", "doc_id", "row"))]
    late = np.concatenate([np.zeros(len(s), dtype=np.int8), np.ones(n, dtype=np.int8)])
    order = np.lexsort((late, key[2], key[1], -key[0]))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(late[order] == 0)
    return out[len(s):]


def _segmented(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import resample as R
        for batch in batches:
            yield batch.append_column("segment", pa.array(R._segment(batch, splitters), pa.int32()))

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, segment int")


def ranked(rows: DataFrame, drawn: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``rows`` (doc_id, row, score and others) with ``rank``: the place from 1 of the ``drawn``
    first by (score descending, doc_id, row), NULL for the others.  ``rows`` is a written
    table, so that a task that runs again sees the same rows."""
    spark = rows.sparkSession
    names = rows.columns
    n = rows.count()
    stride = max(1, n // SAMPLES)
    keys = ("score", "doc_id", "row")
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    samples = _regular(rows.select(*keys).sortWithinPartitions(*order), stride) if drawn else []
    samples.sort(key=lambda r: (-r[0], r[1], r[2]))
    segments = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // segment_rows)), len(samples) + 1)
    splitters = [samples[i * len(samples) // segments] for i in range(1, segments)]
    put = written(spark, _segmented(rows, splitters), "segments")
    sizes = {r["segment"]: r["count"] for r in put.groupBy("segment").count().collect()}  # a row per segment
    before, total = [], 0
    for s in range(segments):
        before.append(total)
        total += sizes.get(s, 0)
    last = max((s for s in range(segments) if before[s] < drawn), default=-1) if drawn else -1
    first = spark.createDataFrame([(s, before[s]) for s in range(last + 1)], "segment int, before bigint")
    merged = put.where(F.col("segment") <= last).withColumn(
        "place", F.row_number().over(Window.partitionBy("segment").orderBy(*order)))
    place = F.col("before") + F.col("place")
    inside = merged.join(F.broadcast(first), "segment").select(*names, F.when(place <= drawn, place).alias("rank"))
    return inside.unionByName(put.where(F.col("segment") > last).select(*names, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
             percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: str = "7:",
             segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row: ``percent`` of the rows
    with at least ``min_words`` words are drawn and ranked."""
    spark = docs.sparkSession
    ship(spark)
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    scored = weigh(docs, gain, text, doc_id).withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn(
        "row", F.monotonically_increasing_id())
    scored = written(spark, scored, "scored")
    may = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    eligible = scored.where(may)
    out = ranked(eligible, eligible.count() * percent // 100, segment_rows)
    left = scored.where(~may).withColumn("rank", F.lit(None).cast("bigint"))
    return out.unionByName(left).select("doc_id", "n_features", "weight", "score", "rank")
