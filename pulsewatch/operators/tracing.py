"""Linking consumed records to the records that produced them.

A consumer runs in a trace of its own and carries the producer's trace and span
id (the ``traceparent`` header of the message) as a link.  A span id names one
produced record, so a link is an equi-join on both ids within a time bound, at
most one producer per consumer: never all pairs of a trace.  ``link_stream`` is the
same on two streams, as an interval join whose state is dropped by watermarks.

Of produced records with one span id (an at-least-once producer) the earliest
counts.  Records without a valid link and produced records that nobody consumed
within the bound are kept, and told apart by ``link``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONSUME_BUCKETS
from ..sources.messages import headers_to_map
from .metrics import duration_histogram

NO_TRACE, NO_SPAN = "0" * 32, "0" * 16
TRACEPARENT = "^[0-9a-f]{2}-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$"
#: Groups of ids that a stream's held records are kept in.
BUCKETS = 1024


def with_trace(records: DataFrame, headers: str = "headers", prefix: str = "") -> DataFrame:
    """``trace_id`` and ``span_id`` of the ``traceparent`` header; NULL when it is
    missing, malformed or all zeros."""
    keys, values = F.col(headers)["key"], F.col(headers)["value"]
    # Without a map where no key is NULL or comes again; looked up once a row.
    plain = (F.size(F.array_distinct(keys)) == F.size(keys)) & ~F.exists(keys, lambda k: k.isNull())
    carried = records.withColumn("_tp", F.when(plain, F.decode(F.get(values, (F.array_position(keys, "traceparent") - 1).cast("int")), "UTF-8"))
                                 .otherwise(headers_to_map(headers)["traceparent"]))
    named = carried.select("*", ((F.length("_tp") == 55) & F.col("_tp").rlike(TRACEPARENT)).alias("_laid"),
                           F.substring("_tp", 4, 32).alias("_trace"), F.substring("_tp", 37, 16).alias("_span"))
    known = F.col("_laid") & (F.col("_trace") != NO_TRACE) & (F.col("_span") != NO_SPAN)
    return named.select(*records.columns, F.when(known, F.col("_trace")).alias(f"{prefix}trace_id"),
                        F.when(known, F.col("_span")).alias(f"{prefix}span_id"))


def _sides(produced: DataFrame, consumed: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    p = produced.select(F.col("trace_id").alias("p_trace"), F.col("span_id").alias("p_span"), F.col(ts).alias("produced_ts"))
    c = consumed.select(F.col("producer_trace_id").alias("c_trace"), F.col("producer_span_id").alias("c_span"),
                        F.col(ts).alias("consumed_ts"), "consumer_id")
    return p, c


def _nothing(df: DataFrame) -> list[Column]:
    return [F.lit(None).cast(t).alias(n) for n, t in df.dtypes]


def _within(seconds: int) -> Column:
    return F.expr("p_trace = c_trace AND p_span = c_span AND consumed_ts >= produced_ts "
                  f"AND consumed_ts <= produced_ts + INTERVAL {int(seconds)} SECONDS")


def _linked(joined: DataFrame) -> DataFrame:
    stamp = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return joined.select(
        F.coalesce("p_trace", "c_trace").alias("trace_id"), F.coalesce("p_span", "c_span").alias("span_id"),
        F.col("produced_ts").cast("timestamp_ntz").alias("produced_ts"),
        F.col("consumed_ts").cast("timestamp_ntz").alias("consumed_ts"), "consumer_id",
        ((stamp("consumed_ts") - stamp("produced_ts")) / 1e6).alias("latency"),
        F.when(F.col("produced_ts").isNull(), "no producer").when(F.col("consumed_ts").isNull(), "no consumer")
        .otherwise("linked").alias("link"))


def link_traces(produced: DataFrame, consumed: DataFrame, max_seconds: int, ts: str = "ts") -> DataFrame:
    """One row per consumed record with its producer, and one per produced record
    without a consumer.

    ``produced``: (trace_id, span_id, ts); ``consumed``: (consumer_id, ts,
    producer_trace_id, producer_span_id).  ``latency`` is in seconds."""
    p, c = _sides(produced, consumed, ts)
    # Records without ids keep out of the shuffle by id: they match nothing.
    known = p.where("p_trace IS NOT NULL AND p_span IS NOT NULL").groupBy("p_trace", "p_span").agg(F.min("produced_ts").alias("produced_ts"))
    may = F.col("c_trace").isNotNull() & F.col("c_span").isNotNull()
    out = known.join(c.where(may), _within(max_seconds), "full_outer")
    lone_p = p.where("p_trace IS NULL OR p_span IS NULL").select("*", *_nothing(c))
    lone_c = c.where(~may).select(*_nothing(p), "*")
    return _linked(out.unionByName(lone_p).unionByName(lone_c))


#: The stamp of a record that has none.
NEVER = -2**63


def _held_links(bound: int, again: int):
    """Links of one bucket of ids: new records against the held ones, then what the
    watermark has passed goes.  ``bound``: the time bound, ``again``: how long a span id
    that comes again is dropped, both in microseconds."""
    def links(key, chunks, state):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds = {"trace": pa.string(), "span": pa.string(), "consumer": pa.string(), "hash": pa.int64(), "micros": pa.int64(), "consumed": pa.bool_()}
        new, parts, fresh_from = [] if state.hasTimedOut else [c for c in chunks if len(c)], [], 0
        mark = state.getCurrentWatermarkMs() * 1000
        if state.exists:
            with pa.ipc.open_stream(pa.py_buffer(state.get[0])) as r:
                parts.append(r.read_all())
            fresh_from = parts[0].num_rows
        lone = []
        for c in new:
            # Without ids or stamp: given out as they come.
            alone = pa.array(c["lone"])
            t = pa.table({n: pa.array(c[n], k, from_pandas=True) for n, k in kinds.items()})
            if pc.any(alone).as_py():
                lone.append(t.filter(alone))
                t = t.filter(pc.invert(alone))
            parts.append(t.append_column("hit", pa.array(np.zeros(t.num_rows, dtype=bool))))
        if not parts:
            return
        rows = pa.concat_tables(parts).combine_chunks()
        hashes, micros = (rows[c].to_numpy() for c in ("hash", "micros"))
        consumed, hit = (rows[c].to_numpy().copy() for c in ("consumed", "hit"))
        fresh = np.arange(len(hashes)) >= fresh_from
        live = np.ones(len(hashes), dtype=bool)

        def pairs(a, b):
            """Places of ``a`` and ``b`` with the same ids: by their hash, then the ids themselves."""
            both = pd.DataFrame({"hash": hashes[a], "a": a}).merge(pd.DataFrame({"hash": hashes[b], "b": b}), on="hash")
            x, y = both["a"].to_numpy(), both["b"].to_numpy()
            same = [pc.equal(rows[c].take(pa.array(x)), rows[c].take(pa.array(y))).to_numpy() for c in ("trace", "span")]
            same = same[0].astype(bool) & same[1].astype(bool)
            return x[same], y[same]

        out = []

        def give(p=None, c=None):
            at = c if p is None else p
            if len(at):
                part = rows.take(pa.array(at))
                none = np.full(len(at), NEVER)
                out.append(pa.table({
                    "trace": part["trace"], "span": part["span"], "produced": none if p is None else micros[p],
                    "consumed": none if c is None else micros[c],
                    "consumer": pa.nulls(len(at), pa.string()) if c is None else part["consumer"] if p is None else rows["consumer"].take(pa.array(c))}))

        for t in lone:
            out.append(pa.table({"trace": t["trace"], "span": t["span"], "produced": np.full(t.num_rows, NEVER),
                                 "consumed": t["micros"], "consumer": t["consumer"]}))
        if new:
            # Of produced records with one span id the earliest counts.
            made = np.flatnonzero(fresh & ~consumed)
            made = made[np.argsort(micros[made], kind="stable")]
            if len(np.unique(hashes[made])) < len(made):
                order = np.empty(len(hashes), dtype="int64")
                order[made] = np.arange(len(made))
                first, second = pairs(made, made)
                live[second[order[first] < order[second]]] = False
            live[pairs(np.flatnonzero(~fresh & ~consumed & (micros + again > mark)), made)[1]] = False
            for ps, cs in ((fresh, live), (~fresh, fresh)):
                p, c = pairs(np.flatnonzero(live & ~consumed & ps), np.flatnonzero(consumed & cs))
                near = (micros[c] >= micros[p]) & (micros[c] <= micros[p] + bound)
                p, c = p[near], c[near]
                hit[p] = hit[c] = True
                give(p, c)
        last = np.where(consumed, micros, micros + bound)  # may match until the watermark is there
        over = live & (last <= mark)
        give(p=np.flatnonzero(over & ~hit & ~consumed))
        give(c=np.flatnonzero(over & ~hit & consumed))
        keep = live & ~over
        if keep.any():
            if new or over.any():
                held = rows.set_column(rows.schema.get_field_index("hit"), "hit", pa.array(hit)).filter(pa.array(keep))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
                    w.write_table(held)
                state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(int(last[keep].min()) // 1000, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        for t in out:
            yield t.to_pandas()

    return links


def link_stream(produced: DataFrame, consumed: DataFrame, max_seconds: int, delay: str = "2 minutes",
                consumer_delay: str | None = None, ts: str = "ts", buckets: int = BUCKETS) -> DataFrame:
    """``link_traces`` of two streams.  A produced record is held until the
    consumers' watermark passes its time bound, a consumed one until the
    producers' watermark passes it; then what found no partner is given out.

    Records are held by bucket of ids, one compressed Arrow table per bucket, and joined
    there as columns: a state row per record and index costs many times more.  A bucket
    passes through one task's memory, so take more ``buckets`` for a stream that holds
    more (not under the same checkpoint).  Records that match nothing, without ids or
    stamp, are not held, and consumed ones are spread over all buckets."""
    p, c = _sides(produced, consumed, ts)
    may_p = F.expr("p_trace IS NOT NULL AND p_span IS NOT NULL AND produced_ts IS NOT NULL")
    may_c = F.expr("c_trace IS NOT NULL AND c_span IS NOT NULL AND consumed_ts IS NOT NULL")
    p_type, c_type, id_type = dict(p.dtypes)["produced_ts"], dict(c.dtypes)["consumed_ts"], dict(c.dtypes)["consumer_id"]

    def side(df: DataFrame, at: str, trace: str, span: str, lone: Column, consumer: Column) -> DataFrame:
        number = F.when(lone, F.xxhash64(consumer, at)).otherwise(F.xxhash64(trace, span))
        return df.select(
            number.alias("hash"), F.col(trace).alias("trace"), F.col(span).alias("span"), F.lit(df is c).alias("consumed"),
            F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(NEVER)).alias("micros"),
            consumer.cast("string").alias("consumer"), lone.alias("lone"), F.col(at).alias("at")
        ).withColumn("bucket", F.pmod("hash", F.lit(buckets)))

    known = p.withWatermark("produced_ts", delay).where(may_p)
    c = c.withWatermark("consumed_ts", consumer_delay or delay)
    both = side(known, "produced_ts", "p_trace", "p_span", F.lit(False), F.lit(None)).unionByName(
        side(c, "consumed_ts", "c_trace", "c_span", ~may_c, F.col("consumer_id")))
    again = produced.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL '{delay}')").first()[0]
    found = both.groupBy("bucket").applyInPandasWithState(
        _held_links(max_seconds * 1_000_000, again), "trace string, span string, produced bigint, consumed bigint, consumer string",
        "held binary", "append", "EventTimeTimeout")
    stamp = lambda c: F.timestamp_micros(F.when(F.col(c) != NEVER, F.col(c)))
    links = found.select(
        F.col("trace").alias("p_trace"), F.col("span").alias("p_span"), stamp("produced").cast(p_type).alias("produced_ts"),
        F.col("trace").alias("c_trace"), F.col("span").alias("c_span"), stamp("consumed").cast(c_type).alias("consumed_ts"),
        F.col("consumer").cast(id_type).alias("consumer_id"))
    return _linked(links.unionByName(p.where(~may_p).select("*", *_nothing(c))))


def link_summary(links: DataFrame, buckets: Sequence[float] = CONSUME_BUCKETS) -> DataFrame:
    """Records per kind of link, with the cumulative latency histogram of the linked ones."""
    counts = links.groupBy("link").agg(F.count(F.lit(1)).alias("records"))
    found = duration_histogram(links.where("link = 'linked'"), "latency", ["link"], buckets)
    return counts.join(found.select("link", "le", "bucket_count"), "link", "left")
