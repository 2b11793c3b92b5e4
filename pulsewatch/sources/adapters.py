"""Derive the monitoring views from the generic test tables.

The driver's tables hold no payment records, so each view is a Spark job over
them (their work grows with the tables):

* ``transactions(ts, status, cnt)`` - ``events`` counted per time unit and
  status, with the event type standing in for the payment status.
* ``transactions_daily`` - ``orders`` counted per order date and status.
* ``auth_codes(ts, auth_code, cnt)`` - approved/denied events with an
  authorisation code: ``'00'`` for approvals, ``'01'..'07'`` for denials
  (from the ``k`` property).
* ``raw_records`` - one record per event (before validation).
* ``checkout_data`` - hourly checkout snapshots (see
  :func:`pulsewatch.operators.checkout.build_baselines`).

Identical SQL for each view lives in ``pulsewatch.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import unit_seconds

# --- Fixed mapping of the test tables onto payment statuses ------------------
EVENT_STATUS = (
    ("purchase", "approved"),
    ("view", "denied"),
    ("error", "failed"),
    ("click", "reversed"),
    ("signup", "backend_reversed"),
)
ORDER_STATUS = (("F", "approved"), ("O", "denied"), ("P", "failed"))
# --- end of fixed mapping -----------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(c: Column, pairs, default=None) -> Column:
    out = None
    for src, dst in pairs:
        out = F.when(c == src, dst) if out is None else out.when(c == src, dst)
    return out.otherwise(default) if default is not None else out


def event_status(c: Column | str = "event_type") -> Column:
    return _case(F.col(c) if isinstance(c, str) else c, EVENT_STATUS)


def truncate(ts: Column | str, unit: str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(unit.lower(), c).cast("timestamp_ntz")


def transactions(spark: SparkSession, sf_dir: str, unit: str = "HOUR") -> DataFrame:
    return _counted(table(spark, sf_dir, "events"), unit)


def recent_transactions(spark: SparkSession, sf_dir: str, units: int, unit: str = "HOUR") -> DataFrame:
    """``transactions`` over the trailing window (both ends inclusive), with the
    bound as a literal on the stored column, so that the scan is given it: files
    and row groups (and date partitions, where the table has them) outside are
    not read.  The anchor is one value, the latest raw stamp."""
    ev = table(spark, sf_dir, "events")
    latest = ev.agg(F.max("ts").alias("ts")).select(
        (F.date_trunc(unit.lower(), "ts").cast(ev.schema["ts"].dataType)
         - F.expr(f"INTERVAL {units * unit_seconds(unit)} SECONDS")).cast("string")).first()[0]
    if latest is not None:
        ev = ev.filter(F.col("ts") >= F.lit(latest).cast(ev.schema["ts"].dataType))
    return _counted(ev, unit)


def _counted(ev: DataFrame, unit: str) -> DataFrame:
    return (ev.select(truncate("ts", unit).alias("ts"), event_status().alias("status"))
            .groupBy("ts", "status").agg(F.count(F.lit(1)).alias("cnt")))


def shop_transactions(spark: SparkSession, sf_dir: str, shops: int = 4, unit: str = "HOUR") -> DataFrame:
    """Several series: ``transactions`` per shop (a class of user ids)."""
    ev = table(spark, sf_dir, "events")
    return (ev.select((F.col("user_id") % shops).alias("shop"), truncate("ts", unit).alias("ts"), event_status().alias("status"))
            .groupBy("shop", "ts", "status").agg(F.count(F.lit(1)).alias("cnt")))


def faulty_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per event, with faults by the last digits of the event id."""
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id") % 20
    stamp = (F.when(k == 1, "garbage").when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
             .when(k == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(k == 4, F.lit(None))
             .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    q = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    count = F.when(k == 5, '"many"').when(k == 6, "null").when(k == 7, "-3").otherwise(F.col("event_id").cast("string"))
    status = F.when(k == 8, F.lit(None)).otherwise(event_status())
    text = F.concat(F.lit('{"records":[{"timestamp":'), q(stamp), F.lit(',"status":'), q(status), F.lit(',"count":'), count,
                    F.lit("}]}"))
    return ev.select("event_id", F.when(k == 9, "not json").when(k == 10, "{}").otherwise(text).alias("value"))


def transactions_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.select(truncate("o_orderdate", "DAY").alias("ts"),
                     _case(F.col("o_orderstatus"), ORDER_STATUS).alias("status"))
            .groupBy("ts", "status").agg(F.count(F.lit(1)).alias("cnt")))


def event_k(props: str = "props") -> Column:
    return F.regexp_extract(F.col(props), r'"k": *([0-9]+)', 1).cast("bigint")


def auth_codes(spark: SparkSession, sf_dir: str, unit: str = "HOUR") -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "view"))
    code = F.when(F.col("event_type") == "purchase", F.lit("00")).otherwise(
        F.lpad((F.lit(1) + event_k() % 7).cast("string"), 2, "0"))
    return (ev.select(truncate("ts", unit).alias("ts"), code.alias("auth_code"))
            .groupBy("ts", "auth_code").agg(F.count(F.lit(1)).alias("cnt")))


def shop_auth_codes(spark: SparkSession, sf_dir: str, shops: int = 4, unit: str = "HOUR") -> DataFrame:
    """Several series: ``auth_codes`` per shop.  The last shop's approvals have code '0',
    the one before has no approvals."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "view")).withColumn("shop", F.col("user_id") % shops)
    ev = ev.filter(~((F.col("shop") == shops - 2) & (F.col("event_type") == "purchase")))
    code = F.when(F.col("event_type") == "purchase", F.when(F.col("shop") == shops - 1, "0").otherwise("00")).otherwise(
        F.lpad((F.lit(1) + event_k() % 7).cast("string"), 2, "0"))
    return (ev.select("shop", truncate("ts", unit).alias("ts"), code.alias("auth_code"))
            .groupBy("shop", "ts", "auth_code").agg(F.count(F.lit(1)).alias("cnt")))


def shipping_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period per line item: from the day of its order to that of its shipping (which may lie before it)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", truncate("l_shipdate", "DAY").alias("end_ts"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", truncate("o_orderdate", "DAY").alias("start_ts"))
    return li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey")


def raw_records(spark: SparkSession, sf_dir: str, unit: str = "MINUTE") -> DataFrame:
    """One record per event: status from the event type with sign-ups as the
    unmonitored ``refunded``, count = floor(value) - 1 (negative below 1)."""
    ev = table(spark, sf_dir, "events")
    status = _case(F.col("event_type"), EVENT_STATUS[:4], "refunded")
    return ev.select(
        F.col("event_id").alias("record_id"),
        truncate("ts", unit).alias("ts"),
        status.alias("status"),
        (F.floor("value").cast("bigint") - 1).alias("cnt"),
    )


def checkout_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly checkout snapshots: one series per event type, measure =
    sum(floor(value)) per hour, with the day/week/month baselines."""
    from ..operators.checkout import build_baselines
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("snapshot"), "ts", F.floor("value").cast("bigint").alias("value"))
    return build_baselines(ev)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP request records derived from events: method by event type,
    path ``/events/<type>``, status code by value band."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/events/"), F.col("event_type")).alias("path"),
        F.when(F.col("value") < 1, 500).when(F.col("value") < 5, 404).otherwise(200).alias("status"),
        (F.col("value") / 1000.0).alias("duration"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON log lines built from conversation turns (whole texts); even
    conversations carry ``otelTraceID``/``otelSpanID``, odd ones the dotted
    ``otel.trace_id``/``otel.span_id`` spelling.  Every 13th conversation's lines
    are plain text."""
    c = table(spark, sf_dir, "conversations")
    tid = F.lpad(F.lower(F.hex("conv_id")), 32, "0")
    sid = F.lpad(F.lower(F.hex("turn")), 16, "0")
    even = F.col("conv_id") % 2 == 0
    rec = F.struct(
        (F.col("conv_id") * 60 + F.col("turn")).cast("double").alias("timestamp"),
        F.when(F.col("role") == "user", "INFO").when(F.col("role") == "assistant", "DEBUG")
        .otherwise("WARNING").alias("level"),
        F.concat(F.lit("chat."), F.col("role")).alias("logger"),
        F.col("text").alias("message"),
        F.when(even, tid).alias("otelTraceID"), F.when(even, sid).alias("otelSpanID"),
        F.when(~even, tid).alias("otel.trace_id"), F.when(~even, sid).alias("otel.span_id"))
    return c.select(F.when(F.col("conv_id") % 13 == 0, F.concat(F.lit("plain: "), F.coalesce("text", F.lit(""))))
                    .otherwise(F.to_json(rec)).alias("value"))


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message headers per order: a traceparent (flags '1' -- malformed --
    for status P), the priority as ``source``, and a NULL-valued entry."""
    o = table(spark, sf_dir, "orders")
    flags = F.when(F.col("o_orderstatus") == "P", "1").otherwise("01")
    tp = F.concat(F.lit("00-"), F.lpad(F.lower(F.hex("o_orderkey")), 32, "0"), F.lit("-"),
                  F.lpad(F.lower(F.hex("o_custkey")), 16, "0"), F.lit("-"), flags)
    h = F.array(F.struct(F.lit("traceparent").alias("key"), F.encode(tp, "UTF-8").alias("value")),
                F.struct(F.lit("source").alias("key"), F.encode(F.col("o_orderpriority"), "UTF-8").alias("value")),
                F.struct(F.lit("empty").alias("key"), F.lit(None).cast("binary").alias("value")))
    return o.select("o_orderkey", h.alias("headers"))


def traceparent_header(order: Column, flags: Column) -> Column:
    """Header array with the traceparent of an order's produced record."""
    tp = F.concat(F.lit("00-"), F.lpad(F.lower(F.hex(order)), 32, "0"), F.lit("-"),
                  F.lpad(F.lower(F.hex(order * 2 + 1)), 16, "0"), F.lit("-"), flags)
    return F.array(F.struct(F.lit("traceparent").alias("key"), F.encode(tp, "UTF-8").alias("value")))


def produced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One produced record per order: (ts, headers)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderdate").alias("ts"), traceparent_header(F.col("o_orderkey") + 1, F.lit("01")).alias("headers"))


def consumed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consumed record per line item: (consumer_id, ts, headers) with the
    header of its order's record.  Line items with a tax of 8 % carry a malformed header,
    returned ones that of an order that doesn't exist."""
    li = table(spark, sf_dir, "lineitem")
    order = F.col("l_orderkey") + F.when(F.col("l_returnflag") == "R", F.lit(1_000_000_000)).otherwise(1)
    flags = F.when(F.col("l_tax") >= 0.08, "1").otherwise("01")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("consumer_id"), F.col("l_shipdate").alias("ts"),
                     traceparent_header(order, flags).alias("headers"))


def supplier_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed series: line items shipped per supplier nation and week.

    Line items are first counted per (supplier, week), so the join with the
    supplier table and the final shuffle carry partial counts, not raw rows."""
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_suppkey", truncate("l_shipdate", "WEEK").alias("ts"))
          .agg(F.count(F.lit(1)).alias("n")))
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (li.join(su, li.l_suppkey == su.s_suppkey)
            .groupBy("s_nationkey", "ts").agg(F.sum("n").cast("bigint").alias("cnt")))
