"""Batch messages: per-stamp JSON payloads ``{"records": [...]}``, their
decoding (with a dead-letter split), message headers and trace context.

The same ``decode_batches`` runs on a batch DataFrame and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("count", T.StringType()),  # any JSON value; checked when decoded
])
MESSAGE = T.StructType([T.StructField("records", T.ArrayType(RECORD))])
ISO = "yyyy-MM-dd'T'HH:mm:ss"


# Stamps that producers write: with T or a space, with or without a fraction.
STAMPS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm")


def encode_batches(tx: DataFrame, ts: str = "ts", records_per_message: int = 10_000) -> DataFrame:
    """Messages per stamp, records sorted by (status, count).

    Every record is kept.  A stamp with more than ``records_per_message`` records
    of one status and count becomes several messages, so that no message and no
    task holds an unbounded list: ``n`` numbers them.
    """
    same = Window.partitionBy(ts, "status", "cnt").orderBy(F.lit(0))
    n = F.floor((F.row_number().over(same) - 1) / records_per_message).cast("int")
    rec = F.struct(F.date_format(ts, ISO).alias("timestamp"), F.col("status"), F.col("cnt").alias("count"))
    return (tx.withColumn("n", n).groupBy(ts, "n").agg(F.sort_array(F.collect_list(rec)).alias("records"))
            .select(ts, F.to_json(F.struct("records")).alias("message")))


def parse_stamp(c: Column) -> Column:
    """TIMESTAMP of an ISO stamp, NULL if it isn't one."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), " ", "T"), r"(Z|[+]00:?00)$", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in STAMPS])


def decode_batches(messages: DataFrame, value: str = "value",
                   with_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON text -> ``(records, dead_letter)``.

    Dead letters are ``(raw, reason)``: whole messages that aren't JSON with a
    list of records (such text parses to a struct whose ``records`` is NULL), and
    single records whose stamp doesn't parse, whose status is missing, or whose
    count is missing, not a number or negative.  No message stops a query.
    ``with_ids`` adds ``message_id`` (the source's column of that name, else a hash
    of the text) and the record's ``place`` in its message.
    """
    ids = F.col("message_id") if "message_id" in messages.columns else F.xxhash64(value)
    p = messages.withColumn("_m", F.from_json(F.col(value), MESSAGE))
    whole = p.filter(F.col("_m.records").isNull()).select(
        F.col(value).alias("raw"), F.lit("no records").alias("reason"))
    r = (p.filter(F.col("_m.records").isNotNull()).select(ids.alias("message_id"), F.posexplode("_m.records").alias("place", "r"))
         .select("message_id", "place", parse_stamp(F.col("r.timestamp")).alias("ts"), F.col("r.status").alias("status"),
                 F.expr("try_cast(r.count AS BIGINT)").alias("cnt"), F.to_json("r").alias("raw")))
    reason = (F.when(F.col("ts").isNull(), "bad timestamp").when(F.col("status").isNull(), "no status")
              .when(F.col("cnt").isNull(), "bad count").when(F.col("cnt") < 0, "negative count"))
    r = r.withColumn("reason", reason)
    bad = whole.unionByName(r.filter(F.col("reason").isNotNull()).select("raw", "reason"))
    kept = ["ts", "status", "cnt"] + (["message_id", "place"] if with_ids else [])
    return r.filter(F.col("reason").isNull()).select(*kept), bad


# --- headers and trace context --------------------------------------------------

def headers_to_map(headers: str = "headers") -> Column:
    """``ARRAY<STRUCT<key, value BINARY>>`` -> ``MAP<STRING, STRING>``
    (pairs with a NULL value are dropped; bytes decoded as UTF-8)."""
    kept = F.filter(F.col(headers), lambda h: h["value"].isNotNull())
    return F.map_from_entries(F.transform(kept, lambda h: F.struct(
        h["key"].alias("key"), F.decode(h["value"], "UTF-8").alias("value"))))


def map_to_headers(m: str = "carrier") -> Column:
    return F.transform(F.map_entries(F.col(m)), lambda e: F.struct(
        e["key"].alias("key"), F.encode(e["value"], "UTF-8").alias("value")))


def parse_traceparent(tp: Column) -> Column:
    """``00-<32 hex>-<16 hex>-<2 hex>`` -> struct(version, trace_id, span_id,
    flags, valid); parts are NULL unless the layout and lengths hold."""
    parts = F.split(tp, "-")
    ok = ((F.size(parts) == 4) & (F.length(parts[0]) == 2) & (F.length(parts[1]) == 32)
          & (F.length(parts[2]) == 16) & (F.length(parts[3]) == 2)
          & tp.rlike("^[0-9a-f]{2}-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$"))
    return F.struct(F.when(ok, parts[0]).alias("version"), F.when(ok, parts[1]).alias("trace_id"),
                    F.when(ok, parts[2]).alias("span_id"), F.when(ok, parts[3]).alias("flags"),
                    F.coalesce(ok, F.lit(False)).alias("valid"))
