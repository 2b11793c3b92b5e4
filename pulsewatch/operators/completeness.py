"""Which stamps a series should have and hasn't, for many series, from bitmaps.

The stamps of a (key, block of 32,768 units) are bits of one bitmap, built by a bitmap
aggregate with partial sums, so a block has one row whatever its input; what is missing is
what the complement holds within the series' own bounds.  No grid of expected stamps is
built or joined: only missing stamps are ever made rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import unit_seconds

#: Bits of Spark's bitmaps.
BLOCK = 32768


def stamp_bitmaps(df: DataFrame, unit: str = "MINUTE", keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """(keys, block, bits, present, lo, hi): the units from the epoch that have rows, as bits
    from ``block * BLOCK`` on, and the first and last unit of the whole series."""
    keys = list(keys)
    u = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(unit_seconds(unit)))
    rows = df.where(F.col(ts).isNotNull()).select(*keys, u.alias("_u"))
    at = F.col("_u") - F.floor(F.col("_u") / F.lit(BLOCK)) * F.lit(BLOCK)
    blocks = rows.groupBy(*keys, F.floor(F.col("_u") / F.lit(BLOCK)).alias("block")).agg(
        F.bitmap_construct_agg(at).alias("bits"), F.min("_u").alias("_first"), F.max("_u").alias("_last"))
    bounds = blocks.groupBy(*keys).agg(F.min("_first").alias("lo"), F.max("_last").alias("hi"))
    # Blocks without any row, between the first and the last.
    every = bounds.select("*", F.explode(F.sequence(F.floor(F.col("lo") / F.lit(BLOCK)), F.floor(F.col("hi") / F.lit(BLOCK)))).alias("block"))
    return (every.join(blocks.select(*keys, "block", "bits"), [*keys, "block"], "left")
            .withColumn("present", F.coalesce(F.bitmap_count("bits"), F.lit(0))))


def _span():
    """First and last unit of the series within a block."""
    start = F.col("block") * F.lit(BLOCK)
    return F.greatest(F.col("lo"), start), F.least(F.col("hi"), start + F.lit(BLOCK - 1))


def completeness(df: DataFrame, unit: str = "MINUTE", keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """(keys, n_expected, n_present, n_missing, min_ts, max_ts) of each series between its first and last stamp."""
    stamp = lambda c: F.timestamp_seconds(F.col(c) * F.lit(unit_seconds(unit))).cast("timestamp_ntz")
    lo, hi = _span()
    n = stamp_bitmaps(df, unit, keys, ts).groupBy(*keys).agg(
        F.sum(hi - lo + 1).alias("n_expected"), F.sum("present").alias("n_present"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return n.where("lo IS NOT NULL").select(*keys, "n_expected", "n_present", (F.col("n_expected") - F.col("n_present")).alias("n_missing"),
                    stamp("lo").alias("min_ts"), stamp("hi").alias("max_ts"))


def missing_stamps(df: DataFrame, unit: str = "MINUTE", keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """(keys, ts) of every stamp that a series lacks between its first and last one."""
    lo, hi = _span()
    # A byte of the bitmap holds eight units, the lowest bit first.
    byte = lambda at: F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    start = F.col("block") * F.lit(BLOCK)
    held = stamp_bitmaps(df, unit, keys, ts).withColumn("_a", lo - start).withColumn("_b", hi - start)
    held = held.where(F.col("present") < F.col("_b") - F.col("_a") + 1)
    # Bytes first: a full one is passed over without looking at its bits.
    bytes_ = held.select(*keys, "block", "_a", "_b", "bits", F.explode(F.sequence(F.floor(F.col("_a") / 8), F.floor(F.col("_b") / 8))).alias("_i"))
    value = F.when(F.col("bits").isNull(), F.lit(0)).otherwise(byte(F.col("_i") * 8))
    open_ = bytes_.select(*keys, "block", "_a", "_b", "_i", value.alias("_v")).where("_v < 255")
    bit = open_.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_bit"))
    at = F.col("_i") * 8 + F.col("_bit")
    return (bit.where((F.expr("getbit(_v, _bit)") == 0) & (at >= F.col("_a")) & (at <= F.col("_b")))
            .select(*keys, F.timestamp_seconds((start + at) * F.lit(unit_seconds(unit))).cast("timestamp_ntz").alias(ts)))


def quality_frame(datasets: Sequence[tuple], left: tuple | None = None, unit: str = "HOUR", keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """One report of several tables, a row per (dataset, keys, measure) with its figure:
    rows, null cells, repeated rows, negative values, categories, stamps present and
    missing, and, between the first two, stamps whose totals differ.

    ``datasets``: (name, frame, key columns, category column); ``left``: (name, left frame,
    right frame) of (keys, ts, total) totals to reconcile."""
    from .quality import reconcile
    keys, out = list(keys), None
    for name, df, key, category in datasets:
        cols = df.columns
        nulls = sum((F.sum(F.col(c).isNull().cast("bigint")) for c in cols[1:]), F.sum(F.col(cols[0]).isNull().cast("bigint")))
        per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), nulls.alias("null_cells"),
                                    F.coalesce(F.sum((F.col("cnt") < 0).cast("bigint")), F.lit(0)).alias("negative_values"),
                                    F.countDistinct(category).alias("categories"))
        again = df.groupBy(*dict.fromkeys([*keys, *key])).agg((F.count(F.lit(1)) - 1).alias("n")).groupBy(*keys).agg(F.sum("n").alias("repeated_rows"))
        stamps = completeness(df, unit, keys, ts).select(*keys, F.col("n_present").alias("stamps"), F.col("n_missing").alias("missing_stamps"))
        for part, names in ((per, ("rows", "null_cells", "negative_values", "categories")), (again, ("repeated_rows",)), (stamps, ("stamps", "missing_stamps"))):
            out = _measures(out, part, keys, name, names)
    if left is not None:
        name, a, b = left
        out = _measures(out, reconcile(a, b, ts, keys), keys, name, ("n_left", "n_right", "n_mismatch", "left_total", "right_total"))
    return out


def _measures(out: DataFrame | None, part: DataFrame, keys: list[str], name: str, names: Sequence[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("bigint").alias("value")) for n in names]))
    rows = part.select(*keys, F.lit(name).alias("dataset"), each.alias("m")).select("dataset", *keys, "m.*")
    return rows if out is None else out.unionByName(rows)
