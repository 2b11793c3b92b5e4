"""Near-zero volume periods (gaps-and-islands) with their average volume.

A stamp is an outage stamp when its total is ``<= zero_threshold``.  Outage
stamps no more than ``max_gap`` units apart belong to one period; duration is
``end - start + 1`` units; the period's average volume is over *every* stamp
inside ``[start, end]``, including non-outage stamps in the bridged gaps.

All of it is one ordered pass per key: running max/min of the outage stamps
tell each row whether it lies inside a bridged span and which period it
belongs to, so the range join "volume between start and end" becomes a
group-by on the period id (no join, nothing broadcast).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import OutageParams, unit_seconds


def outage_periods(volume: DataFrame, unit: str = "MINUTE", keys: Sequence[str] = (),
                   params: OutageParams = OutageParams(), value: str = "total",
                   ts: str = "ts", chunk_units: int | None = None) -> DataFrame:
    """Outage periods; ``chunk_units`` splits one long series into time chunks
    processed in parallel (exact: a two-level prefix scan, see below)."""
    step = unit_seconds(unit)
    gap = params.max_gap * step
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    is_out = F.col(value) <= F.lit(params.zero_threshold)
    base = volume.select(*keys, ts, value, sec.alias("_s"), is_out.alias("_out"))
    out_s = F.when(F.col("_out"), F.col("_s"))
    part = list(keys)
    carry_max = carry_min = None
    if chunk_units:
        # Two-level scan: per chunk, the latest outage stamp before it and the
        # earliest after it come from a chunk-level table (one row per chunk);
        # rows then combine their in-chunk running values with those carries.
        base = base.withColumn("_home", F.floor(F.col("_s") / F.lit(chunk_units * step)))
        wk = Window.partitionBy(*keys).orderBy("_home")
        wk_desc = Window.partitionBy(*keys).orderBy(F.desc("_home"))
        carries = (base.groupBy(*keys, "_home").agg(F.max(out_s).alias("_cmax"), F.min(out_s).alias("_cmin"))
                   .withColumn("_carry_max", F.max("_cmax").over(wk.rowsBetween(Window.unboundedPreceding, -1)))
                   .withColumn("_carry_min", F.min("_cmin").over(wk_desc.rowsBetween(Window.unboundedPreceding, -1)))
                   .select(*keys, "_home", "_carry_max", "_carry_min"))
        base = base.join(carries, [*keys, "_home"])
        part.append("_home")
        carry_max, carry_min = F.col("_carry_max"), F.col("_carry_min")
    w = Window.partitionBy(*part).orderBy("_s")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # "first outage stamp at or after this row" as a running min in descending
    # order: Spark computes running frames incrementally, whereas a
    # current-row-to-unbounded-following frame is recomputed for every row.
    after = (Window.partitionBy(*part).orderBy(F.desc("_s"))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def carried(local, carry):
        return local if carry is None else F.coalesce(local, carry)

    prev_out = carried(F.max(out_s).over(before), carry_max)
    starts = F.col("_out") & (prev_out.isNull() | (F.col("_s") - prev_out > F.lit(gap)))
    marked = (base
              .withColumn("_start", starts.cast("bigint"))
              .withColumn("_period", F.sum("_start").over(upto))
              .withColumn("_last_out", carried(F.max(out_s).over(upto), carry_max))
              .withColumn("_next_out", carried(F.min(out_s).over(after), carry_min)))
    if chunk_units:
        # Global period id = in-chunk running count + starts in earlier chunks.
        offsets = (marked.groupBy(*keys, "_home").agg(F.sum("_start").alias("_ns"))
                   .withColumn("_off", F.coalesce(F.sum("_ns").over(
                       Window.partitionBy(*keys).orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0)))
                   .select(*keys, "_home", "_off"))
        marked = (marked.join(offsets, [*keys, "_home"])
                  .withColumn("_period", F.col("_period") + F.col("_off")))
    inside = F.col("_out") | (F.col("_next_out") - F.col("_last_out") <= F.lit(gap))
    per = (marked.filter(inside).groupBy(*keys, "_period").agg(
        F.min(F.when(F.col("_out"), F.col(ts))).alias("start_ts"),
        F.max(F.when(F.col("_out"), F.col(ts))).alias("end_ts"),
        F.sum(F.col("_out").cast("bigint")).alias("outage_stamps"),
        F.avg(value).alias("avg_volume")))
    dur = ((F.unix_seconds(F.col("end_ts").cast("timestamp"))
            - F.unix_seconds(F.col("start_ts").cast("timestamp"))) / F.lit(step)).cast("bigint") + 1
    sev = (F.when(F.col("duration") >= params.critical_units, "CRITICAL")
           .when(F.col("duration") >= params.warning_units, "WARNING").otherwise("INFO"))
    return (per.withColumn("duration", dur).withColumn("severity", sev)
            .select(*keys, "start_ts", "end_ts", "duration", "outage_stamps", "avg_volume", "severity"))
