"""Exact quantiles of many values, and mergeable sketches.

``exact_quantiles`` never brings a group's values together.  Equal values are counted
first; the distinct ones are spread by range over the cluster, each range counts its values
per group, and the counts of the ranges before tell every range which ranks it
holds.  A rank then lies in one range, where a running count picks its value.  What is
looked up across ranges is one row per (group, range).

``sketch`` keeps a KLL sketch per group instead: a bounded number of bytes, merged
with others of other days or tasks without the values (``merge_sketches``), and asked for
quantiles at any time; the rank error is about 1.65 % at the default ``k``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """(keys, n, q): the number of values and their quantiles in the order of ``probs``, linearly
    interpolated between the two nearest ranks.  NULLs don't count; a group of NULLs has no row."""
    spark, given = df.sparkSession, list(keys)
    ensure_checkpoint_dir(spark)
    keys = given or ["_all"]
    df = df if given else df.withColumn("_all", F.lit(0))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v"))
           .agg(F.count(F.lit(1)).alias("c")))
    # Written once: ranges are drawn from a sample, so a task that runs again must find its own.
    ranged = per.repartitionByRange(parts, *keys, "v").withColumn("range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*keys, "range").agg(F.sum("c").alias("held"))  # a row per group and range
    counts = counts.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    total = ranged.groupBy(*keys).agg(F.sum("c").alias("n"))
    # Ranks from 0 that each probability needs, and the range that holds each.
    at = [F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(probs)]
    wanted = total.select(*keys, "n", F.explode(F.array(*at)).alias("a")).select(*keys, "n", "a.i", "a.at")
    low, high = F.floor("at"), F.least(F.floor("at") + 1, F.col("n") - 1)
    wanted = wanted.withColumn("rank", F.explode(F.array(low, high)))
    wanted = wanted.select(*keys, "n", "i", "at", "rank").distinct()
    needed = counts.join(wanted, keys).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("held")))
    needed = needed.select(*keys, "range", "before", "n", "i", "at", "rank")
    upto = Window.partitionBy(*keys, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranged.withColumn("upto", F.sum("c").over(upto))
    picked = running.join(needed, [*keys, "range"]).where(
        (F.col("rank") < F.col("before") + F.col("upto")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("c")))
    share = F.col("at") - F.floor("at")
    each = picked.groupBy(*keys, "n", "i").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"), F.first(share).alias("s"))
    each = each.withColumn("q", F.when(F.col("s") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("s")))
    return each.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("l")).select(
        *given, "n", F.transform("l", lambda x: x["q"]).alias("q"))  # a list of len(probs)


def describe_exact(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per (keys, metric); no group's values meet in a task."""
    keys = list(keys)
    stacked = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select(*keys, "m.metric", "m.v")
    plain = stacked.groupBy(*keys, "metric").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    quart = exact_quantiles(stacked, "v", (0.25, 0.5, 0.75), [*keys, "metric"], parts).drop("n")
    return plain.join(quart, [*keys, "metric"], "left").select(
        *keys, "metric", "n", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"), "max")


def sketch(df: DataFrame, value: str, keys: Sequence[str] = (), k: int = 200) -> DataFrame:
    """(keys, n, sketch): a KLL sketch of a numeric column per group."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.kll_sketch_agg_double(v, k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sketches.where("n > 0").groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, q) from sketches, within their rank error."""
    q: Column = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs]))
    return sketches.select(*keys, "n", q.alias("q"))
