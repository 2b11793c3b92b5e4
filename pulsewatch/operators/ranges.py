"""Averages of a series over given periods, which may overlap and be of any length.

A period isn't compared with the rows inside it.  The series is summed once at several
grains, each ``radix`` times the one below, on a grid from the epoch; a period is cut
into the fewest grid cells that tile it exactly, at most ``2 * (radix - 1)`` of a grain, and its cells are
looked up by an equi-join.  So a period of years costs hardly more than one of days,
and no join is by inequality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import unit_seconds


def _cells(first, end, level: int, levels: int, radix: int):
    """Cells of a grain that tile ``[first, end)`` units and that no coarser grain covers.
    Within ``level`` a cell is numbered by its start over its size."""
    size = radix ** level
    lo, hi = F.ceil(first / F.lit(size)), F.floor(end / F.lit(size))  # whole cells [lo, hi)
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    if level == levels - 1:
        return run(lo, hi)
    up_lo, up_hi = F.ceil(first / F.lit(size * radix)) * radix, F.floor(end / F.lit(size * radix)) * radix
    split = F.concat(run(lo, F.least(up_lo, hi)), run(F.greatest(up_hi, lo), hi))
    return F.when(up_lo < up_hi, split).otherwise(run(lo, hi))


def range_averages(series: DataFrame, periods: DataFrame, unit: str = "MINUTE", start: str = "start_ts", end: str = "end_ts",
                   value: str = "total", ts: str = "ts", keys: Sequence[str] = (), radix: int = 16, levels: int = 5) -> DataFrame:
    """``periods`` with ``n_stamps``, ``sum_volume`` and ``avg_volume`` over the stamps of the
    series in ``[start, end]`` (inclusive, by unit); 0, NULL, NULL where there are none, the
    bounds are NULL, or the end is before the start.  Repeated periods have a row each.

    ``levels`` grains: beyond ``unit * radix ** levels`` a period takes cells of the coarsest.
    """
    step, keys = unit_seconds(unit), list(keys)
    units = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / F.lit(step))
    base = series.groupBy(*keys, units(ts).alias("_u")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    grains = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.floor(F.col("_u") / F.lit(radix ** lv)).alias("cell")) for lv in range(levels)]))
    sums = (base.select(*keys, "_s", "_n", grains.alias("g")).groupBy(*keys, F.col("g.level").alias("_level"), F.col("g.cell").alias("_cell"))
            .agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")))
    # Equal periods are looked up once.
    spans = periods.select(*keys, units(start).alias("_a"), (units(end) + 1).alias("_b")).where("_a < _b").distinct()
    leveled = lambda lv: lambda c: F.struct(F.lit(lv).alias("_level"), c.alias("_cell"))
    cells = F.concat(*[F.transform(_cells(F.col("_a"), F.col("_b"), lv, levels, radix), leveled(lv)) for lv in range(levels)])
    tiles = spans.select(*keys, "_a", "_b", F.explode(cells).alias("t")).select(*keys, "_a", "_b", "t._level", "t._cell")
    found = (tiles.join(sums, [*keys, "_level", "_cell"]).groupBy(*keys, "_a", "_b")
             .agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")))
    out = periods.withColumn("_a", units(start)).withColumn("_b", units(end) + 1).join(found, [*keys, "_a", "_b"], "left")
    return out.select(*[F.col(c) for c in periods.columns], F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_stamps"),
                      F.col("_s").alias("sum_volume"),
                      F.when(F.col("_n") > 0, F.col("_s").cast("double") / F.col("_n")).alias("avg_volume"))
