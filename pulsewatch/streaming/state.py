"""Keyed state on streams: cooldown, rolling baseline, near-zero periods.

Each operator is a ``transformWithState`` processor over rows that are already
small: alert candidates, or one row per series and unit from a window aggregate.
State lives in the RocksDB state store (``rocksdb``), is bounded per key, and
rows are taken in event-time order whatever order they arrive in, up to the
watermark.  The processors are classes made by functions, so that they travel to
the executors whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import MONITORED_STATUSES, OutageParams

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which
    ``transformWithState`` needs: a state larger than memory stays on disk."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


# --- cooldown ------------------------------------------------------------------------

def _cooldown(keys: Sequence[str], values: Sequence[str], value_schema: str, gap: int):
    class Cooldown(StatefulProcessor):
        """Candidates wait by time; a timer gives out those the watermark has
        passed, and a later one forgets a key that can't suppress any more."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "micros bigint")
            self.waiting = handle.getMapState("waiting", "micros bigint", "pick bigint, " + value_schema)

        def _wake(self, micros: int) -> None:
            self.handle.registerTimer(micros // 1000 + 1)  # in milliseconds, after the stamp

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            first = None
            for r in rows:
                at = (r["_micros"],)
                held = self.waiting.getValue(at) if self.waiting.containsKey(at) else None
                if held is None or r["_pick"] < held[0]:
                    self.waiting.updateValue(at, (r["_pick"], *[r[v] for v in values]))
                first = r["_micros"] if first is None else min(first, r["_micros"])
            if first is not None:
                self._wake(first)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            last = self.last.get()[0] if self.last.exists() else None
            times = sorted(k[0] for k in self.waiting.keys())
            done = [t for t in times if t < passed]
            for t in done:
                if last is None or t - last >= gap:
                    last = t
                    held = self.waiting.getValue((t,))
                    yield Row(**dict(zip(keys, key)), _micros=t, **dict(zip(values, held[1:])))
                self.waiting.removeKey((t,))
            if len(done) < len(times):
                self._wake(times[len(done)])
            if last is None:
                return
            if len(done) == len(times) and last + gap <= passed:
                self.last.clear()  # it can't suppress what is still to come
                return
            self.last.update((last,))
            if len(done) == len(times):
                self._wake(last + gap)

        def close(self) -> None:
            pass

    return Cooldown()


def cooldown_stream(candidates: DataFrame, cooldown_seconds: int = 300, delay: str = "2 minutes",
                    keys: Sequence[str] = ("status", "severity"), ts: str = "alert_ts") -> DataFrame:
    """Streaming cooldown per key: the rule of ``alerts.cooldown_filter``.

    Candidates are given out once the watermark (``delay`` behind the latest stamp)
    has passed them, in time order, so rows that arrive late within the delay
    suppress and are suppressed as if they had come in order; of candidates with one
    key and stamp one counts.  A key holds its waiting candidates and one stamp, and is
    forgotten when its cooldown is over.  All other columns are kept.
    """
    keys = list(keys)
    values = [c for c in candidates.columns if c not in keys and c != ts]
    types = dict(candidates.dtypes)
    schema = ", ".join(f"{v} {types[v]}" for v in values)
    timed = (candidates.withWatermark(ts, delay)
             .withColumn("_micros", F.unix_micros(ts)).withColumn("_pick", F.xxhash64(*candidates.columns)))
    out = ", ".join(f"{k} {types[k]}" for k in keys) + ", _micros bigint" + (", " + schema if schema else "")
    fired = timed.groupBy(*keys).transformWithState(
        _cooldown(keys, values, schema, round(cooldown_seconds * 1_000_000)), out, "Append", "EventTime")
    return fired.select(*keys, F.timestamp_micros("_micros").alias(ts), *values)


# --- rolling baseline ----------------------------------------------------------------

def _baseline(keys: Sequence[str], statuses: Sequence[str], step: int, history: int):
    class Baseline(StatefulProcessor):
        """The units of the window as a ring, with running sums of the counts and
        of their squares: a unit is added, the oldest are taken off again."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.ring = handle.getValueState("ring", "units array<struct<at bigint, counts array<bigint>>>")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            ring = [(u[0], list(u[1])) for u in self.ring.get()[0]] if self.ring.exists() else []
            sums = [sum(c) for c in zip(*(c for _, c in ring))] or [0] * len(statuses)
            squares = [sum(x * x for x in c) for c in zip(*(c for _, c in ring))] or [0] * len(statuses)

            def evicted(at: int) -> None:
                while ring and ring[0][0] < at - history * step:
                    _, old = ring.pop(0)
                    for i, x in enumerate(old):
                        sums[i] -= x
                        squares[i] -= x * x

            def row(at: int) -> Row:
                n, out = len(ring), {}
                for s, a, b in zip(statuses, sums, squares):
                    out[f"{s}_mean"] = a / n
                    out[f"{s}_std"] = (max(0, n * b - a * a) / (n * (n - 1))) ** 0.5 if n > 1 else None
                return Row(**dict(zip(keys, key)), at=at, n_history=n, **out)

            for at, counts in sorted((r["at"], [r[s] for s in statuses]) for r in rows):
                # Units without rows have windows too, as long as these hold any.
                for empty in range(ring[-1][0] + step, min(at, ring[-1][0] + (history + 1) * step), step) if ring else ():
                    evicted(empty)
                    yield row(empty)
                ring.append((at, counts))
                for i, x in enumerate(counts):
                    sums[i] += x
                    squares[i] += x * x
                evicted(at)
                yield row(at)
            if ring:
                self.ring.update((ring,))

        def close(self) -> None:
            pass

    return Baseline()


def rolling_baseline(records: DataFrame, unit: str = "1 hour", unit_seconds: int = 3600, history_units: int = 60,
                     delay: str = "2 minutes", keys: Sequence[str] = (), statuses: Sequence[str] = MONITORED_STATUSES) -> DataFrame:
    """Rolling baseline of a stream of records (keys, ts, status, cnt): per series and
    unit the number of units in ``[ts - history_units, ts]`` that have records, and the
    mean and sample deviation of each status over them.

    A series holds ``history_units + 1`` units, each record is counted in one; the sums
    are exact integers.  Like the batch baseline, units without records have a row
    while their window holds any."""
    keys = list(keys)
    types = dict(records.dtypes)
    per = records.withWatermark("ts", delay).groupBy(*keys, F.window("ts", unit)).agg(*[
        F.sum(F.when(F.col("status") == s, F.col("cnt")).otherwise(F.lit(0))).cast("bigint").alias(s) for s in statuses])
    by = keys or ["_series"]
    rows = per.select(*(keys or [F.lit(0).alias("_series")]), F.unix_seconds("window.start").alias("at"), *statuses)
    out = ", ".join([*(f"{k} {types[k]}" for k in keys), *([] if keys else ["_series int"]), "at bigint", "n_history bigint",
                     *(f"{s}_mean double, {s}_std double" for s in statuses)])
    done = rows.groupBy(*by).transformWithState(_baseline(by, statuses, unit_seconds, history_units), out, "Append", "None")
    return done.select(*keys, F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "n_history",
                       *[c for s in statuses for c in (f"{s}_mean", f"{s}_std")])


# --- near-zero periods ---------------------------------------------------------------

def _periods(keys: Sequence[str], step: int, threshold: int, max_gap: int):
    class Periods(StatefulProcessor):
        """The open period of a series, and what came after its last low unit: that
        belongs to it only if another low unit follows near enough."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getValueState(
                "open", "start bigint, last bigint, low bigint, units bigint, volume bigint, later_units bigint, later_volume bigint")

        def _row(self, key, p, state: str) -> Row:
            return Row(**dict(zip(keys, key)), start=p[0], last=p[1], outage_stamps=p[2], units=p[3], volume=p[4], state=state)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            p = list(self.open.get()) if self.open.exists() else None
            before = tuple(p[:5]) if p else None
            for at, total in sorted((r["at"], r["total"]) for r in rows):
                if p and at - p[1] > max_gap * step:
                    yield self._row(key, p, "closed")
                    p = None
                if total <= threshold:
                    if p is None:
                        p = [at, at, 0, 0, 0, 0, 0]
                    p = [p[0], at, p[2] + 1, p[3] + p[5] + 1, p[4] + p[6] + total, 0, 0]
                elif p:
                    p[5], p[6] = p[5] + 1, p[6] + total
            if p is None:
                self.open.clear()
                return
            self.open.update(tuple(p))
            self.handle.registerTimer((p[1] + (max_gap + 2) * step) * 1000)
            if before != tuple(p[:5]):
                yield self._row(key, p, "open" if before is None or before[0] != p[0] else "grown")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            p = self.open.get() if self.open.exists() else None
            if p is not None and (p[1] + (max_gap + 2) * step) * 1000 <= timerValues.getCurrentWatermarkInMs():
                self.open.clear()
                yield self._row(key, p, "closed")

        def close(self) -> None:
            pass

    return Periods()


def outage_events(records: DataFrame, unit: str = "1 hour", unit_seconds: int = 3600, delay: str = "2 minutes",
                  keys: Sequence[str] = (), params: OutageParams = OutageParams()) -> DataFrame:
    """Near-zero periods of a stream of records (keys, ts, cnt) as they happen: a row when
    a period opens, grows and is closed (``state``), each with the period so far and its
    average volume.  The latest row of a (keys, start_ts) is the period as known;
    once closed it equals the batch one.  State: one open period per series."""
    keys = list(keys)
    types = dict(records.dtypes)
    per = records.withWatermark("ts", delay).groupBy(*keys, F.window("ts", unit)).agg(F.sum("cnt").cast("bigint").alias("total"))
    by = keys or ["_series"]
    rows = per.select(*(keys or [F.lit(0).alias("_series")]), F.window_time("window").alias("_wt"),
                      F.unix_seconds("window.start").alias("at"), "total")
    out = ", ".join([*(f"{k} {types[k]}" for k in keys), *([] if keys else ["_series int"]), "start bigint", "last bigint",
                     "outage_stamps bigint", "units bigint", "volume bigint", "state string"])
    events = rows.groupBy(*by).transformWithState(
        _periods(by, unit_seconds, params.zero_threshold, params.max_gap), out, "Append", "EventTime")
    dur = ((F.col("last") - F.col("start")) / F.lit(unit_seconds)).cast("bigint") + 1
    stamp = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    return events.select(*keys, stamp("start").alias("start_ts"), stamp("last").alias("end_ts"), dur.alias("duration"),
                         "outage_stamps", (F.col("volume").cast("double") / F.col("units")).alias("avg_volume"),
                         F.when(dur >= params.critical_units, "CRITICAL").when(dur >= params.warning_units, "WARNING")
                         .otherwise("INFO").alias("severity"), "state")


def current_periods(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The latest row of each period of ``outage_events``; a closing row comes last."""
    rest = [c for c in events.columns if c not in (*keys, "start_ts")]
    order = F.struct(F.col("end_ts"), F.col("outage_stamps"), (F.col("state") == "closed").alias("closed"))
    return (events.groupBy(*keys, "start_ts").agg(F.max_by(F.struct(*rest), order).alias("p"))
            .select(*keys, "start_ts", "p.*"))
