"""Alert dispatch with per-key cooldown, alert counters and the outbox.

Dispatch rules: nothing when the evaluation's overall severity is NORMAL;
only anomalous details; per-detail severity from abs(2-dp z) (> critical ->
CRITICAL, > warning -> WARNING, otherwise no alert); an alert for key
(status, severity) is suppressed when the last *fired* alert of that key is
less than ``cooldown`` seconds earlier (a WARNING -> CRITICAL escalation has
another key and fires at once).

The cooldown is a sequential fold, computed exactly without one task per key:

1. a candidate at least ``cooldown`` after its predecessor always fires, so one
   ``lag`` per (key, time chunk) cuts every key into bursts; of candidates with
   one stamp only the first (by a hash of the row) can fire;
2. ``successor``: for each candidate, the first candidate of the same key at
   or after ``t + cooldown`` (sorted windows per (key, time chunk), with a
   second small pass for answers that lie in a later chunk);
3. the fired alerts are exactly the nodes reachable from the bursts' first
   candidates.  A node is live while its ``J = successor^(2^k)`` lies in its own burst;
   each round gives out the J-targets of reached live nodes and squares J by a
   self-join of the live ones.  Candidates that fire alone or end a chain drop out at
   once; rounds end when no target is left, so they follow the log2 of the longest
   burst and carry only what is undecided.

Times are in microseconds.  Every step is a join or a window per chunk, so a
hot key is spread by the shuffle (and by AQE's skew-join split).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .policy import detail_severity


def alert_candidates(details: DataFrame, critical: float = 4.0, warning: float = 2.5) -> DataFrame:
    """Anomalous details of non-NORMAL evaluations with their alert severity."""
    return (details.filter((F.col("overall_severity") != "NORMAL") & F.col("is_anomalous"))
            .withColumn("severity", detail_severity("z_score", critical, warning))
            .filter(F.col("severity").isin("CRITICAL", "WARNING")))


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


CHUNK_GAPS = 1024


def burst_starts(nodes: DataFrame, keys: Sequence[str], gap: int, chunk_gaps: int = CHUNK_GAPS) -> DataFrame:
    """``(keys, t)`` of the nodes without another of their key less than ``gap`` before."""
    n = nodes.withColumn("chunk", F.floor(F.col("t") / F.lit(gap * chunk_gaps)))
    before = Window.partitionBy(*keys).orderBy("chunk")  # one row per chunk
    carried = (n.groupBy(*keys, "chunk").agg(F.max("t").alias("last"))
               .withColumn("carry", F.lag("last").over(before)).drop("last"))
    within = n.withColumn("prev", F.lag("t").over(Window.partitionBy(*keys, "chunk").orderBy("t")))
    prev = F.coalesce("prev", "carry")
    return (within.join(carried, [*keys, "chunk"])
            .filter(prev.isNull() | (F.col("t") - prev >= F.lit(gap))).select(*keys, "t"))


def successor(nodes: DataFrame, keys: Sequence[str], gap: int, chunk_gaps: int = CHUNK_GAPS) -> DataFrame:
    """``(keys, t)`` -> ``(keys, t, nxt)``: nxt = min t' >= t + gap (same key)."""
    chunk = gap * chunk_gaps
    cand = nodes.select(*keys, F.col("t").alias("time"), F.lit(0).alias("kind"),
                        F.col("t").alias("cand"), F.lit(None).cast("bigint").alias("src"))
    probe = nodes.select(*keys, (F.col("t") + F.lit(gap)).alias("time"), F.lit(1).alias("kind"),
                         F.lit(None).cast("bigint").alias("cand"), F.col("t").alias("src"))
    u = cand.unionByName(probe).withColumn("chunk", F.floor(F.col("time") / F.lit(chunk)))
    w = (Window.partitionBy(*keys, "chunk").orderBy(F.desc("time"), F.asc("kind"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    res = (u.withColumn("found", F.last("cand", ignorenulls=True).over(w))
           .filter(F.col("kind") == 1).select(*keys, "chunk", F.col("src").alias("t"), "found"))
    # Answers in a later chunk: the minimum of the first non-empty chunk after it.
    mins = (cand.withColumn("chunk", F.floor(F.col("time") / F.lit(chunk)))
            .groupBy(*keys, "chunk").agg(F.min("cand").alias("cmin"))
            .select(*keys, "chunk", F.lit(1).alias("kind"), "cmin", F.lit(None).cast("bigint").alias("t")))
    miss = res.filter(F.col("found").isNull()).select(
        *keys, "chunk", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("cmin"), "t")
    w2 = (Window.partitionBy(*keys).orderBy(F.desc("chunk"), F.asc("kind"))
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = (mins.unionByName(miss).withColumn("nxt2", F.last("cmin", ignorenulls=True).over(w2))
             .filter(F.col("kind") == 0).select(*keys, "t", "nxt2"))
    return (res.join(later, [*keys, "t"], "left")
            .select(*keys, "t", F.coalesce("found", "nxt2").alias("nxt")))


def cooldown_filter(cands: DataFrame, keys: Sequence[str] = ("status", "severity"),
                    ts: str = "eval_ts", cooldown_seconds: float = 300) -> DataFrame:
    """Keep the candidates that fire under the per-key cooldown (all of them
    without one)."""
    ensure_checkpoint_dir(cands.sparkSession)
    keys, gap = list(keys), round(cooldown_seconds * 1_000_000)
    if gap <= 0:
        return cands
    one = F.row_number().over(Window.partitionBy(*keys, "_t").orderBy(F.xxhash64(*cands.columns)))
    cands = cands.withColumn("_t", _micros(ts)).withColumn("_one", one).filter("_one = 1").drop("_one").checkpoint()
    nodes = cands.select(*keys, F.col("_t").alias("t"))
    first = burst_starts(nodes, keys, gap).checkpoint()
    # The next burst's start fires anyway: a chain is followed inside its burst only.
    jumps = (successor(nodes, keys, gap).filter(F.col("nxt").isNotNull())
             .join(first.withColumnRenamed("t", "nxt"), [*keys, "nxt"], "left_anti"))
    live = (jumps.join(first.withColumn("_first", F.lit(True)), [*keys, "t"], "left")
            .select(*keys, "t", "nxt", F.coalesce("_first", F.lit(False)).alias("reached")).checkpoint())
    fired = first
    while True:
        hits = live.filter("reached").select(*keys, F.col("nxt").alias("t")).distinct().checkpoint()
        if hits.isEmpty():
            break
        fired = fired.unionByName(hits)
        a, b = live.alias("a"), live.alias("b")
        cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.nxt") == F.col("b.t")]
        squared = a.join(b, cond).select(
            *[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.t").alias("t"),
            F.col("b.nxt").alias("nxt"), F.col("a.reached").alias("reached"))
        live = (squared.join(hits.withColumn("_hit", F.lit(True)), [*keys, "t"], "left")
                .select(*keys, "t", "nxt", (F.col("reached") | F.coalesce("_hit", F.lit(False))).alias("reached")).checkpoint())
    fired = fired.withColumnRenamed("t", "_t")
    return cands.join(fired, [*keys, "_t"], "left_semi").select(*[c for c in cands.columns if c != "_t"])


def dispatch(details: DataFrame, cooldown_seconds: float = 300, critical: float = 4.0,
             warning: float = 2.5, keys: Sequence[str] = ()) -> DataFrame:
    """Fired alerts: keys, status, severity, current value, baseline, z, score,
    time.  Every series (``keys``) has a cooldown of its own."""
    fired = cooldown_filter(alert_candidates(details, critical, warning), (*keys, "status", "severity"),
                            cooldown_seconds=cooldown_seconds)
    return fired.select(*keys, "status", "severity", "current_value", "baseline_mean", "baseline_std", "z_score",
                        F.col("max_z_score").alias("score"), F.col("eval_ts").alias("alert_ts"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("status", "severity").agg(F.count(F.lit(1)).alias("alerts"))


def outbox(alerts: DataFrame, service: str = "monitor") -> DataFrame:
    """Notification payloads: CRITICAL alerts only, as JSON text."""
    payload = F.to_json(F.struct(
        F.lit(True).alias("alert"), F.col("status"), F.col("severity"), F.col("current_value"),
        F.col("baseline_mean"), F.col("baseline_std"), F.col("z_score"), F.col("score"),
        F.date_format("alert_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(service).alias("service")))
    return alerts.filter(F.col("severity") == "CRITICAL").select("status", "alert_ts", payload.alias("payload"))


def alert_log(alerts: DataFrame) -> DataFrame:
    """Log lines for every fired alert (WARNING and CRITICAL)."""
    lead = F.when(F.col("severity") == "CRITICAL", F.lit("ALERT: ")).otherwise(F.lit("ELEVATED: "))
    body = F.when(F.col("severity") == "CRITICAL", F.lit(" transactions anomaly")).otherwise(
        F.lit(" transactions above normal"))
    msg = F.concat(lead, F.col("status"), body, F.lit(" — count="), F.col("current_value").cast("string"),
                   F.lit(", z_score="), F.format_string("%.2f", F.col("z_score")),
                   F.lit(" (baseline mean="), F.format_string("%.2f", F.col("baseline_mean")),
                   F.lit(", std="), F.format_string("%.2f", F.col("baseline_std")), F.lit(")"))
    return alerts.select("alert_ts", F.when(F.col("severity") == "CRITICAL", "CRITICAL")
                         .otherwise("WARNING").alias("level"), msg.alias("message"))
