"""Distributed cooldown equals the sequential fold on random candidate sets."""

import datetime as dt
import random

from pulsewatch.operators import alerts

T0 = dt.datetime(2025, 7, 12)


def fold(times, gap):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out


def test_random_sets_match_fold(spark):
    rng = random.Random(42)
    rows, expect = [], set()
    for key in range(6):
        status, sev = f"s{key % 3}", ("WARNING", "CRITICAL")[key % 2]
        times = sorted(set(rng.randrange(0, 200_000, 60) for _ in range(rng.randrange(1, 400))))
        gap = 300
        for t in fold(times, gap):
            expect.add((status, sev, t))
        rows += [(status, sev, T0 + dt.timedelta(seconds=t)) for t in times]
    cands = spark.createDataFrame(rows, "status string, severity string, eval_ts timestamp_ntz")
    got = {(r.status, r.severity, int((r.eval_ts - T0).total_seconds()))
           for r in alerts.cooldown_filter(cands, cooldown_seconds=300, ).collect()}
    assert got == expect


def test_long_chain_and_chunk_boundaries(spark):
    # A dense run longer than one chunk (1024 cooldowns) of the successor search.
    times = list(range(0, 300 * 1100, 170))
    cands = spark.createDataFrame([("denied", "WARNING", T0 + dt.timedelta(seconds=t)) for t in times],
                                  "status string, severity string, eval_ts timestamp_ntz")
    got = sorted(int((r.eval_ts - T0).total_seconds()) for r in alerts.cooldown_filter(cands, cooldown_seconds=300).collect())
    assert got == fold(times, 300)
