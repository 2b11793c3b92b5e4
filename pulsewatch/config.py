"""Parameter objects and fixed vocabularies.

Every detector takes its thresholds from a frozen dataclass whose defaults are
the documented defaults of the monitoring rules, so one object drives the
detector, the dispatcher and the report (the thresholds are never hard-coded
twice).
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values (must equal the monitored system's vocabularies) -----------
# Monitored statuses, in report order.
MONITORED_STATUSES = ("denied", "failed", "reversed", "backend_reversed", "approved")
# Problem statuses: any occurrence without a baseline is suspicious.
PROBLEM_STATUSES = ("denied", "failed", "reversed", "backend_reversed")
# Statuses whose share forms the error rate.
ERROR_STATUSES = ("denied", "failed")
# Severity labels, worst first.
SEVERITIES = ("CRITICAL", "WARNING", "INFO", "NORMAL")
# Authorisation code that means "approved".
APPROVAL_CODE = "00"
# Latency histogram upper bounds in seconds (batch consume / produce).
CONSUME_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
# Latency histogram upper bounds in seconds (table insert).
INSERT_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5)
# Request paths that are not counted.
IGNORED_PATHS = ("/metrics", "/health")
# --- end of fixed values ------------------------------------------------------

# Seconds per time unit accepted by the ``unit`` parameters.
UNIT_SECONDS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400}


def unit_seconds(unit: str) -> int:
    try:
        return UNIT_SECONDS[unit.upper()]
    except KeyError:
        raise ValueError(f"unknown unit {unit!r}; use one of {sorted(UNIT_SECONDS)}") from None


def check_range(name: str, value: int, lo: int, hi: int) -> int:
    """Parameter bounds of the query surface (minutes 1..1440, limit 1..100...)."""
    if not isinstance(value, int) or not lo <= value <= hi:
        raise ValueError(f"{name} must be an integer in [{lo}, {hi}], got {value!r}")
    return value


@dataclass(frozen=True)
class PolicyParams:
    """Rolling z-score policy detector (per status, one-sided)."""

    z_score_threshold: float = 2.5
    critical_threshold: float = 4.0
    min_history: int = 30
    min_std: float = 1.0
    history_window: int = 60  # units before the latest stamp (inclusive bound)
    current_window: int = 1  # units before the latest stamp (inclusive: 2 stamps)


@dataclass(frozen=True)
class RollingParams:
    """Row-based rolling z-score (trailing, current row included)."""

    window: int = 60
    z_threshold: float = 3.0
    min_periods: int = 30
    min_std: float = 1.0


@dataclass(frozen=True)
class CheckoutParams:
    """Layered hourly checkout detector."""

    z_threshold: float = 2.0
    spike_multiplier: float = 3.0
    min_volume_for_outage: float = 5.0
    low_traffic_month_avg: float = 5.0
    low_traffic_abs_dev: float = 10.0
    high_traffic_pct_dev: float = 1.0
    high_traffic_z_factor: float = 0.8
    std_floor: float = 1.0
    std_expected_share: float = 0.3
    spike_min_volume: float = 10.0
    slope_std_floor: float = 3.0
    slope_min_drop: float = -10.0


@dataclass(frozen=True)
class OutageParams:
    """Near-zero volume periods."""

    zero_threshold: int = 5
    max_gap: int = 2  # units; consecutive stamps this close are one period
    critical_units: int = 5
    warning_units: int = 2


@dataclass(frozen=True)
class TimelineParams:
    volume: RollingParams = RollingParams(z_threshold=3.0)
    rate: RollingParams = RollingParams(z_threshold=2.5)
    divergence_sigmas: float = 3.0
    outage: OutageParams = OutageParams()
