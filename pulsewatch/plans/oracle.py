"""DuckDB SQL twins of the registered queries.

Each string runs against the driver's pre-registered parquet views and must
return the same columns and values as the Spark query of the same key.  The
view definitions below are the SQL spelling of ``pulsewatch.sources.adapters``.
"""

from __future__ import annotations

STATUS_CASE = ("CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'denied' "
               "WHEN 'error' THEN 'failed' WHEN 'click' THEN 'reversed' "
               "WHEN 'signup' THEN 'backend_reversed' END")

TX = f"""tx AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, {STATUS_CASE} AS status,
         COUNT(*) AS cnt
  FROM events GROUP BY 1, 2)"""

TXD = """txd AS (
  SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts,
         CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'denied'
                            WHEN 'P' THEN 'failed' END AS status,
         COUNT(*) AS cnt
  FROM orders GROUP BY 1, 2)"""

AUTH = """auth AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
         CASE WHEN event_type = 'purchase' THEN '00'
              ELSE lpad(CAST(1 + CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 7 AS VARCHAR), 2, '0')
         END AS auth_code,
         COUNT(*) AS cnt
  FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2)"""

# Zero-filled wide frame per stamp with rates.
WIDE = """wide AS (
  SELECT ts,
         CAST(SUM(CASE WHEN status = 'approved' THEN cnt ELSE 0 END) AS BIGINT) AS approved,
         CAST(SUM(CASE WHEN status = 'denied' THEN cnt ELSE 0 END) AS BIGINT) AS denied,
         CAST(SUM(CASE WHEN status = 'failed' THEN cnt ELSE 0 END) AS BIGINT) AS failed,
         CAST(SUM(CASE WHEN status = 'reversed' THEN cnt ELSE 0 END) AS BIGINT) AS reversed,
         CAST(SUM(CASE WHEN status = 'backend_reversed' THEN cnt ELSE 0 END) AS BIGINT) AS backend_reversed,
         CAST(SUM(cnt) AS BIGINT) AS total
  FROM tx GROUP BY ts),
rates AS (
  SELECT *, CASE WHEN total <> 0 THEN CAST(approved AS DOUBLE) / CAST(total AS DOUBLE) END AS approval_rate,
            CASE WHEN total <> 0 THEN CAST(denied + failed AS DOUBLE) / CAST(total AS DOUBLE) END AS error_rate
  FROM wide)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["status_summary"] = with_(TX, """w AS (SELECT * FROM tx WHERE ts >= (SELECT max(ts) FROM tx) - INTERVAL 24 HOUR)""") + """
SELECT status, CAST(SUM(cnt) AS BIGINT) AS total, ROUND(AVG(cnt), 2) AS avg_cnt,
       MAX(cnt) AS max_cnt, MIN(cnt) AS min_cnt, COUNT(*) AS data_points,
       CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total_points
FROM w GROUP BY status"""

SQL["status_rates"] = with_(TX) + """
SELECT ts, status, CAST(SUM(cnt) AS BIGINT) AS cnt FROM tx
WHERE ts >= (SELECT max(ts) FROM tx) - INTERVAL 24 HOUR GROUP BY ts, status"""

SQL["status_distribution"] = with_(TX) + """
SELECT status, CAST(SUM(cnt) AS BIGINT) AS total, CAST(SUM(SUM(cnt)) OVER () AS BIGINT) AS grand_total
FROM tx WHERE ts >= (SELECT max(ts) FROM tx) - INTERVAL 1 HOUR GROUP BY status"""

SQL["history_window"] = with_(TX) + """
SELECT ts,
  CAST(SUM(CASE WHEN status = 'denied' THEN cnt ELSE 0 END) AS BIGINT) AS denied,
  CAST(SUM(CASE WHEN status = 'failed' THEN cnt ELSE 0 END) AS BIGINT) AS failed,
  CAST(SUM(CASE WHEN status = 'reversed' THEN cnt ELSE 0 END) AS BIGINT) AS reversed,
  CAST(SUM(CASE WHEN status = 'backend_reversed' THEN cnt ELSE 0 END) AS BIGINT) AS backend_reversed,
  CAST(SUM(CASE WHEN status = 'approved' THEN cnt ELSE 0 END) AS BIGINT) AS approved
FROM tx WHERE ts >= (SELECT max(ts) FROM tx) - INTERVAL 60 HOUR GROUP BY ts"""

SQL["recent_records"] = with_(TX) + """
SELECT ts, status, cnt, ts AS ingested_at FROM tx ORDER BY ts DESC, status DESC LIMIT 10"""

SQL["profile"] = with_(TX) + """
SELECT COUNT(*) AS n_rows, CAST(SUM(cnt) AS BIGINT) AS total_cnt, MIN(ts) AS min_ts, MAX(ts) AS max_ts,
       COUNT(DISTINCT ts) AS n_stamps, COUNT(DISTINCT status) AS n_statuses FROM tx"""

SQL["describe_rates"] = with_(TX, WIDE, """long AS (
  SELECT 'total' AS metric, CAST(total AS DOUBLE) AS v FROM rates
  UNION ALL SELECT 'approval_rate', approval_rate FROM rates
  UNION ALL SELECT 'error_rate', error_rate FROM rates)""") + """
SELECT metric, COUNT(v) AS n, AVG(v) AS mean, STDDEV_SAMP(v) AS std, MIN(v) AS min,
       quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75,
       MAX(v) AS max
FROM long GROUP BY metric"""

SQL["volume_per_minute"] = with_(TX) + "SELECT ts, CAST(SUM(cnt) AS BIGINT) AS total FROM tx GROUP BY ts"

SQL["volume_by_status"] = with_(TX) + "SELECT status, CAST(SUM(cnt) AS BIGINT) AS total FROM tx GROUP BY status"

SQL["rate_series"] = with_(TX, WIDE) + "SELECT * FROM rates"

AUTH_CODE = """totals AS (SELECT auth_code, CAST(SUM(cnt) AS BIGINT) AS total FROM auth GROUP BY auth_code),
code AS (SELECT COALESCE(
    (SELECT MAX(auth_code) FROM totals WHERE auth_code = '00'),
    (SELECT MAX(auth_code) FROM totals WHERE auth_code = '0'),
    (SELECT auth_code FROM totals ORDER BY total DESC, auth_code DESC LIMIT 1)) AS c)"""

SQL["auth_rates"] = with_(AUTH, AUTH_CODE) + """
SELECT ts, CAST(SUM(CASE WHEN auth_code = (SELECT c FROM code) THEN cnt ELSE 0 END) AS BIGINT) AS approved_cnt,
       CAST(SUM(cnt) AS BIGINT) AS auth_total,
       CASE WHEN SUM(cnt) <> 0 THEN CAST(SUM(CASE WHEN auth_code = (SELECT c FROM code) THEN cnt ELSE 0 END) AS DOUBLE)
            / CAST(SUM(cnt) AS DOUBLE) END AS auth_approval_rate,
       (SELECT c FROM code) AS approval_code
FROM auth GROUP BY ts"""

SQL["top_codes"] = with_(AUTH) + """
SELECT auth_code, CAST(SUM(cnt) AS BIGINT) AS total FROM auth GROUP BY auth_code
ORDER BY total DESC, auth_code LIMIT 10"""

SQL["top_error_series"] = with_(AUTH, """top5 AS (
  SELECT auth_code FROM auth WHERE auth_code <> '00' GROUP BY auth_code
  ORDER BY SUM(cnt) DESC, auth_code LIMIT 5),
hit AS (SELECT * FROM auth WHERE auth_code IN (SELECT auth_code FROM top5)),
counts AS (SELECT ts, auth_code, SUM(cnt) AS cnt FROM hit GROUP BY ts, auth_code),
grid AS (SELECT DISTINCT h.ts, t.auth_code FROM hit h, top5 t)""") + """
SELECT g.ts, g.auth_code, CAST(COALESCE(c.cnt, 0) AS BIGINT) AS cnt
FROM grid g LEFT JOIN counts c ON g.ts = c.ts AND g.auth_code = c.auth_code"""


def _quality(name, src, key, cat, cols):
    nulls = " + ".join(f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in cols)
    return f"""SELECT '{name}' AS dataset, COUNT(*) AS n_rows, CAST({nulls} AS BIGINT) AS null_cells,
  (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM {src} GROUP BY {key})) AS dup_rows,
  CAST(COALESCE(SUM(CASE WHEN cnt < 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS negative_values,
  COUNT(DISTINCT {cat}) AS n_distinct, MIN(ts) AS min_ts, MAX(ts) AS max_ts FROM {src}"""


SQL["quality_report"] = with_(TX, AUTH) + _quality("transactions", "tx", "ts", "status", ["ts", "status", "cnt"]) \
    + "\nUNION ALL\n" + _quality("auth_codes", "auth", "ts, auth_code", "auth_code", ["ts", "auth_code", "cnt"])

SQL["reconcile"] = with_(TX, AUTH, """l AS (SELECT ts, CAST(SUM(cnt) AS BIGINT) AS l_total FROM tx
             WHERE status IN ('approved', 'denied') GROUP BY ts),
r AS (SELECT ts, CAST(SUM(cnt) AS BIGINT) AS r_total FROM auth GROUP BY ts),
j AS (SELECT COALESCE(l.ts, r.ts) AS ts, l_total, r_total FROM l FULL OUTER JOIN r ON l.ts = r.ts)""") + """
SELECT COUNT(l_total) AS n_left, COUNT(r_total) AS n_right,
       CAST(SUM(CASE WHEN l_total IS NOT DISTINCT FROM r_total THEN 0 ELSE 1 END) AS BIGINT) AS n_mismatch,
       MIN(CASE WHEN l_total IS DISTINCT FROM r_total THEN ts END) AS first_mismatch,
       CAST(SUM(l_total) AS BIGINT) AS left_total, CAST(SUM(r_total) AS BIGINT) AS right_total
FROM j"""

SQL["missing_slots"] = """
WITH m AS (SELECT DISTINCT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS ts FROM events),
b AS (SELECT MIN(ts) AS lo, MAX(ts) AS hi FROM m),
g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS ts FROM b)
SELECT g.ts FROM g ANTI JOIN m ON g.ts = m.ts"""

SHOP_TX = f"""tx AS (SELECT user_id % 4 AS shop, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, {STATUS_CASE} AS status,
          COUNT(*) AS cnt FROM events GROUP BY 1, 2, 3)"""
SHOP_AUTH = """auth AS (
  SELECT user_id % 4 AS shop, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
         CASE WHEN event_type = 'purchase' THEN CASE WHEN user_id % 4 = 3 THEN '0' ELSE '00' END
              ELSE lpad(CAST(1 + CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 7 AS VARCHAR), 2, '0')
         END AS auth_code, COUNT(*) AS cnt
  FROM events WHERE event_type IN ('purchase', 'view') AND NOT (user_id % 4 = 2 AND event_type = 'purchase') GROUP BY 1, 2, 3)"""
_SHOP_MINUTES = """
WITH m AS (SELECT DISTINCT user_id % 4 AS shop, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS ts FROM events),
b AS (SELECT shop, MIN(ts) AS lo, MAX(ts) AS hi, COUNT(*) AS n FROM m GROUP BY shop),
g AS (SELECT shop, unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS ts FROM b)"""
SQL["missing_stamps_keyed"] = _SHOP_MINUTES + "SELECT g.shop, g.ts FROM g ANTI JOIN m ON g.shop = m.shop AND g.ts = m.ts"
SQL["completeness_keyed"] = _SHOP_MINUTES + """
SELECT b.shop, COUNT(*) AS n_expected, any_value(n) AS n_present, COUNT(*) - any_value(n) AS n_missing,
       any_value(lo) AS min_ts, any_value(hi) AS max_ts FROM b JOIN g USING (shop) GROUP BY b.shop"""

_SHOP_RECONCILE = """l AS (SELECT shop, ts, SUM(cnt) AS l_total FROM tx WHERE status IN ('approved', 'denied') GROUP BY shop, ts),
r AS (SELECT shop, ts, SUM(cnt) AS r_total FROM auth GROUP BY shop, ts),
rec AS (SELECT shop, COUNT(l_total) AS n_left, COUNT(r_total) AS n_right,
  CAST(SUM(CASE WHEN l_total IS NOT DISTINCT FROM r_total THEN 0 ELSE 1 END) AS BIGINT) AS n_mismatch,
  MIN(CASE WHEN l_total IS DISTINCT FROM r_total THEN ts END) AS first_mismatch,
  CAST(SUM(l_total) AS BIGINT) AS left_total, CAST(SUM(r_total) AS BIGINT) AS right_total
  FROM l FULL JOIN r USING (shop, ts) GROUP BY shop)"""
SQL["reconcile_keyed"] = with_(SHOP_TX, SHOP_AUTH, _SHOP_RECONCILE) + "SELECT * FROM rec"


def _measured(name: str, src: str, key: str, category: str, cols: list[str]) -> str:
    nulls = " + ".join(f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in cols)
    one = f"""(SELECT shop, COUNT(*) AS n_rows, {nulls} AS nulls, SUM(CASE WHEN cnt < 0 THEN 1 ELSE 0 END) AS negative,
      COUNT(DISTINCT {category}) AS categories, COUNT(*) - COUNT(DISTINCT {key}) AS again, COUNT(DISTINCT ts) AS stamps,
      date_diff('hour', MIN(ts), MAX(ts)) + 1 - COUNT(DISTINCT ts) AS missing FROM {src} GROUP BY shop)"""
    return "\nUNION ALL ".join(f"SELECT '{name}' AS dataset, shop, '{m}' AS measure, CAST({c} AS BIGINT) AS value FROM {one}" for m, c in (
        ("rows", "n_rows"), ("null_cells", "nulls"), ("negative_values", "negative"), ("categories", "categories"),
        ("repeated_rows", "again"), ("stamps", "stamps"), ("missing_stamps", "missing")))


SQL["quality_frame"] = (with_(SHOP_TX, SHOP_AUTH, _SHOP_RECONCILE)
    + _measured("transactions", "tx", "ts", "status", ["shop", "ts", "status", "cnt"]) + "\nUNION ALL "
    + _measured("auth_codes", "auth", "(ts, auth_code)", "auth_code", ["shop", "ts", "auth_code", "cnt"]) + "".join(
    f"\nUNION ALL SELECT 'transactions - auth_codes', shop, '{m}', {m} FROM rec"
    for m in ("n_left", "n_right", "n_mismatch", "left_total", "right_total")))

SQL["recent_records_keyed"] = with_(SHOP_TX) + """
SELECT shop, ts, status, cnt FROM tx QUALIFY row_number() OVER (PARTITION BY shop ORDER BY ts DESC, status DESC) <= 7"""

_SHOP_TOP = """top AS (SELECT shop, auth_code, CAST(SUM(cnt) AS BIGINT) AS total,
  row_number() OVER (PARTITION BY shop ORDER BY SUM(cnt) DESC, auth_code)::INT AS place FROM auth {where} GROUP BY shop, auth_code
  QUALIFY place <= {n})"""
SQL["top_codes_keyed"] = with_(SHOP_AUTH, _SHOP_TOP.format(where="", n=4)) + "SELECT * FROM top"
SQL["top_error_series_keyed"] = with_(SHOP_AUTH, _SHOP_TOP.format(where="WHERE auth_code NOT IN ('00', '0')", n=3),
    "hit AS (SELECT auth.* FROM auth JOIN top USING (shop, auth_code))",
    "grid AS (SELECT DISTINCT hit.shop, hit.ts, top.auth_code FROM hit JOIN top ON hit.shop = top.shop)") + """
SELECT g.shop, g.ts, g.auth_code, CAST(COALESCE(hit.cnt, 0) AS BIGINT) AS cnt FROM grid g LEFT JOIN hit USING (shop, ts, auth_code)"""

SQL["auth_rates_keyed"] = with_(SHOP_AUTH, """totals AS (SELECT shop, auth_code, SUM(cnt) AS total FROM auth GROUP BY shop, auth_code),
code AS (SELECT shop, COALESCE(MAX(auth_code) FILTER (auth_code = '00'), MAX(auth_code) FILTER (auth_code = '0'),
         arg_min(auth_code, (-total, auth_code))) AS c FROM totals GROUP BY shop)""") + """
SELECT shop, ts, CAST(SUM(CASE WHEN auth_code = c THEN cnt ELSE 0 END) AS BIGINT) AS approved_cnt, CAST(SUM(cnt) AS BIGINT) AS auth_total,
       CAST(SUM(CASE WHEN auth_code = c THEN cnt ELSE 0 END) AS DOUBLE) / CAST(SUM(cnt) AS DOUBLE) AS auth_approval_rate,
       any_value(c) AS approval_code
FROM auth JOIN code USING (shop) GROUP BY shop, ts"""

SQL["profile_keyed"] = with_(SHOP_TX) + """
SELECT shop, COUNT(*) AS n_rows, CAST(SUM(cnt) AS BIGINT) AS total_cnt, MIN(ts) AS min_ts, MAX(ts) AS max_ts,
       COUNT(DISTINCT ts) AS n_stamps, COUNT(DISTINCT status) AS n_statuses FROM tx GROUP BY shop"""

SQL["describe_keyed"] = with_(SHOP_TX, """w AS (SELECT shop, ts, SUM(cnt) AS total,
  CAST(SUM(CASE WHEN status IN ('denied', 'failed') THEN cnt ELSE 0 END) AS DOUBLE) / CAST(SUM(cnt) AS DOUBLE) AS error_rate FROM tx GROUP BY shop, ts),
long AS (SELECT shop, 'total' AS metric, CAST(total AS DOUBLE) AS v FROM w UNION ALL SELECT shop, 'error_rate', error_rate FROM w)""") + """
SELECT shop, metric, COUNT(v) AS n, AVG(v) AS mean, STDDEV_SAMP(v) AS std, MIN(v) AS min, quantile_cont(v, 0.25) AS p25,
       quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, MAX(v) AS max FROM long GROUP BY shop, metric"""

SQL["value_quantiles"] = "SELECT event_type, COUNT(value) AS n, " + ", ".join(
    f"quantile_cont(value, {p / 100}) AS q{p}" for p in (1, 25, 50, 75, 99)) + " FROM events WHERE value IS NOT NULL GROUP BY event_type"
SQL["value_sketch"] = "SELECT event_type, COUNT(value) AS n, true AS within FROM events GROUP BY event_type"

SQL["period_averages"] = with_(TXD, "d AS (SELECT ts, CAST(SUM(cnt) AS BIGINT) AS total FROM txd GROUP BY ts)", """p AS (
  SELECT l_orderkey, l_linenumber, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS end_ts,
         CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS start_ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT ts, SUM(total) OVER (ORDER BY ts) AS s, row_number() OVER (ORDER BY ts) AS k FROM d),
e AS (SELECT p.*, hi.s AS s1, hi.k AS k1 FROM p ASOF LEFT JOIN c hi ON p.end_ts >= hi.ts),
b AS (SELECT e.*, coalesce(lo.s, 0) AS s0, coalesce(lo.k, 0) AS k0 FROM e ASOF LEFT JOIN c lo ON e.start_ts > lo.ts)""") + """
SELECT l_orderkey, l_linenumber, start_ts, end_ts, CASE WHEN k1 > k0 THEN k1 - k0 ELSE 0 END AS n_stamps,
       CASE WHEN k1 > k0 THEN CAST(s1 - s0 AS BIGINT) END AS sum_volume,
       CASE WHEN k1 > k0 THEN CAST(s1 - s0 AS DOUBLE) / (k1 - k0) END AS avg_volume FROM b"""

SQL["facts_status_summary_keyed"] = with_(SHOP_TX, "l AS (SELECT shop, MAX(ts) AS latest FROM tx GROUP BY shop)",
    "w AS (SELECT tx.* FROM tx JOIN l USING (shop) WHERE ts >= latest - INTERVAL 24 HOUR)") + """
SELECT shop, status, CAST(SUM(cnt) AS BIGINT) AS total, ROUND(AVG(cnt), 2) AS avg_cnt,
       MAX(cnt) AS max_cnt, MIN(cnt) AS min_cnt, COUNT(*) AS data_points,
       CAST(SUM(COUNT(*)) OVER (PARTITION BY shop) AS BIGINT) AS total_points
FROM w GROUP BY shop, status"""

SQL["validate_records"] = """
WITH r AS (
  SELECT event_id AS record_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS ts,
         CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'denied'
              WHEN 'error' THEN 'failed' WHEN 'click' THEN 'reversed' ELSE 'refunded' END AS status,
         CAST(floor(value) AS BIGINT) - 1 AS cnt
  FROM events),
v AS (
  SELECT *, CASE WHEN ts IS NULL THEN 'missing timestamp' WHEN status IS NULL THEN 'missing status'
                 WHEN cnt IS NULL THEN 'missing count' WHEN cnt < 0 THEN 'negative count'
                 WHEN status NOT IN ('denied', 'failed', 'reversed', 'backend_reversed', 'approved')
                 THEN 'unmonitored status' END AS reject_reason
  FROM r)
SELECT *, reject_reason IS NULL AS is_valid FROM v"""


def rolling_exact(src: str, value: str, order: str = "ts", part: str = "", window: int = 60,
                  min_periods: int = 30) -> str:
    """Exact integer rolling stats: n, s1, s2 -> mean, floored std."""
    pb = f"PARTITION BY {part} " if part else ""
    return f"""SELECT *, CASE WHEN n >= {min_periods} THEN CAST(s1 AS DOUBLE) / CAST(n AS DOUBLE) END AS rolling_mean,
       CASE WHEN n >= {min_periods} AND n >= 2 THEN greatest(sqrt(CAST(CAST(n AS HUGEINT) * s2 - CAST(s1 AS HUGEINT) * s1 AS DOUBLE)
            / (CAST(n AS DOUBLE) * CAST(n - 1 AS DOUBLE))), 1.0) END AS rolling_std
FROM (SELECT *, COUNT({value}) OVER w AS n, SUM({value}) OVER w AS s1,
             SUM(CAST({value} AS HUGEINT) * CAST({value} AS HUGEINT)) OVER w AS s2
      FROM {src} WINDOW w AS ({pb}ORDER BY {order} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW))"""


def rolling_float(src: str, value: str, window: int = 60, min_periods: int = 30, min_std: float = 1.0) -> str:
    return f"""SELECT *, CASE WHEN n >= {min_periods} THEN a END AS rolling_mean,
       CASE WHEN n >= {min_periods} AND sd IS NOT NULL THEN greatest(sd, {min_std}) END AS rolling_std
FROM (SELECT *, COUNT({value}) OVER w AS n, AVG({value}) OVER w AS a, STDDEV_SAMP({value}) OVER w AS sd
      FROM {src} WHERE {value} IS NOT NULL
      WINDOW w AS (ORDER BY ts ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW))"""


def zflags(t: float) -> str:
    return f"""COALESCE(abs(z_score) > {t}, false) AS is_anomaly, COALESCE(z_score > {t}, false) AS is_spike,
       COALESCE(z_score < -{t}, false) AS is_drop"""


SQL["rolling_volume"] = with_(TX, WIDE, f"r AS ({rolling_exact('rates', 'total')})",
                              "z AS (SELECT *, (CAST(total AS DOUBLE) - rolling_mean) / rolling_std AS z_score FROM r)") + f"""
SELECT ts, total AS value, rolling_mean, rolling_std, z_score, {zflags(3.0)} FROM z"""

for _k, _v, _floor in (("rolling_approval", "approval_rate", 1.0), ("rolling_error", "error_rate", 1.0),
                       ("rolling_approval_tight", "approval_rate", 0.01), ("rolling_error_tight", "error_rate", 0.01)):
    _dir = (", CASE WHEN z_score > 0 THEN 'SPIKE' WHEN z_score < 0 THEN 'DROP' END AS direction"
            if _v == "error_rate" else "")
    SQL[_k] = with_(TX, WIDE, f"r AS ({rolling_float('rates', _v, min_std=_floor)})",
                    f"z AS (SELECT *, ({_v} - rolling_mean) / rolling_std AS z_score FROM r)") + f"""
SELECT ts, {_v} AS value, ROUND(rolling_mean, 9) AS rolling_mean, ROUND(rolling_std, 9) AS rolling_std,
       ROUND(z_score, 9) AS z_score, {zflags(2.5)}{_dir} FROM z"""

SQL["rolling_bands"] = with_(TX, WIDE, f"r AS ({rolling_exact('rates', 'total')})",
                             "z AS (SELECT *, (CAST(total AS DOUBLE) - rolling_mean) / rolling_std AS z_score FROM r)") + """
SELECT ts, total AS value, rolling_mean,
       CASE WHEN rolling_mean - 3.0 * rolling_std IS NOT NULL THEN greatest(rolling_mean - 3.0 * rolling_std, 0.0) END AS band_lower,
       rolling_mean + 3.0 * rolling_std AS band_upper,
       COALESCE(abs(z_score) > 3.0, false) AS is_anomaly,
       CASE WHEN z_score > 0 THEN 'SPIKE' WHEN z_score < 0 THEN 'DROP' END AS direction
FROM z"""

SQL["rolling_keyed"] = with_(TX, f"r AS ({rolling_exact('tx', 'cnt', part='status')})",
                             "z AS (SELECT *, (CAST(cnt AS DOUBLE) - rolling_mean) / rolling_std AS z_score FROM r)") + f"""
SELECT status, ts, cnt AS value, rolling_mean, rolling_std, z_score, {zflags(3.0)} FROM z"""

SQL["rolling_daily"] = with_(TXD, "d AS (SELECT ts, CAST(SUM(cnt) AS BIGINT) AS total FROM txd GROUP BY ts)",
                             f"r AS ({rolling_exact('d', 'total')})",
                             "z AS (SELECT *, (CAST(total AS DOUBLE) - rolling_mean) / rolling_std AS z_score FROM r)") + f"""
SELECT ts, total AS value, rolling_mean, rolling_std, z_score, {zflags(3.0)} FROM z"""

AUTH_RATE = """ar AS (
  SELECT ts, CASE WHEN SUM(cnt) <> 0 THEN CAST(SUM(CASE WHEN auth_code = (SELECT c FROM code) THEN cnt ELSE 0 END) AS DOUBLE)
                  / CAST(SUM(cnt) AS DOUBLE) END AS auth_approval_rate
  FROM auth GROUP BY ts)"""

SQL["cross_signal"] = with_(TX, WIDE, AUTH, AUTH_CODE, AUTH_RATE, """d AS (
  SELECT r.ts, r.approval_rate AS status_approval_rate, a.auth_approval_rate,
         abs(r.approval_rate - a.auth_approval_rate) AS divergence
  FROM rates r JOIN ar a ON r.ts = a.ts
  WHERE r.approval_rate IS NOT NULL AND a.auth_approval_rate IS NOT NULL),
t AS (SELECT AVG(divergence) + 3.0 * STDDEV_SAMP(divergence) AS th FROM d)""") + """
SELECT ts, status_approval_rate, auth_approval_rate, divergence, ROUND((SELECT th FROM t), 9) AS threshold,
       COALESCE(divergence > (SELECT th FROM t), false) AS is_divergent FROM d"""

SQL["outage_periods"] = with_(TX, """v AS (SELECT ts, CAST(SUM(cnt) AS BIGINT) AS total FROM tx GROUP BY ts),
o AS (SELECT ts FROM v WHERE total <= 5),
g AS (SELECT ts, CASE WHEN lag(ts) OVER (ORDER BY ts) IS NULL
                        OR ts - lag(ts) OVER (ORDER BY ts) > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS st FROM o),
i AS (SELECT ts, SUM(st) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pid FROM g),
p AS (SELECT pid, MIN(ts) AS start_ts, MAX(ts) AS end_ts, COUNT(*) AS outage_stamps FROM i GROUP BY pid)""") + """
SELECT start_ts, end_ts, CAST(date_diff('hour', start_ts, end_ts) + 1 AS BIGINT) AS duration, outage_stamps,
       (SELECT AVG(total) FROM v WHERE v.ts BETWEEN p.start_ts AND p.end_ts) AS avg_volume,
       CASE WHEN date_diff('hour', start_ts, end_ts) + 1 >= 5 THEN 'CRITICAL'
            WHEN date_diff('hour', start_ts, end_ts) + 1 >= 2 THEN 'WARNING' ELSE 'INFO' END AS severity
FROM p"""

# Signal frame: rates + auth rate, three rolling z-scores, divergence and flags.
SIG = [TX, WIDE, AUTH, AUTH_CODE, AUTH_RATE,
       "b AS (SELECT r.*, a.auth_approval_rate FROM rates r LEFT JOIN ar a ON r.ts = a.ts)",
       f"vs AS ({rolling_exact('b', 'total')})",
       f"aps AS ({rolling_float('b', 'approval_rate')})",
       f"ers AS ({rolling_float('b', 'error_rate')})",
       """z AS (
  SELECT b.*, (CAST(b.total AS DOUBLE) - vs.rolling_mean) / vs.rolling_std AS volume_zscore,
         (b.approval_rate - aps.rolling_mean) / aps.rolling_std AS approval_zscore,
         (b.error_rate - ers.rolling_mean) / ers.rolling_std AS error_zscore,
         abs(b.approval_rate - b.auth_approval_rate) AS divergence
  FROM b JOIN vs ON b.ts = vs.ts LEFT JOIN aps ON b.ts = aps.ts LEFT JOIN ers ON b.ts = ers.ts)""",
       "th AS (SELECT AVG(divergence) + 3.0 * STDDEV_SAMP(divergence) AS t FROM z WHERE divergence IS NOT NULL)",
       """sig AS (
  SELECT z.*, (SELECT t FROM th) AS divergence_threshold,
         CAST(COALESCE(abs(volume_zscore) > 3.0, false) AS INTEGER) AS volume_anomaly,
         CAST(COALESCE(abs(approval_zscore) > 2.5, false) AS INTEGER) AS approval_anomaly,
         CAST(COALESCE(abs(error_zscore) > 2.5, false) AS INTEGER) AS error_anomaly,
         CAST(COALESCE(divergence > (SELECT t FROM th), false) AS INTEGER) AS cross_signal_divergent,
         CAST(COALESCE(total <= 5, false) AS INTEGER) AS near_zero
  FROM z)""",
       """tl AS (
  SELECT *, CASE WHEN near_zero = 1 THEN 'CRITICAL' WHEN total_score >= 3 THEN 'CRITICAL'
                 WHEN total_score >= 2 THEN 'WARNING' WHEN total_score >= 1 THEN 'INFO' ELSE 'NORMAL' END AS severity,
            concat_ws(', ', CASE WHEN volume_anomaly = 1 THEN 'VOL' END, CASE WHEN approval_anomaly = 1 THEN 'APR' END,
                      CASE WHEN error_anomaly = 1 THEN 'ERR' END, CASE WHEN cross_signal_divergent = 1 THEN 'XSIG' END,
                      CASE WHEN near_zero = 1 THEN 'OUTAGE' END) AS triggers
  FROM (SELECT *, CAST(volume_anomaly + approval_anomaly + error_anomaly + cross_signal_divergent + 2 * near_zero AS INTEGER)
                  AS total_score FROM sig))"""]

SQL["anomaly_timeline"] = with_(*SIG) + """
SELECT ts, volume_zscore, volume_anomaly, ROUND(approval_zscore, 9) AS approval_zscore, approval_anomaly,
       ROUND(error_zscore, 9) AS error_zscore, error_anomaly, cross_signal_divergent, near_zero, total_score,
       severity, triggers FROM tl"""

SQL["timeline_5min"] = with_(*SIG, """o AS (SELECT date_diff('second', TIMESTAMP '1970-01-01', date_trunc('day', MIN(ts))) AS origin FROM tl),
bk AS (SELECT origin + CAST(floor(CAST(date_diff('second', TIMESTAMP '1970-01-01', ts) - origin AS DOUBLE) / 18000) AS BIGINT) * 18000 AS bb,
              total_score FROM tl, o),
ag AS (SELECT bb, MAX(total_score) AS m FROM bk GROUP BY bb),
g AS (SELECT unnest(generate_series(MIN(bb), MAX(bb), 18000)) AS bb FROM ag)""") + """
SELECT make_timestamp(g.bb * 1000000) AS bucket_start, CAST(COALESCE(ag.m, 0) AS INTEGER) AS max_score
FROM g LEFT JOIN ag ON g.bb = ag.bb"""

SQL["severity_distribution"] = with_(*SIG, """sv AS (SELECT * FROM (VALUES ('CRITICAL'), ('WARNING'), ('INFO'), ('NORMAL')) v(severity)),
c AS (SELECT severity, COUNT(*) AS cnt FROM tl GROUP BY severity),
n AS (SELECT COUNT(*) AS n FROM tl)""") + """
SELECT sv.severity, CAST(COALESCE(c.cnt, 0) AS BIGINT) AS cnt,
       100.0::DOUBLE * (CAST(COALESCE(c.cnt, 0) AS DOUBLE) / CAST((SELECT n FROM n) AS DOUBLE)) AS pct
FROM sv LEFT JOIN c ON sv.severity = c.severity"""

SQL["flag_counts"] = with_(*SIG) + """
SELECT COUNT(*) AS n_stamps, CAST(SUM(volume_anomaly) AS BIGINT) AS volume_anomaly,
       CAST(SUM(approval_anomaly) AS BIGINT) AS approval_anomaly, CAST(SUM(error_anomaly) AS BIGINT) AS error_anomaly,
       CAST(SUM(cross_signal_divergent) AS BIGINT) AS cross_signal_divergent, CAST(SUM(near_zero) AS BIGINT) AS near_zero,
       CAST(SUM(CASE WHEN total_score > 0 THEN 1 ELSE 0 END) AS BIGINT) AS anomalous,
       100.0::DOUBLE * CAST(SUM(CASE WHEN total_score > 0 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS anomalous_pct
FROM tl"""

SQL["rule_book"] = with_(*SIG, """lr AS (
  SELECT *, CASE WHEN NOT (total < 5) OR lag(ts) OVER o IS NULL OR lag(ts) OVER o <> ts - INTERVAL 1 HOUR
                      OR NOT COALESCE(lag(total < 5) OVER o, false) THEN 1 ELSE 0 END AS brk
  FROM sig WINDOW o AS (ORDER BY ts)),
lr2 AS (SELECT *, SUM(brk) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM lr),
lr3 AS (SELECT *, CAST(CASE WHEN total < 5 THEN row_number() OVER (PARTITION BY run ORDER BY ts) ELSE 0 END AS BIGINT)
                  AS low_run_length FROM lr2),
fl AS (SELECT (SELECT greatest(0.0, AVG(approval_rate) - 3.0 * STDDEV_SAMP(approval_rate)) FROM sig) AS f),
r AS (
  SELECT ts, low_run_length, low_run_length >= 5 AS volume_outage,
         COALESCE(approval_rate < (SELECT f FROM fl), false) AS approval_floor,
         COALESCE(abs(volume_zscore) > 3.0, false) AS volume_z,
         COALESCE(approval_zscore < -2.5, false) AS approval_drop,
         COALESCE(error_zscore > 2.5, false) AS error_rise,
         COALESCE(divergence > divergence_threshold, false) AS divergence
  FROM lr3)""") + """
SELECT *, CASE WHEN volume_outage OR approval_floor THEN 'CRITICAL'
               WHEN volume_z OR approval_drop OR error_rise OR divergence THEN 'WARNING' ELSE 'NORMAL' END AS severity,
       concat_ws(', ', CASE WHEN volume_outage THEN 'volume_outage' END, CASE WHEN approval_floor THEN 'approval_floor' END,
                 CASE WHEN volume_z THEN 'volume_z' END, CASE WHEN approval_drop THEN 'approval_drop' END,
                 CASE WHEN error_rise THEN 'error_rise' END, CASE WHEN divergence THEN 'divergence' END) AS rules
FROM r"""

SQL["recommended_thresholds"] = with_(*SIG, """g AS (
  SELECT CAST(SUM(total) AS DOUBLE) / CAST(COUNT(total) AS DOUBLE) AS vol_mean,
         sqrt(CAST(CAST(COUNT(total) AS HUGEINT) * SUM(CAST(total AS HUGEINT) * CAST(total AS HUGEINT))
                   - CAST(SUM(total) AS HUGEINT) * SUM(total) AS DOUBLE)
              / (CAST(COUNT(total) AS DOUBLE) * CAST(COUNT(total) - 1 AS DOUBLE))) AS vol_std,
         AVG(approval_rate) AS apr_mean, STDDEV_SAMP(approval_rate) AS apr_std,
         AVG(error_rate) AS err_mean, STDDEV_SAMP(error_rate) AS err_std,
         AVG(divergence) + 3.0 * STDDEV_SAMP(divergence) AS divergence_threshold
  FROM sig)""") + """
SELECT vol_mean, vol_std, greatest(0.0, vol_mean - 3.0 * vol_std) AS vol_lower, vol_mean + 3.0 * vol_std AS vol_upper,
       ROUND(apr_mean, 9) AS apr_mean, ROUND(apr_std, 9) AS apr_std,
       ROUND(greatest(0.0, apr_mean - 3.0 * apr_std), 9) AS apr_critical,
       ROUND(err_mean, 9) AS err_mean, ROUND(err_std, 9) AS err_std, ROUND(divergence_threshold, 9) AS divergence_threshold
FROM g"""

# --- checkout family ----------------------------------------------------------------
CHECKOUT = [
    """ev AS (SELECT event_type AS snapshot, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hts,
                CAST(SUM(CAST(floor(value) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY 1, 2)""",
    "bnd AS (SELECT snapshot, CAST(date_trunc('day', MIN(hts)) AS TIMESTAMP) AS lo, MAX(hts) AS hi FROM ev GROUP BY snapshot)",
    """grid AS (SELECT b.snapshot, unnest(generate_series(b.lo, b.hi, INTERVAL 1 HOUR)) AS hts FROM bnd b)""",
    """dense AS (SELECT g.snapshot, CAST(date_trunc('day', g.hts) AS TIMESTAMP) AS day, CAST(hour(g.hts) AS INTEGER) AS hour_of_day,
                      CAST(COALESCE(e.v, 0) AS BIGINT) AS today
              FROM grid g LEFT JOIN ev e ON g.snapshot = e.snapshot AND g.hts = e.hts)""",
    """cb AS (SELECT snapshot, day, lpad(CAST(hour_of_day AS VARCHAR), 2, '0') || 'h' AS time, hour_of_day, today,
                   lag(today, 1) OVER (PARTITION BY snapshot, hour_of_day ORDER BY day) AS yesterday,
                   lag(today, 7) OVER (PARTITION BY snapshot, hour_of_day ORDER BY day) AS same_day_last_week,
                   AVG(today) OVER (PARTITION BY snapshot, hour_of_day ORDER BY day
                                    ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS avg_last_week,
                   AVG(today) OVER (PARTITION BY snapshot, hour_of_day ORDER BY day
                                    ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS avg_last_month,
                   row_number() OVER (PARTITION BY snapshot, hour_of_day ORDER BY day) AS i
            FROM dense)""",
    "checkout AS (SELECT snapshot, day, time, hour_of_day, today, yesterday, same_day_last_week, avg_last_week, avg_last_month FROM cb WHERE i > 7)",
]


def _rowstd(a, b, c, d):
    m = f"(((({a}) + ({b})) + ({c})) + ({d})) / 4.0"
    t = [f"((({x}) - {m}) * (({x}) - {m}))" for x in (a, b, c, d)]
    return f"sqrt(((({t[0]} + {t[1]}) + {t[2]}) + {t[3]}) / 3.0)"


_Y, _S, _W, _M = ("CAST(yesterday AS DOUBLE)", "CAST(same_day_last_week AS DOUBLE)",
                  "CAST(avg_last_week AS DOUBLE)", "CAST(avg_last_month AS DOUBLE)")
_PW = "PARTITION BY snapshot, day ORDER BY hour_of_day"

LAYERS = CHECKOUT + [
    f"""l1 AS (SELECT *, 0.30::DOUBLE * avg_last_week + 0.25::DOUBLE * avg_last_month
                    + 0.25::DOUBLE * same_day_last_week + 0.20::DOUBLE * yesterday AS expected,
                    {_rowstd(_Y, _S, _W, _M)} AS std_raw FROM checkout)""",
    "l2 AS (SELECT *, greatest(std_raw, 1.0, 0.3::DOUBLE * expected) AS estimated_std FROM l1)",
    """l3 AS (SELECT *, (CAST(today AS DOUBLE) - expected) / estimated_std AS z_score,
                  abs(CAST(today AS DOUBLE) - expected) AS abs_deviation,
                  abs(CASE WHEN expected <> 0 THEN (CAST(today AS DOUBLE) - expected) / expected END) AS pct_deviation,
                  greatest(CAST(yesterday AS DOUBLE), CAST(same_day_last_week AS DOUBLE), avg_last_week, avg_last_month) AS historical_max
           FROM l2)""",
    """l4 AS (SELECT *, COALESCE(abs(z_score) > 2.0, false) AS is_zscore_anomaly,
                  COALESCE(avg_last_month < 5.0, false) AS is_low_traffic,
                  COALESCE(CASE WHEN avg_last_month < 5.0 THEN abs_deviation > 10.0 AND abs(z_score) > 2.0
                                ELSE pct_deviation > 1.0 AND abs(z_score) > 1.6 END, false) AS is_volume_anomaly,
                  COALESCE(today = 0 AND expected >= 5.0, false) AS is_outage,
                  COALESCE(CAST(today AS DOUBLE) > 3.0 * historical_max AND CAST(today AS DOUBLE) > 10.0, false) AS is_spike
           FROM l3)""",
    f"""l5 AS (SELECT *, CAST(today AS DOUBLE) - lag(CAST(today AS DOUBLE)) OVER ({_PW}) AS actual_change,
                  expected - lag(expected) OVER ({_PW}) AS expected_change,
                  {_Y} - lag({_Y}) OVER ({_PW}) AS dy, {_S} - lag({_S}) OVER ({_PW}) AS ds,
                  {_W} - lag({_W}) OVER ({_PW}) AS dw, {_M} - lag({_M}) OVER ({_PW}) AS dm
           FROM l4)""",
    f"""l6 AS (SELECT *, actual_change - expected_change AS change_deviation,
                  CASE WHEN {_rowstd('dy', 'ds', 'dw', 'dm')} IS NOT NULL
                       THEN greatest({_rowstd('dy', 'ds', 'dw', 'dm')}, 3.0) END AS change_std FROM l5)""",
    """l7 AS (SELECT *, change_deviation / change_std AS change_z_score,
                  COALESCE(change_deviation / change_std < -2.0 AND actual_change < -10.0, false) AS is_slope_anomaly
           FROM l6)""",
    """det AS (SELECT *, CAST(CAST(is_zscore_anomaly AS INTEGER) + CAST(is_volume_anomaly AS INTEGER)
                          + 2 * CAST(is_outage AS INTEGER) + 2 * CAST(is_spike AS INTEGER)
                          + CAST(is_slope_anomaly AS INTEGER) AS INTEGER) AS anomaly_score,
                      CAST(CAST(is_zscore_anomaly AS INTEGER) + CAST(is_volume_anomaly AS INTEGER)
                          + 2 * CAST(is_outage AS INTEGER) + 2 * CAST(is_spike AS INTEGER) AS INTEGER) AS score3
           FROM l7)""",
]

_BASE = "snapshot, day, time, hour_of_day, today, yesterday, same_day_last_week, avg_last_week, avg_last_month"


def _sev(score):
    return (f"CASE WHEN is_outage THEN 'CRITICAL' WHEN is_spike THEN 'WARNING' WHEN {score} >= 2 THEN 'WARNING' "
            f"WHEN {score} = 1 THEN 'INFO' ELSE 'NORMAL' END")


SQL["checkout_baselines"] = with_(*CHECKOUT) + "SELECT * FROM checkout"

SQL["checkout_4layer"] = with_(*LAYERS) + f"""
SELECT {_BASE}, expected, estimated_std, z_score, is_zscore_anomaly, is_low_traffic, abs_deviation,
       is_volume_anomaly, is_outage, historical_max, is_spike, actual_change, expected_change, change_deviation,
       change_std, change_z_score, is_slope_anomaly, anomaly_score, {_sev('anomaly_score')} AS severity,
       anomaly_score > 0 AS is_anomalous
FROM det"""

SQL["checkout_3layer"] = with_(*LAYERS) + f"""
SELECT {_BASE}, expected, estimated_std, z_score, is_zscore_anomaly, is_low_traffic, abs_deviation, pct_deviation,
       is_volume_anomaly, is_outage, historical_max, is_spike, score3 AS anomaly_score,
       {_sev('score3')} AS severity, score3 > 0 AS is_anomalous
FROM det"""

SQL["checkout_naive"] = with_(*CHECKOUT) + """
SELECT snapshot, day, time, today, avg_last_week, avg_last_month,
       CASE WHEN avg_last_week <> 0 THEN (CAST(today AS DOUBLE) - avg_last_week) / avg_last_week END * 100.0::DOUBLE AS pct_deviation_week,
       COALESCE(avg_last_week <> 0 AND abs((CAST(today AS DOUBLE) - avg_last_week) / avg_last_week) > 0.5, false) AS is_naive_anomaly,
       CASE WHEN avg_last_week = 0 THEN 'UNKNOWN'
            WHEN abs((CAST(today AS DOUBLE) - avg_last_week) / avg_last_week) > 1.0 THEN 'CRITICAL'
            WHEN abs((CAST(today AS DOUBLE) - avg_last_week) / avg_last_week) > 0.5 THEN 'WARNING'
            ELSE 'NORMAL' END AS naive_severity
FROM checkout"""


def _r1(x):
    return f"CAST(floor(({x}) * 10.0 + 0.5) AS DOUBLE) / 10.0"


SQL["checkout_bounds"] = with_(*LAYERS) + f"""
SELECT snapshot, day, time, CASE WHEN is_low_traffic THEN 'LOW' ELSE 'HIGH' END AS traffic_level,
       {_r1('expected')} AS expected_1dp, {_r1('greatest(0.0, expected - 2.0 * estimated_std)')} AS lower_bound,
       {_r1('expected + 2.0 * estimated_std')} AS upper_bound
FROM det"""

SQL["checkout_bands"] = with_(*LAYERS) + """
SELECT snapshot, day, hour_of_day, today, expected, greatest(0.0, expected - estimated_std) AS band1_lower,
       expected + estimated_std AS band1_upper, greatest(0.0, expected - 2.0 * estimated_std) AS band2_lower,
       expected + 2.0 * estimated_std AS band2_upper
FROM det"""

SQL["checkout_ratio"] = with_(*CHECKOUT, """r AS (SELECT day, hour_of_day, snapshot,
       CASE WHEN avg_last_week <> 0 THEN CAST(today AS DOUBLE) / avg_last_week END AS ratio FROM checkout)""") + """
SELECT day, hour_of_day,
       MAX(CASE WHEN snapshot = 'click' THEN ratio END) AS click, MAX(CASE WHEN snapshot = 'error' THEN ratio END) AS error,
       MAX(CASE WHEN snapshot = 'purchase' THEN ratio END) AS purchase, MAX(CASE WHEN snapshot = 'signup' THEN ratio END) AS signup,
       MAX(CASE WHEN snapshot = 'view' THEN ratio END) AS view
FROM r GROUP BY day, hour_of_day"""

SQL["checkout_totals"] = with_(*CHECKOUT, """g AS (SELECT snapshot, day, CAST(SUM(today) AS BIGINT) AS total_today,
       SUM(avg_last_week) AS total_avg_week, SUM(avg_last_month) AS total_avg_month FROM checkout GROUP BY snapshot, day)""") + """
SELECT snapshot, day, total_today, ROUND(total_avg_week, 9) AS total_avg_week, ROUND(total_avg_month, 9) AS total_avg_month,
       ROUND((CASE WHEN total_avg_week <> 0 THEN CAST(total_today AS DOUBLE) / total_avg_week END - 1.0) * 100.0, 9) AS pct_vs_week,
       ROUND((CASE WHEN total_avg_month <> 0 THEN CAST(total_today AS DOUBLE) / total_avg_month END - 1.0) * 100.0, 9) AS pct_vs_month
FROM g"""

SQL["checkout_reasons"] = with_(*LAYERS) + """
SELECT snapshot, day, time, """ + _sev("anomaly_score") + """ AS severity, anomaly_score,
       concat_ws('; ',
         CASE WHEN is_outage THEN 'OUTAGE: Volume dropped to zero while significant traffic expected' END,
         CASE WHEN is_spike THEN 'SPIKE: Today (' || CAST(today AS VARCHAR) || ') > 3x historical max ('
                                 || printf('%.0f', CAST(floor(historical_max + 0.5) AS DOUBLE)) || ')' END,
         CASE WHEN is_zscore_anomaly THEN 'STATISTICAL: ' || printf('%+.2f', CAST(floor(z_score * 100.0 + 0.5) AS DOUBLE) / 100.0)
                                 || 'σ ' || CASE WHEN z_score > 0 THEN 'above' ELSE 'below' END || ' expected range' END,
         CASE WHEN is_volume_anomaly THEN 'VOLUME: Significant deviation given traffic level' END) AS reasons
FROM det WHERE anomaly_score > 0"""

# --- policy detector ------------------------------------------------------------------
_ST = ("denied", "failed", "reversed", "backend_reversed", "approved")
_ORD = "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(_ST)) + " END"


def _wide_cols(src_status="status", src_cnt="cnt"):
    return ", ".join(f"SUM(CASE WHEN {src_status} = '{s}' THEN {src_cnt} ELSE 0 END) AS {s}" for s in _ST)


def _fmt1(x):
    return f"printf('%.1f', CAST(floor(({x}) * 10.0 + 0.5) AS DOUBLE) / 10.0)"


def _r2(x):
    return f"(CAST(floor(({x}) * 100.0 + 0.5) AS DOUBLE) / 100.0)"


def _policy_tail(group: str, where_enough: str = "n_history >= 30", warn: float = 2.5, crit: float = 4.0,
                 extra: str = "") -> list[str]:
    """From lg(eval_ts, n_history, status, cur, s1, s2) to scored details."""
    return [
        """sc AS (SELECT *, CASE WHEN n_history > 0 THEN CAST(s1 AS DOUBLE) / CAST(n_history AS DOUBLE) ELSE 0.0 END AS mean,
                  COALESCE(CASE WHEN n_history >= 2 THEN sqrt(CAST(CAST(n_history AS HUGEINT) * s2 - CAST(s1 AS HUGEINT) * s1 AS DOUBLE)
                           / (CAST(n_history AS DOUBLE) * CAST(n_history - 1 AS DOUBLE))) END, 0.0) AS std FROM lg)""",
        "zz AS (SELECT *, (CAST(cur AS DOUBLE) - mean) / greatest(std, 1.0) AS zraw FROM sc)",
        f"""ov AS (SELECT {group}, MAX({_r2("zraw")}) + 0.0 AS mz,
                  MAX(CASE WHEN {_r2("zraw")} > {crit} THEN 2 WHEN {_r2("zraw")} > {warn} THEN 1 ELSE 0 END) AS r,
                  string_agg(CASE WHEN zraw > {warn} THEN status END, ', ' ORDER BY {_ORD}) AS names
           FROM zz GROUP BY {group})""",
        f"""det AS (SELECT {extra}zz.eval_ts, zz.status, CAST(zz.cur AS BIGINT) AS current_value, {_r2("zz.mean")} AS baseline_mean,
                   {_r2("zz.std")} AS baseline_std, {_r2("zz.zraw")} + 0.0 AS z_score, zz.zraw AS z_raw,
                   zz.zraw > {warn} AS is_anomalous,
                   CASE WHEN zz.zraw > {warn} THEN zz.status || ' count ' || CAST(CAST(zz.cur AS BIGINT) AS VARCHAR) || ' is '
                        || {_fmt1('zz.zraw')} || 'σ above baseline (mean=' || {_fmt1('zz.mean')} || ', std='
                        || {_fmt1('zz.std')} || ')' ELSE '' END AS contribution,
                   zz.n_history,
                   CASE WHEN ov.r = 2 THEN 'CRITICAL' WHEN ov.r = 1 THEN 'WARNING' ELSE 'NORMAL' END AS overall_severity,
                   ov.mz AS max_z_score,
                   CASE WHEN ov.r = 2 THEN 'ALERT: Critical anomaly detected in ' || ov.names
                             || '. Immediate investigation recommended. Check payment gateway status and system health.'
                        WHEN ov.r = 1 THEN 'WARNING: Elevated anomaly in ' || ov.names
                             || '. Monitor closely. Consider pre-emptive investigation if trend continues.'
                        ELSE 'All transaction statuses within normal parameters.' END AS recommendation
           FROM zz JOIN ov USING ({group}) WHERE zz.{where_enough})""",
    ]


_LG_SNAPSHOT = [
    "a AS (SELECT max(ts) AS eval_ts FROM tx)",
    "h AS (SELECT * FROM tx WHERE ts >= (SELECT eval_ts FROM a) - INTERVAL 60 HOUR)",
    f"wd AS (SELECT ts, {_wide_cols()} FROM h GROUP BY ts)",
    "lg0 AS (" + " UNION ALL ".join(f"SELECT ts, '{s}' AS status, {s} AS v FROM wd" for s in _ST) + ")",
    """lg AS (SELECT (SELECT eval_ts FROM a) AS eval_ts, (SELECT COUNT(*) FROM wd) AS n_history, status,
                 SUM(CASE WHEN ts >= (SELECT eval_ts FROM a) - INTERVAL 1 HOUR THEN v ELSE 0 END) AS cur,
                 SUM(v) AS s1, SUM(CAST(v AS HUGEINT) * CAST(v AS HUGEINT)) AS s2 FROM lg0 GROUP BY status)""",
]

SQL["policy_detect"] = with_(TX, *_LG_SNAPSHOT, *_policy_tail("eval_ts")) + "SELECT * FROM det"

_wh = "(ORDER BY ts RANGE BETWEEN INTERVAL 60 HOUR PRECEDING AND CURRENT ROW)"
_wc = "(ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)"
SQL["policy_backtest"] = with_(
    TX, f"wd AS (SELECT ts, {_wide_cols()} FROM tx GROUP BY ts)",
    "fr AS (SELECT ts AS eval_ts, COUNT(*) OVER " + _wh + " AS n_history, " + ", ".join(
        f"SUM({s}) OVER {_wc} AS {s}__cur, SUM({s}) OVER {_wh} AS {s}__s1, "
        f"SUM(CAST({s} AS HUGEINT) * CAST({s} AS HUGEINT)) OVER {_wh} AS {s}__s2" for s in _ST) + " FROM wd)",
    "lg AS (" + " UNION ALL ".join(
        f"SELECT eval_ts, n_history, '{s}' AS status, {s}__cur AS cur, {s}__s1 AS s1, {s}__s2 AS s2 FROM fr"
        for s in _ST) + ")",
    *_policy_tail("eval_ts")) + "SELECT * FROM det"

SQL["analyze_report"] = with_(TX, *_LG_SNAPSHOT, *_policy_tail("eval_ts")) + """
SELECT eval_ts, status, CASE WHEN abs(z_score) > 4.0 THEN 'CRITICAL' WHEN abs(z_score) > 2.5 THEN 'WARNING' ELSE 'NORMAL' END AS severity,
       z_score, current_value, baseline_mean, baseline_std, is_anomalous, contribution AS message, overall_severity,
       max_z_score, recommendation, 60 AS window, 'policy_zscore' AS detection_method
FROM det"""

SQL["current_status"] = with_(TX, *_LG_SNAPSHOT, *_policy_tail("eval_ts", "n_history >= 0")) + """
SELECT eval_ts,
       CASE WHEN MAX(n_history) >= 30 THEN MAX(overall_severity) ELSE 'NORMAL' END AS overall_severity,
       CASE WHEN MAX(n_history) >= 30 THEN MAX(max_z_score) ELSE 0.0 END AS max_z_score,
       CASE WHEN MAX(n_history) >= 30 THEN string_agg(status || '=' || printf('%.2f', z_score), ', ' ORDER BY """ + _ORD + """) END AS statuses_text
FROM det GROUP BY eval_ts"""

SQL["evaluate_counts"] = with_(TX, *_LG_SNAPSHOT, """base AS (
  SELECT status, n_history AS n, CASE WHEN n_history > 0 THEN CAST(s1 AS DOUBLE) / CAST(n_history AS DOUBLE) ELSE 0.0 END AS mean,
         COALESCE(CASE WHEN n_history >= 2 THEN sqrt(CAST(CAST(n_history AS HUGEINT) * s2 - CAST(s1 AS HUGEINT) * s1 AS DOUBLE)
                  / (CAST(n_history AS DOUBLE) * CAST(n_history - 1 AS DOUBLE))) END, 0.0) AS std FROM lg)""",
    """obs AS (SELECT ts AS obs_ts, status, cnt FROM tx WHERE ts >= (SELECT max(ts) FROM tx) - INTERVAL 24 HOUR)""",
    """j AS (SELECT o.*, COALESCE(b.n, 0) AS n, COALESCE(b.mean, 0.0) AS mean, COALESCE(b.std, 0.0) AS std,
                 (CAST(o.cnt AS DOUBLE) - COALESCE(b.mean, 0.0)) / greatest(COALESCE(b.std, 0.0), 1.0) AS z,
                 o.status IN ('denied', 'failed', 'reversed', 'backend_reversed') AND o.cnt > 0 AS prob
          FROM obs o LEFT JOIN base b ON o.status = b.status)""") + f"""
SELECT obs_ts, status, cnt,
       CASE WHEN n < 30 AND prob THEN 'CRITICAL' WHEN n < 30 THEN 'NORMAL' WHEN z > 4.0 THEN 'CRITICAL'
            WHEN z > 2.5 THEN 'WARNING' ELSE 'NORMAL' END AS severity,
       CASE WHEN n < 30 AND prob THEN 10.0 WHEN n < 30 THEN 0.0 ELSE {_r2("z")} + 0.0 END AS z_score,
       CASE WHEN n < 30 THEN 0.0 ELSE {_r2("mean")} END AS baseline_mean,
       CASE WHEN n < 30 THEN 0.0 ELSE {_r2("std")} END AS baseline_std,
       CASE WHEN n < 30 THEN prob ELSE z > 2.5 END AS is_anomalous,
       CASE WHEN n < 30 AND prob THEN status || ' count ' || CAST(cnt AS VARCHAR)
                 || ' detected with no historical baseline (problem status should be rare/zero)'
            WHEN n < 30 THEN 'Insufficient history (' || CAST(n AS VARCHAR) || ' < 30) for reliable evaluation.'
            WHEN z > 2.5 THEN status || ' count ' || CAST(cnt AS VARCHAR) || ' is ' || {_fmt1('z')}
                 || 'σ above baseline (mean=' || {_fmt1('mean')} || ', std=' || {_fmt1('std')} || ')'
            ELSE '' END AS message
FROM j"""

# --- alerts: recursive walk of the cooldown chain ---------------------------------------
_BT = SQL["policy_backtest"][:SQL["policy_backtest"].rindex("SELECT * FROM det")]
ALERTS = _BT.rstrip() + """,
cands AS (SELECT *, CASE WHEN abs(z_score) > 4.0 THEN 'CRITICAL' WHEN abs(z_score) > 2.5 THEN 'WARNING' END AS severity,
                 date_diff('second', TIMESTAMP '1970-01-01', eval_ts) AS t
          FROM det WHERE overall_severity <> 'NORMAL' AND is_anomalous AND abs(z_score) > 2.5),
nx AS (SELECT a.status, a.severity, a.t, MIN(b.t) AS nxt FROM cands a
       LEFT JOIN cands b ON a.status = b.status AND a.severity = b.severity AND b.t >= a.t + 18000
       GROUP BY a.status, a.severity, a.t),
chain AS (SELECT * FROM (WITH RECURSIVE ch(status, severity, t) AS (
            SELECT status, severity, MIN(t) FROM cands GROUP BY status, severity
            UNION ALL
            SELECT n.status, n.severity, n.nxt FROM ch JOIN nx n
              ON ch.status = n.status AND ch.severity = n.severity AND ch.t = n.t WHERE n.nxt IS NOT NULL)
          SELECT * FROM ch)),
fired AS (SELECT c.status, c.severity, c.current_value, c.baseline_mean, c.baseline_std, c.z_score,
                 c.max_z_score AS score, c.eval_ts AS alert_ts
          FROM cands c SEMI JOIN chain h ON c.status = h.status AND c.severity = h.severity AND c.t = h.t)
"""

SQL["alert_dispatch"] = ALERTS + "SELECT * FROM fired"
SQL["alert_counts"] = ALERTS + "SELECT status, severity, COUNT(*) AS alerts FROM fired GROUP BY status, severity"
SQL["alert_outbox"] = ALERTS + """SELECT status, alert_ts,
  to_json(struct_pack(alert := true, status := status, severity := severity, current_value := current_value,
          baseline_mean := baseline_mean, baseline_std := baseline_std, z_score := z_score, score := score,
          "timestamp" := strftime(alert_ts, '%Y-%m-%dT%H:%M:%S'), service := 'monitor'))::VARCHAR AS payload
FROM fired WHERE severity = 'CRITICAL'"""

# --- messages, streaming, metrics, logs ------------------------------------------------
TXM = f"""txm AS (
  SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS ts, {STATUS_CASE} AS status, COUNT(*) AS cnt
  FROM events GROUP BY 1, 2)"""

SQL["batch_messages"] = with_(TXM) + """
SELECT ts, to_json(struct_pack(records := list(struct_pack("timestamp" := strftime(ts, '%Y-%m-%dT%H:%M:%S'),
                                                           status := status, "count" := cnt) ORDER BY status, cnt)))::VARCHAR AS message
FROM txm GROUP BY ts"""

SQL["decode_batches"] = with_(TXM) + "SELECT ts, status, cnt FROM txm"
SQL["stream_ingest"] = SQL["decode_batches"]

SQL["stream_minutes"] = with_(TX) + """
SELECT ts, """ + ", ".join(f"CAST(SUM(CASE WHEN status = '{s}' THEN cnt ELSE 0 END) AS BIGINT) AS {s}"
                          for s in ("denied", "failed", "reversed", "backend_reversed", "approved")) + """,
       CAST(SUM(cnt) AS BIGINT) AS total
FROM tx GROUP BY ts"""

SQL["ingest_counters"] = with_(TXM, """per AS (SELECT ts, status, COUNT(*) AS r, SUM(cnt) AS c FROM txm GROUP BY ts, status)""") + """
SELECT status, CAST(SUM(r) AS BIGINT) AS records_consumed, CAST(SUM(c) AS BIGINT) AS cumulative_count,
       CAST(arg_max(c, ts) AS BIGINT) AS last_batch_count, MAX(ts) AS last_batch
FROM per GROUP BY status"""

_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
REQ = """req AS (
  SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
         '/events/' || event_type AS path,
         CASE WHEN value < 1 THEN 500 WHEN value < 5 THEN 404 ELSE 200 END AS status,
         value / 1000.0 AS duration
  FROM events)"""

SQL["duration_histogram"] = with_(REQ, "g AS (SELECT path AS operation, " + ", ".join(
    f"CAST(SUM(CASE WHEN duration <= {b!r} THEN 1 ELSE 0 END) AS BIGINT) AS b{i}" for i, b in enumerate(_BUCKETS))
    + ", SUM(duration) AS sum, COUNT(duration) AS count FROM req GROUP BY path)") + "\n" + "\nUNION ALL\n".join(
    [f"SELECT operation, '{b:g}' AS le, b{i} AS bucket_count, sum, count FROM g" for i, b in enumerate(_BUCKETS)]
    + ["SELECT operation, '+Inf' AS le, count AS bucket_count, sum, count FROM g"])

SQL["request_counts"] = with_(REQ) + """
SELECT method, path, status, COUNT(*) AS requests FROM req
WHERE path NOT IN ('/metrics', '/health') GROUP BY method, path, status"""

SQL["log_parse"] = """
SELECT CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS level, CAST(NULL AS VARCHAR) AS logger,
       'plain: ' || coalesce(text, '') AS message, CAST(NULL AS VARCHAR) AS trace_id, CAST(NULL AS VARCHAR) AS span_id
FROM conversations WHERE conv_id % 13 = 0
UNION ALL
SELECT make_timestamp(CAST(CAST(conv_id * 60 + turn AS DOUBLE) * 1000000.0 AS BIGINT)) AS ts,
       CASE WHEN role = 'user' THEN 'INFO' WHEN role = 'assistant' THEN 'DEBUG' ELSE 'WARNING' END AS level,
       'chat.' || role AS logger, text AS message,
       lpad(lower(hex(conv_id)), 32, '0') AS trace_id, lpad(lower(hex(turn)), 16, '0') AS span_id
FROM conversations WHERE conv_id % 13 <> 0"""

SQL["parse_headers"] = """
WITH h AS (
  SELECT o_orderkey, o_orderpriority AS source,
         '00-' || lpad(lower(hex(o_orderkey)), 32, '0') || '-' || lpad(lower(hex(o_custkey)), 16, '0') || '-'
         || CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '01' END AS tp
  FROM orders),
p AS (SELECT *, regexp_matches(tp, '^[0-9a-f]{2}-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$') AS ok FROM h)
SELECT o_orderkey, 2 AS n_headers, source,
       CASE WHEN ok THEN split_part(tp, '-', 1) END AS version, CASE WHEN ok THEN split_part(tp, '-', 2) END AS trace_id,
       CASE WHEN ok THEN split_part(tp, '-', 3) END AS span_id, CASE WHEN ok THEN split_part(tp, '-', 4) END AS flags,
       ok AS valid
FROM p"""

# Streams are flushed, so they hold every window and period.
SQL["stream_outages"] = SQL["outage_periods"]

SQL["stream_late"] = SQL["stream_minutes"]

SQL["stream_baseline"] = with_(TX, f"u AS (SELECT ts, {_wide_cols()} FROM tx GROUP BY ts)",
    "g AS (SELECT unnest(generate_series((SELECT MIN(ts) FROM u), (SELECT MAX(ts) FROM u), INTERVAL 1 HOUR)) AS t)") + """
SELECT g.t AS ts, COUNT(*) AS n_history, """ + ", ".join(
    f"ROUND(AVG({s}), 9) AS {s}_mean, ROUND(STDDEV_SAMP({s}), 9) AS {s}_std" for s in _ST) + """
FROM g JOIN u ON u.ts BETWEEN g.t - INTERVAL 60 HOUR AND g.t
GROUP BY g.t"""

_SHOP_TX = f"""tx AS (SELECT user_id % 4 AS shop, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, {STATUS_CASE} AS status,
          COUNT(*) AS cnt FROM events GROUP BY 1, 2, 3)"""

SQL["stream_outages_keyed"] = with_(_SHOP_TX, """v AS (SELECT shop, ts, CAST(SUM(cnt) AS BIGINT) AS total FROM tx GROUP BY shop, ts),
o AS (SELECT shop, ts FROM v WHERE total <= 5),
g AS (SELECT shop, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS st
      FROM o WINDOW w AS (PARTITION BY shop ORDER BY ts)),
i AS (SELECT shop, ts, SUM(st) OVER (PARTITION BY shop ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pid FROM g),
p AS (SELECT shop, pid, MIN(ts) AS start_ts, MAX(ts) AS end_ts, COUNT(*) AS outage_stamps FROM i GROUP BY shop, pid)""") + """
SELECT shop, start_ts, end_ts, CAST(date_diff('hour', start_ts, end_ts) + 1 AS BIGINT) AS duration, outage_stamps,
       (SELECT AVG(total) FROM v WHERE v.shop = p.shop AND v.ts BETWEEN p.start_ts AND p.end_ts) AS avg_volume,
       CASE WHEN date_diff('hour', start_ts, end_ts) + 1 >= 5 THEN 'CRITICAL'
            WHEN date_diff('hour', start_ts, end_ts) + 1 >= 2 THEN 'WARNING' ELSE 'INFO' END AS severity
FROM p"""

SQL["stream_baseline_keyed"] = with_(_SHOP_TX, f"u AS (SELECT shop, ts, {_wide_cols()} FROM tx GROUP BY shop, ts)",
    "g AS (SELECT shop, unnest(generate_series(MIN(ts), MAX(ts), INTERVAL 1 HOUR)) AS t FROM u GROUP BY shop)") + """
SELECT g.shop, g.t AS ts, COUNT(*) AS n_history, """ + ", ".join(
    f"ROUND(AVG({s}), 9) AS {s}_mean, ROUND(STDDEV_SAMP({s}), 9) AS {s}_std" for s in _ST) + """
FROM g JOIN u ON u.shop = g.shop AND u.ts BETWEEN g.t - INTERVAL 60 HOUR AND g.t
GROUP BY g.shop, g.t"""

# Records behind the watermark that the first micro-batch leaves.
SQL["stream_corrections"] = with_(TXM, """e AS (
  SELECT *, CAST(epoch(ts) AS BIGINT) AS s FROM txm), half AS (SELECT (MIN(s) + MAX(s)) // 2 AS h FROM e),
mark AS (SELECT MAX(s) - 120 AS m FROM e, half WHERE s % 300 <> 0 AND s <= h),
k AS (SELECT e.*, s // 3600 * 3600 + 3600 <= m AND s % 300 = 0 AS late, s >= m - 259200 AS near FROM e, mark),
w AS (SELECT *, date_trunc('hour', ts) AS hour, NOT late OR near AS wanted FROM k)""") + """
SELECT CAST(hour AS TIMESTAMP) AS ts, """ + ", ".join(
    f"CAST(SUM(CASE WHEN status = '{s}' THEN cnt ELSE 0 END) FILTER (wanted) AS BIGINT) AS {s}" for s in _ST) + """,
  CAST(SUM(cnt) FILTER (wanted) AS BIGINT) AS total, NULLIF(COUNT(*) FILTER (wanted), 0) AS records,
  CASE WHEN COUNT(*) FILTER (wanted) > 0 THEN COUNT(*) FILTER (wanted AND late) END AS late_records,
  CASE WHEN COUNT(*) FILTER (wanted) > 0 THEN CAST(bool_or(wanted AND late) AS BIGINT) END AS corrections,
  COUNT(*) FILTER (NOT wanted) AS dropped
FROM w GROUP BY hour"""

SQL["stream_metrics"] = with_(TXM) + """
SELECT 'records' AS metric, COUNT(*) AS total FROM txm
UNION ALL SELECT 'cnt', CAST(SUM(cnt) AS BIGINT) FROM txm
UNION ALL SELECT s, CAST(SUM(CASE WHEN status = s THEN cnt ELSE 0 END) AS BIGINT)
  FROM txm CROSS JOIN (VALUES """ + ", ".join(f"('{s}')" for s in _ST) + """) v(s) GROUP BY s
UNION ALL SELECT 'consume_batches', 2 UNION ALL SELECT 'insert_batches', 2"""

_TRACES = with_("""p AS (
  SELECT lpad(lower(hex(o_orderkey + 1)), 32, '0') AS trace_id, lpad(lower(hex((o_orderkey + 1) * 2 + 1)), 16, '0') AS span_id,
         o_orderdate AS produced_ts FROM orders),
c0 AS (
  SELECT l_orderkey + CASE WHEN l_returnflag = 'R' THEN 1000000000 ELSE 1 END AS k, l_tax < 0.08 AS ok,
         l_orderkey * 8 + l_linenumber AS consumer_id, l_shipdate AS consumed_ts FROM lineitem),
c AS (
  SELECT CASE WHEN ok THEN lpad(lower(hex(k)), 32, '0') END AS trace_id, CASE WHEN ok THEN lpad(lower(hex(k * 2 + 1)), 16, '0') END AS span_id,
         consumer_id, consumed_ts FROM c0),
links AS (
  SELECT coalesce(p.trace_id, c.trace_id) AS trace_id, coalesce(p.span_id, c.span_id) AS span_id, produced_ts, consumed_ts, consumer_id,
         (epoch_us(consumed_ts) - epoch_us(produced_ts)) / 1000000.0 AS latency,
         CASE WHEN produced_ts IS NULL THEN 'no producer' WHEN consumed_ts IS NULL THEN 'no consumer' ELSE 'linked' END AS link
  FROM p FULL JOIN c ON p.trace_id = c.trace_id AND p.span_id = c.span_id
       AND consumed_ts BETWEEN produced_ts AND produced_ts + INTERVAL 400 DAY)""")
SQL["trace_links"] = SQL["stream_traces"] = _TRACES + "SELECT * FROM links"
SQL["trace_summary"] = _TRACES.rstrip() + """,
n AS (SELECT link, COUNT(*) AS records FROM links GROUP BY link),
b AS (""" + "\nUNION ALL ".join(
    f"SELECT 'linked' AS link, '{d * 86400:g}' AS le, COUNT(*) FILTER (latency <= {d * 86400}) AS bucket_count FROM links WHERE link = 'linked'"
    for d in (1, 7, 30, 90, 180, 365)) + """
UNION ALL SELECT 'linked', '+Inf', COUNT(*) FROM links WHERE link = 'linked')
SELECT n.link, n.records, b.le, b.bucket_count FROM n LEFT JOIN b USING (link)"""

SQL["rolling_keyed_supplier"] = with_(
    """sw AS (SELECT s.s_nationkey, CAST(date_trunc('week', l.l_shipdate) AS TIMESTAMP) AS ts, COUNT(*) AS cnt
            FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2)""",
    f"r AS ({rolling_exact('sw', 'cnt', part='s_nationkey')})",
    "z AS (SELECT *, (CAST(cnt AS DOUBLE) - rolling_mean) / rolling_std AS z_score FROM r)") + f"""
SELECT s_nationkey, ts, cnt AS value, rolling_mean, rolling_std, z_score, {zflags(3.0)} FROM z"""

SQL["event_heads"] = with_(*SIG, f"r AS ({rolling_float('rates', 'error_rate')})",
                           "ez AS (SELECT ts, (error_rate - rolling_mean) / rolling_std AS z FROM r)") + """
(SELECT 'error_spike' AS report, ts, CAST(NULL AS VARCHAR) AS severity, ROUND(z, 9) AS score
 FROM ez WHERE z > 2.5 ORDER BY ts LIMIT 20)
UNION ALL
(SELECT 'critical_warning' AS report, ts, severity, CAST(total_score AS DOUBLE) AS score
 FROM tl WHERE severity IN ('CRITICAL', 'WARNING') ORDER BY ts LIMIT 30)"""

# The periodic checks: the backtest at the last stamps, with the checks' thresholds.
_CHECKS = with_(
    TX, f"wd AS (SELECT ts, {_wide_cols()} FROM tx GROUP BY ts)",
    "fr AS (SELECT ts AS eval_ts, COUNT(*) OVER " + _wh + " AS n_history, " + ", ".join(
        f"SUM({s}) OVER {_wc} AS {s}__cur, SUM({s}) OVER {_wh} AS {s}__s1, "
        f"SUM(CAST({s} AS HUGEINT) * CAST({s} AS HUGEINT)) OVER {_wh} AS {s}__s2" for s in _ST) + " FROM wd)",
    "lg AS (SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT eval_ts, n_history, '{s}' AS status, {s}__cur AS cur, {s}__s1 AS s1, {s}__s2 AS s2 FROM fr"
        for s in _ST) + ") WHERE eval_ts IN (SELECT DISTINCT ts FROM tx ORDER BY ts DESC LIMIT 4))",
    *_policy_tail("eval_ts", warn=0.5, crit=1.5))

SQL["stream_alerts"] = _CHECKS + "SELECT * FROM det"
SQL["stream_gauges"] = _CHECKS + """SELECT eval_ts, status, z_score AS score FROM det
UNION ALL SELECT DISTINCT eval_ts, 'overall' AS status, max_z_score AS score FROM det"""
_CHECK_ALERTS = _CHECKS.rstrip() + ALERTS[len(_BT.rstrip()):].replace("> 4.0", "> 1.5").replace("> 2.5", "> 0.5").replace(
    "18000", "7200")
SQL["stream_outbox"] = _CHECK_ALERTS + SQL["alert_outbox"][len(ALERTS):]
SQL["stream_cooldown"] = ALERTS + "SELECT status, severity, alert_ts, z_score FROM fired"

SQL["alert_no_cooldown"] = ALERTS + """SELECT status, severity, current_value, baseline_mean, baseline_std, z_score,
  max_z_score AS score, eval_ts AS alert_ts FROM cands"""

_SHOP_WH = _wh.replace("(ORDER", "(PARTITION BY shop ORDER")
_SHOP_WC = _wc.replace("(ORDER", "(PARTITION BY shop ORDER")
_SHOPS = with_(
    f"""tx AS (SELECT user_id % 4 AS shop, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, {STATUS_CASE} AS status,
            COUNT(*) AS cnt FROM events GROUP BY 1, 2, 3)""",
    f"wd AS (SELECT shop, ts, {_wide_cols()} FROM tx GROUP BY shop, ts)",
    "fr AS (SELECT shop, ts AS eval_ts, COUNT(*) OVER " + _SHOP_WH + " AS n_history, " + ", ".join(
        f"SUM({s}) OVER {_SHOP_WC} AS {s}__cur, SUM({s}) OVER {_SHOP_WH} AS {s}__s1, "
        f"SUM(CAST({s} AS HUGEINT) * CAST({s} AS HUGEINT)) OVER {_SHOP_WH} AS {s}__s2" for s in _ST) + " FROM wd)",
    "lg AS (" + " UNION ALL ".join(
        f"SELECT shop, eval_ts, n_history, '{s}' AS status, {s}__cur AS cur, {s}__s1 AS s1, {s}__s2 AS s2 FROM fr"
        for s in _ST) + ")",
    *_policy_tail("shop, eval_ts", extra="zz.shop, "))
_SHOP_ALERTS = _SHOPS.rstrip() + ALERTS[len(_BT.rstrip()):]
for _old, _new in (
        ("SELECT a.status, a.severity, a.t, MIN", "SELECT a.shop, a.status, a.severity, a.t, MIN"),
        ("ON a.status = b.status", "ON a.shop = b.shop AND a.status = b.status"),
        ("GROUP BY a.status, a.severity, a.t", "GROUP BY a.shop, a.status, a.severity, a.t"),
        ("ch(status, severity, t)", "ch(shop, status, severity, t)"),
        ("SELECT status, severity, MIN(t) FROM cands GROUP BY status, severity",
         "SELECT shop, status, severity, MIN(t) FROM cands GROUP BY shop, status, severity"),
        ("SELECT n.status, n.severity, n.nxt", "SELECT n.shop, n.status, n.severity, n.nxt"),
        ("ON ch.status = n.status", "ON ch.shop = n.shop AND ch.status = n.status"),
        ("fired AS (SELECT c.status", "fired AS (SELECT c.shop, c.status"),
        ("ON c.status = h.status", "ON c.shop = h.shop AND c.status = h.status")):
    assert _old in _SHOP_ALERTS, _old
    _SHOP_ALERTS = _SHOP_ALERTS.replace(_old, _new)
SQL["alert_dispatch_keyed"] = _SHOP_ALERTS + "SELECT * FROM fired"

SQL["outage_minutes"] = SQL["outage_periods"].replace("'hour'", "'minute'").replace("INTERVAL 2 HOUR", "INTERVAL 2 MINUTE")

SQL["quality_raw"] = """WITH r AS (
  SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(date_trunc('minute', ts) AS TIMESTAMP) END AS ts,
         CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'denied'
              WHEN 'error' THEN 'failed' WHEN 'click' THEN 'reversed' ELSE 'refunded' END AS status,
         CAST(floor(value) AS BIGINT) - 1 AS cnt
  FROM events)
""" + _quality("raw_records", "r", "ts, status", "status", ["ts", "status", "cnt"])

SQL["reconcile_sources"] = SQL["reconcile"].replace("FROM auth GROUP BY ts", "FROM auth WHERE auth_code < '05' GROUP BY ts")

_FLAG_SUMS = ", ".join(f"CAST(SUM(CAST({c} AS INTEGER)) AS BIGINT) AS {c}" for c in (
    "is_outage", "is_spike", "is_zscore_anomaly", "is_volume_anomaly", "is_slope_anomaly"))
SQL["checkout_flag_counts"] = with_(*LAYERS) + f"""
SELECT snapshot, COUNT(*) AS n_hours, CAST(SUM(CASE WHEN anomaly_score > 0 THEN 1 ELSE 0 END) AS BIGINT) AS anomalous, {_FLAG_SUMS},
       100.0 * (CAST(SUM(CASE WHEN anomaly_score > 0 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)) AS anomalous_pct
FROM det GROUP BY snapshot"""
SQL["checkout_severity"] = with_(*LAYERS) + f"""
SELECT snapshot, {_sev('anomaly_score')} AS severity, COUNT(*) AS n_hours FROM det GROUP BY 1, 2"""
SQL["checkout_labels"] = with_(*LAYERS) + """
SELECT snapshot, day, time, concat_ws(', ', CASE WHEN is_outage THEN 'OUTAGE' END, CASE WHEN is_spike THEN 'SPIKE' END,
       CASE WHEN is_zscore_anomaly THEN 'Z-SCORE' END, CASE WHEN is_volume_anomaly THEN 'VOLUME' END,
       CASE WHEN is_slope_anomaly THEN 'SLOPE' END) AS labels
FROM det WHERE anomaly_score > 0"""
SQL["checkout_rules"] = with_(*LAYERS) + """
SELECT snapshot, day, time,
       CASE WHEN is_outage THEN 'outage' WHEN is_spike THEN 'spike'
            WHEN is_zscore_anomaly AND is_volume_anomaly THEN 'confirmed_deviation'
            WHEN is_zscore_anomaly THEN 'deviation' END AS rule,
       CASE WHEN is_outage THEN 'CRITICAL' WHEN is_spike OR (is_zscore_anomaly AND is_volume_anomaly) THEN 'WARNING'
            WHEN is_zscore_anomaly THEN 'INFO' ELSE 'NORMAL' END AS policy_severity
FROM det"""
SQL["checkout_low_traffic"] = with_(*LAYERS).replace(
    "CAST(SUM(CAST(floor(value) AS BIGINT)) AS BIGINT) AS v",
    "CAST(SUM(CASE WHEN event_id % 499 = 0 THEN 20 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS v") + f"""
SELECT snapshot, day, time, today, is_low_traffic, is_volume_anomaly, {_sev('anomaly_score')} AS severity FROM det"""

SQL["missing_hours"] = """
WITH e AS (SELECT DISTINCT event_type AS snapshot, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
                  CAST(hour(ts) AS INTEGER) AS hour_of_day FROM events),
g AS (SELECT snapshot, day, CAST(unnest(generate_series(0, 23)) AS INTEGER) AS hour_of_day
      FROM (SELECT DISTINCT snapshot, day FROM e))
SELECT g.* FROM g ANTI JOIN e ON g.snapshot = e.snapshot AND g.day = e.day AND g.hour_of_day = e.hour_of_day"""

SQL["analyze_report_short"] = with_(TX) + """
SELECT MAX(ts) AS eval_ts, CAST(NULL AS VARCHAR) AS status, 'NORMAL' AS severity, 'NORMAL' AS overall_severity, 0.0::DOUBLE AS max_z_score,
       'All transaction statuses within normal parameters.' AS recommendation
FROM tx WHERE ts < (SELECT MIN(ts) FROM tx) + INTERVAL 20 HOUR"""
SQL["analyze_report_empty"] = with_(TX) + """
SELECT CAST(NULL AS VARCHAR) AS status, 'NORMAL' AS severity, 'NORMAL' AS overall_severity, 0.0::DOUBLE AS max_z_score,
       'No transaction data available for analysis.' AS recommendation
FROM tx WHERE status = 'none' HAVING COUNT(*) = 0"""
SQL["current_status_empty"] = with_(TX) + """
SELECT 'NORMAL' AS overall_severity, 0.0::DOUBLE AS max_z_score, 0 AS n_statuses FROM tx WHERE status = 'none' HAVING COUNT(*) = 0"""
SQL["evaluate_unmonitored"] = with_(TX) + """
SELECT ts AS obs_ts, 'x_' || status AS status, cnt, 'INVALID' AS severity, false AS is_anomalous,
       'Status ' || chr(39) || 'x_' || status || chr(39) || ' is not monitored. Valid statuses: denied, failed, reversed, backend_reversed, approved' AS message
FROM tx WHERE ts >= (SELECT max(ts) FROM tx) - INTERVAL 24 HOUR"""

SQL["decode_bad_messages"] = f"""
WITH e AS (SELECT event_id, event_id % 20 AS k, ts, {STATUS_CASE} AS status FROM events)
SELECT CASE WHEN r THEN NULL WHEN k = 3 THEN ts ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS ts,
       CASE WHEN NOT r THEN status END AS status, CASE WHEN NOT r THEN event_id END AS cnt,
       CASE WHEN k IN (9, 10) THEN 'no records' WHEN k IN (1, 4) THEN 'bad timestamp' WHEN k = 8 THEN 'no status'
            WHEN k IN (5, 6) THEN 'bad count' WHEN k = 7 THEN 'negative count' END AS reason
FROM (SELECT *, k IN (1, 4, 5, 6, 7, 8, 9, 10) AS r FROM e)"""

SQL["csv_transactions"] = with_(TX) + "SELECT ts, status, cnt FROM tx"
SQL["csv_auth"] = with_(AUTH) + "SELECT ts, auth_code, cnt FROM auth"
SQL["csv_checkout"] = with_(*CHECKOUT) + """
SELECT 'checkout_' || snapshot AS snapshot, hour_of_day AS hour, COUNT(*) AS n, CAST(SUM(today) AS BIGINT) AS today,
       CAST(SUM(yesterday) AS BIGINT) AS yesterday
FROM checkout GROUP BY snapshot, hour_of_day"""
SQL["fact_append"] = with_(TX) + "SELECT ts, status, cnt FROM tx WHERE status IN ('denied', 'failed')"
SQL["checkout_naive_sql"] = SQL["checkout_naive"]
SQL["status_values"] = with_(TX, AUTH) + """SELECT DISTINCT 'status' AS kind, status AS value FROM tx
UNION ALL SELECT DISTINCT 'auth_code' AS kind, auth_code AS value FROM auth"""
_EV = SQL["evaluate_counts"]
SQL["anomalous_insert"] = _EV[:_EV.rindex("SELECT obs_ts")].replace(
    "SELECT ts AS obs_ts, status, cnt FROM tx", "SELECT ts AS obs_ts, status, cnt * 3 AS cnt FROM tx") + """
SELECT obs_ts AS ts, status, cnt FROM j WHERE CASE WHEN n < 30 THEN prob ELSE z > 2.5 END"""

SQL["rule_book_tight"] = SQL["rule_book"]
for _old, _new in (("greatest(sd, 1.0)", "greatest(sd, 0.01)"), ("total < 5", "total < 14"), ("low_run_length >= 5", "low_run_length >= 3"),
                   ("- 3.0 * STDDEV_SAMP(approval_rate)", "- 1.0 * STDDEV_SAMP(approval_rate)"),
                   ("approval_zscore < -2.5", "approval_zscore < -1.5"), ("error_zscore > 2.5", "error_zscore > 1.5")):
    assert _old in SQL["rule_book_tight"], _old
    SQL["rule_book_tight"] = SQL["rule_book_tight"].replace(_old, _new)

SQL["insert_histogram"] = "\n".join(x for x in SQL["duration_histogram"].split("\n")).replace(
    "SELECT operation, '1' AS le, b8 AS bucket_count, sum, count FROM g\nUNION ALL\n", "")

# The same results over a fact table that the library wrote.
SQL["facts_status_summary"] = SQL["status_summary"]
SQL["facts_policy_detect"] = SQL["policy_detect"]
