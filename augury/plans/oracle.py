"""The same queries as plain SQL, used to check the Spark jobs.

``CTES`` holds named relations with their inputs; ``sql(final)`` assembles the ones a final
select mentions.  They are written independently of the Spark operators: range joins, correlated
lookups and recursion instead of slices, scans and chains.
"""

from __future__ import annotations

import re

W, TICK, HALF, VARW, FRESH = 86400, 3600, 14400, 28800, 43200
GAP, SPAN, H, EXCL = 14400, 14400, 21600, 21600

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def r6(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def us(expr: str) -> str:
    return f"epoch_us({expr})"


def ts(expr: str) -> str:
    return f"make_timestamp(CAST({expr} AS BIGINT))"


def variant(suffix: str, names: list[str], replaced: dict[str, str]) -> None:
    """Copies of relations under another cutoff: ``name`` + suffix, with inputs swapped."""
    swaps = {**replaced, **{n: n + suffix for n in names}}
    pattern = re.compile(r"\b(" + "|".join(sorted(swaps, key=len, reverse=True)) + r")\b")
    for name in names:
        CTES[name + suffix] = pattern.sub(lambda m: swaps[m.group(1)], CTES[name])


def sql(final: str) -> str:
    """Prefix ``final`` with the relations it uses, inputs first."""
    ordered: list[str] = []

    def visit(text: str, self_name: str = "") -> None:
        for name in CTES:
            if name != self_name and re.search(rf"\b{name}\b", text) and name not in ordered:
                visit(CTES[name], name)
                ordered.append(name)

    visit(final)
    parts = []
    for name in ordered:
        body = CTES[name]
        if body.startswith("("):  # column list of a recursive relation
            head, rest = re.split(r"\) AS\s", body, maxsplit=1)
            parts.append(f"{name}{head}) AS ({rest})")
        else:
            parts.append(f"{name} AS ({body})")
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final.strip()


cte("v_events", """
SELECT event_id, ts, epoch_us(ts) AS t, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       'h' || CAST(user_id // 15 AS VARCHAR) AS host_id
FROM events
""")
cte("v_now", "SELECT max(ts) AS now_ts, max(epoch_us(ts)) AS now_us FROM events")
cte("v_samples", """
SELECT host_id,
  CASE event_type
    WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'cpu_usage_percent' ELSE 'network_receive_bytes_per_second' END
    WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'memory_usage_percent' ELSE 'network_transmit_bytes_per_second' END
    WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'disk_read_bytes_per_second' ELSE 'disk_write_bytes_per_second' END
    WHEN 'signup' THEN 'latency_p95_seconds' ELSE 'error_rate' END AS metric,
  ts, t,
  CASE event_type WHEN 'signup' THEN value * 0.01428571828 WHEN 'error' THEN value * 0.001428571828 ELSE value END AS value,
  event_id
FROM v_events
""")
cte("v_dirty", """
SELECT * FROM v_samples
UNION ALL SELECT * FROM v_samples WHERE event_id % 50 = 0
UNION ALL SELECT host_id, metric, ts, t, value + 1, event_id FROM v_samples WHERE event_id % 97 = 0
UNION ALL SELECT host_id, metric, ts, t, CAST('NaN' AS DOUBLE), event_id FROM v_samples WHERE event_id % 101 = 0
""")
cte("v_series", """
SELECT *, 'node-' || host_id || CASE
    WHEN metric <> 'cpu_usage_percent' AND event_id % 211 = 0 THEN '-x'
    WHEN metric = 'cpu_usage_percent' AND event_id % 1013 = 0 THEN '-x' ELSE '' END AS host_name,
  'demo' AS environment
FROM v_samples
""")
cte("v_map", """
SELECT DISTINCT host_id, 'job-' || host_id AS service_job FROM v_events
WHERE CAST(substr(host_id, 2) AS BIGINT) % 3 <> 2
""")
cte("v_probes", """
SELECT host_id, event_id AS probe_id, ts AS observed_at, t, value / 100.0 AS latency_seconds,
  CASE WHEN k < 2 THEN NULL WHEN event_type = 'error' THEN 503 WHEN k = 50 THEN 404 ELSE 200 END AS status_code,
  CASE WHEN event_id % 503 = 0 THEN 1.0 ELSE 2.0 END AS slo_seconds
FROM v_events
""")
cte("v_outcomes", """
SELECT *, outcome <> 'healthy' AS breached FROM (
SELECT *, CASE WHEN status_code IS NULL THEN 'service_unavailable'
  WHEN status_code >= 500 THEN 'http_error_slo_breach'
  WHEN status_code <> 200 THEN 'unexpected_response'
  WHEN latency_seconds > 2.0 THEN 'latency_slo_breach' ELSE 'healthy' END AS outcome
FROM v_probes)
""")
cte("v_experiments", """
SELECT 'x' || CAST(event_id AS VARCHAR) AS experiment_id, host_id,
  ['latency', 'http_503', 'crash', 'latency', 'http_503'][k + 1] AS experiment_type,
  ts AS started_at,
  CASE WHEN k = 4 AND t >= now_us - 259200000000 THEN NULL
       ELSE ts + to_seconds((k + 1) * 3600) END AS ended_at,
  CASE WHEN k = 4 AND t >= now_us - 259200000000 THEN 'running' ELSE 'completed' END AS experiment_status
FROM v_events, v_now WHERE event_type = 'signup' AND k < 5
""")
cte("v_counters", """
SELECT host_id, ts, t, event_id, unnest(['errors_total', 'requests_total']) AS counter,
       unnest([CAST(errors AS BIGINT), requests]) AS value
FROM (SELECT host_id, ts, t, event_id,
        count(*) OVER w AS requests, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS errors
      FROM v_events WINDOW w AS (PARTITION BY host_id, CAST(ts AS DATE) ORDER BY ts, event_id))
""")
cte("v_buckets", """
SELECT host_id, ts, t, event_id, le, CAST(sum(CASE WHEN value / 100.0 <= le THEN 1 ELSE 0 END)
    OVER (PARTITION BY host_id, CAST(ts AS DATE), le ORDER BY ts, event_id) AS BIGINT) AS value
FROM v_events, (SELECT unnest([0.10271828, 0.25271828, 0.50271828, 1.00271828, 2.50271828, 5.00271828, CAST('inf' AS DOUBLE)]) AS le)
""")
cte("v_requests", """
SELECT host_id, event_id AS request_id, ['GET', 'POST', 'PUT', 'DELETE', 'TRACE'][k % 5 + 1] AS method,
  CASE WHEN k = 7 THEN NULL WHEN k = 8 THEN '/metrics' ELSE '/' || event_type END AS route,
  CASE WHEN k < 2 THEN 500 WHEN event_type = 'error' THEN 503 WHEN k = 50 THEN 404 ELSE 200 END AS status_code,
  ts AS started_at, t, value / 100.0 AS duration_seconds
FROM v_events
""")
cte("v_receipts", """
SELECT ts AS received_at, CASE WHEN k % 2 = 0 THEN 'generic' ELSE 'slack' END AS channel,
  CASE WHEN event_id % 89 = 0 THEN '' WHEN event_id % 97 = 0 THEN repeat('k', 129)
       ELSE 'a' || CAST(event_id - CASE WHEN event_id % 7 = 0 THEN event_id % 5 ELSE 0 END AS VARCHAR) END AS idempotency_key,
  event_type AS kind, event_id AS receipt_id
FROM v_events
""")
cte("v_checks", """
SELECT event_id AS check_id, event_type AS service_name, ts AS checked_at,
  CASE WHEN k < 2 THEN NULL WHEN event_type = 'error' THEN 503 WHEN k = 50 THEN 404 ELSE 200 END AS status_code,
  value * 10 AS latency_ms, k >= 2 AND event_type <> 'error' AND k <> 50 AS success
FROM v_events
""")
cte("v_service_incidents", """
SELECT event_id AS incident_id, event_type AS service_name, ts AS started_at,
  CASE WHEN event_id % 17 <> 0 THEN ts + INTERVAL 600 SECOND END AS resolved_at,
  CASE WHEN k < 2 THEN 'unavailable' ELSE 'slow' END AS failure_type
FROM v_events WHERE k < 5
""")
cte("v_drift", """
SELECT event_id AS drift_id, event_type AS service_name, ts AS recorded_at, '{"k": 42}' AS diff_json
FROM v_events WHERE k = 42
""")
cte("v_service_predictions", """
SELECT event_id AS prediction_id, event_type AS service_name, ts AS predicted_at,
  k / 100.0 AS failure_probability, 'legacy-1' AS model_version
FROM v_events WHERE k % 10 = 0
""")
cte("v_models", """
SELECT 'model-' || CAST(k % 3 + 1 AS VARCHAR) AS model_id, 'v' || CAST(k % 3 + 1 AS VARCHAR) AS version,
  round(0.6 + any_value(k % 3) / 10.0, 6) AS threshold, min(ts) AS created_at
FROM v_events GROUP BY k % 3
""")
cte("v_predictions", f"""
SELECT host_id || '@' || CAST(end_us // 1000000 AS VARCHAR) AS prediction_id, host_id, 'model-1' AS model_id,
  {ts('end_us')} AS window_end, {ts('end_us + (n * 7 % 60) * 1000000')} AS predicted_at,
  round(1.0 / (1.0 + exp(-(bad * 4.0 + latency * 1.5 - 2.0))), 6) AS probability,
  round(peak / 10.0 - 0.3, 6) + 0.0 AS anomaly_score, {H} AS horizon_seconds, end_us
FROM (
  SELECT host_id, end_us, avg(latency_seconds) AS latency,
    avg(CASE WHEN status_code = 200 THEN 0.0 ELSE 1.0 END) AS bad, max(latency_seconds) AS peak, count(*) AS n
  FROM (SELECT *, unnest(generate_series(((t + 3599999999) // 3600000000) * 3600000000,
          ((t + 3599999999) // 3600000000) * 3600000000 + 5 * 3600000000, 3600000000)) AS end_us FROM v_probes), v_now
  WHERE end_us <= now_us
  GROUP BY host_id, end_us)
""")

# ---- feature windows -------------------------------------------------------------------------
cte("v_windows", f"""
SELECT host_id, metric, ts, t, value,
  unnest(generate_series(((t + {TICK * 10**6 - 1}) // {TICK * 10**6}) * {TICK * 10**6},
    least((now_us // {TICK * 10**6}) * {TICK * 10**6},
          ((t + {W * 10**6} + {TICK * 10**6 - 1}) // {TICK * 10**6} - 1) * {TICK * 10**6}),
    {TICK * 10**6})) AS end_us
FROM v_samples, v_now
""")
cte("v_ordered", """
SELECT *, lag(t) OVER w AS pt, first_value(value) OVER w AS v0,
  first_value(t) OVER w AS t0, row_number() OVER w AS rn
FROM v_windows WINDOW w AS (PARTITION BY host_id, metric, end_us ORDER BY t)
""")
cte("v_last", "SELECT host_id, metric, end_us, max(t) AS tn FROM v_windows GROUP BY ALL")
cte("v_stats", f"""
SELECT host_id, metric, end_us, count(*) AS n, min(t) AS t0, max(t) AS tn,
  arg_max(value, t) AS latest, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std,
  min(value) AS "min", max(value) AS "max",
  CASE WHEN count(*) > 1 THEN arg_max(value, t) - arg_min(value, t) END AS delta,
  CASE WHEN count(*) > 1 THEN 100.0 * (arg_max(value, t) - arg_min(value, t)) / nullif(abs(arg_min(value, t)), 0) END AS percentage_change,
  CASE WHEN count(*) > 1 THEN regr_slope(value, (t - end_us) / 1000000.0) END AS linear_trend,
  sum(CASE WHEN rn = 1 THEN 1.0 ELSE 1.0 - pow(2.0, -(t - pt) / {HALF * 1e6}) END * value * pow(2.0, -(tn - t) / {HALF * 1e6})) AS ewma,
  var_pop(value) FILTER (WHERE t > end_us - {VARW * 10**6}) AS rolling_variance,
  CASE WHEN count(*) > 1 THEN (arg_max(value, t) - arg_min(value, t)) / nullif((max(t) - min(t)) / 1000000.0, 0) END AS rate_of_change
FROM v_ordered JOIN v_last USING (host_id, metric, end_us) GROUP BY host_id, metric, end_us
""")
cte("v_fresh", f"""
SELECT * FROM v_stats s WHERE end_us - tn <= {FRESH * 10**6}
  AND EXISTS (SELECT 1 FROM v_stats c WHERE c.host_id = s.host_id AND c.end_us = s.end_us
              AND c.metric = 'cpu_usage_percent' AND c.end_us - c.tn <= {FRESH * 10**6})
""")

_STATS = ("latest mean median std min max delta percentage_change linear_trend ewma rolling_variance rate_of_change").split()
_CROSS = {
    "cpu_trend_times_latency_trend": "cpu.linear_trend * lat.linear_trend",
    "memory_trend_times_latency_trend": "mem.linear_trend * lat.linear_trend",
    "error_trend_times_latency": "err.linear_trend * lat.latest",
    "disk_throughput_times_latency": "(dr.latest + dw.latest) * lat.latest",
    "network_change_times_error_rate": "(nr.rate_of_change + nt.rate_of_change) * err.latest",
}
cte("v_cross", "SELECT cpu.host_id, cpu.end_us, " + ", ".join(f"{e} AS {n}" for n, e in _CROSS.items()) + """
FROM (SELECT * FROM v_fresh WHERE metric = 'cpu_usage_percent') cpu
""" + "\n".join(
    f"LEFT JOIN v_fresh {a} ON {a}.host_id = cpu.host_id AND {a}.end_us = cpu.end_us AND {a}.metric = '{m}'"
    for a, m in {
        "mem": "memory_usage_percent", "lat": "latency_p95_seconds", "err": "error_rate",
        "dr": "disk_read_bytes_per_second", "dw": "disk_write_bytes_per_second",
        "nr": "network_receive_bytes_per_second", "nt": "network_transmit_bytes_per_second",
    }.items()))
cte("v_features", " UNION ALL ".join(
    f"SELECT host_id, end_us, metric || '.{s}' AS feature, \"{s}\" AS value FROM v_fresh" for s in _STATS
) + "".join(f" UNION ALL SELECT host_id, end_us, '{n}' AS feature, {n} AS value FROM v_cross" for n in _CROSS))
