"""SQL relations for failure events and labels."""

from augury.plans.oracle import EXCL, FRESH, GAP, H, SPAN, W, cte

cte("v_triples", """
SELECT *, lag(t, 2) OVER w AS first_t, lag(observed_at, 2) OVER w AS first_at,
  lag(probe_id, 2) OVER w AS first_probe_id, lag(outcome, 2) OVER w AS first_outcome,
  lag(breached, 1) OVER w AS b1, lag(breached, 2) OVER w AS b2
FROM v_outcomes WINDOW w AS (PARTITION BY host_id ORDER BY observed_at, probe_id)
""")
cte("v_confirmed", f"""
SELECT * FROM v_triples WHERE b1 = breached AND b2 = breached AND t - first_t <= {SPAN * 10**6}
""")
cte("v_turns", """
SELECT * FROM (SELECT *, lag(breached) OVER (PARTITION BY host_id ORDER BY observed_at, probe_id) AS before FROM v_confirmed)
WHERE before IS NULL OR before <> breached
""")
cte("v_raw_failures", """
SELECT * FROM (
SELECT 'f' || CAST(first_probe_id AS VARCHAR) AS event_id, host_id, first_outcome AS failure_type, first_probe_id,
  first_at AS observed_at, first_t AS onset_us, observed_at AS confirmed_at, t AS confirmed_us, breached,
  lead(first_at) OVER w AS recovered_at, lead(first_t) OVER w AS recovered_us, lead(observed_at) OVER w AS recovery_confirmed_at
FROM v_turns WINDOW w AS (PARTITION BY host_id ORDER BY observed_at, probe_id)) WHERE breached
""")
cte("v_tagged", """
SELECT p.host_id, p.probe_id, p.observed_at, arg_min(x.experiment_id, (x.started_at, x.experiment_id)) AS experiment_id
FROM v_probes p CROSS JOIN v_now
LEFT JOIN v_experiments x ON x.host_id = p.host_id AND x.started_at <= p.observed_at
  AND p.observed_at <= coalesce(x.ended_at, now_ts)
GROUP BY ALL
""")
cte("v_failures", """
SELECT f.*, g.experiment_id FROM v_raw_failures f JOIN v_tagged g ON g.host_id = f.host_id AND g.probe_id = f.first_probe_id
""")
cte("v_keys", f"""
SELECT host_id, end_us, end_us - {W * 10**6} AS start_us FROM v_stats
WHERE metric = 'cpu_usage_percent' AND end_us - tn <= {FRESH * 10**6}
""")
cte("v_judged", """
SELECT host_id, probe_id, t, coalesce(status_code = 200 AND latency_seconds <= 2.0, false) AS healthy, slo_seconds = 2.0 AS known
FROM v_probes
""")


def label_relations(name: str, keys: str, end: str, horizon: int, exclusion: int, count: int) -> None:
    """Relation ``name``: labels of the given keys, each condition as its own lookup."""
    tail = SPAN if count > 1 else 0
    h, cover = horizon * 10**6, (horizon + tail) * 10**6
    run = " AND ".join(
        ["NOT healthy"] + [f"NOT coalesce(lag(healthy, {j}) OVER w, true)" for j in range(1, count)]
    )
    cte(f"{name}_runs", f"""
SELECT host_id, t, CASE WHEN {run} AND t - coalesce(lag(t, {count - 1}) OVER w, t) <= {SPAN * 10**6}
  THEN lag(t, {count - 1}) OVER w END AS first_t,
  t - lag(t) OVER w AS gap, known
FROM v_judged WINDOW w AS (PARTITION BY host_id ORDER BY t, probe_id)
""")
    cte(f"{name}_ends", f"SELECT DISTINCT host_id, {end} AS e FROM {keys}")
    cte(f"{name}_ev", f"""
SELECT w.host_id, w.e, bool_or(f.onset_us <= w.e) AS active,
  arg_min(f.event_id, (f.onset_us, f.event_id)) FILTER (WHERE f.onset_us > w.e) AS event_id
FROM {name}_ends w CROSS JOIN v_now JOIN v_failures f ON f.host_id = w.host_id AND f.onset_us <= f.confirmed_us AND f.confirmed_us <= now_us
 AND ((f.onset_us <= w.e AND (f.recovered_us IS NULL OR w.e <= f.recovered_us + {exclusion * 10**6}))
      OR (f.onset_us > w.e AND f.onset_us <= w.e + {h}))
GROUP BY w.host_id, w.e
""")
    cte(f"{name}_br", f"""
SELECT w.host_id, w.e, max(p.t) FILTER (WHERE p.t <= w.e) AS l, min(p.t) FILTER (WHERE p.t >= w.e + {cover}) AS r
FROM {name}_ends w JOIN v_judged p ON p.host_id = w.host_id GROUP BY w.host_id, w.e
""")
    cte(f"{name}_ob", f"""
SELECT b.host_id, b.e, any_value(b.l) AS l, any_value(b.r) AS r,
  bool_or(p.t > b.l AND p.gap > {GAP * 10**6}) AS has_gap, bool_or(NOT p.known) AS foreign_criteria,
  bool_or(coalesce(p.first_t >= b.l AND p.first_t <= b.e + {h}, false)) AS degraded
FROM {name}_br b JOIN {name}_runs p ON p.host_id = b.host_id AND p.t BETWEEN b.l AND b.r GROUP BY b.host_id, b.e
""")
    negative = "observed_healthy_horizon" if count == 1 else "observed_no_sustained_failure_horizon"
    cte(name, f"""
SELECT k.*, CASE reason WHEN 'confirmed_future_failure' THEN 1.0::DOUBLE WHEN '{negative}' THEN 0.0::DOUBLE END AS label,
  CASE WHEN reason = 'confirmed_future_failure' THEN matched END AS failure_event_id
FROM (
SELECT k.*, v.event_id AS matched, CASE
  WHEN v.active THEN 'active_failure_or_recovery'
  WHEN v.event_id IS NOT NULL THEN 'confirmed_future_failure'
  WHEN {end} + {h} > now_us THEN 'right_censored'
  WHEN {end} + {cover} > now_us THEN 'right_censored_confirmation'
  WHEN o.l IS NULL OR o.r IS NULL OR {end} - o.l > {GAP * 10**6} OR o.r - {end} - {cover} > {GAP * 10**6} THEN 'incomplete_observation_coverage'
  WHEN o.has_gap THEN 'observation_gap'
  WHEN o.foreign_criteria THEN 'unknown_or_changed_criteria'
  WHEN o.degraded THEN 'unconfirmed_degradation'
  ELSE '{negative}' END AS reason
FROM {keys} k CROSS JOIN v_now
LEFT JOIN {name}_ev v ON v.host_id = k.host_id AND v.e = {end}
LEFT JOIN {name}_ob o ON o.host_id = k.host_id AND o.e = {end}) k
""")


cte("v_coverage", """
SELECT k.host_id, k.end_us, (s.tn - s.t0) / 1000000.0 AS coverage FROM v_keys k
JOIN v_stats s ON s.host_id = k.host_id AND s.end_us = k.end_us AND s.metric = 'cpu_usage_percent'
""")
label_relations("v_labels", "v_keys", "end_us", H, EXCL, 3)
cte("v_short", "SELECT host_id, end_us, end_us - 14400000000 AS start_us FROM v_keys")
label_relations("v_inputs", "v_short", "start_us", 14400, 0, 1)
# Windows a dataset takes: those whose CPU samples span four fifths of the window, labelled or not.
cte("v_dataset", f"SELECT l.* FROM v_labels l JOIN v_coverage c USING (host_id, end_us) WHERE c.coverage >= 0.8 * {W}")
cte("v_healthy_part", """
SELECT l.* FROM v_dataset l JOIN v_inputs i ON i.host_id = l.host_id AND i.end_us = l.end_us WHERE i.label = 0 AND coalesce(l.label, 0) <> 1
""")
label_relations("v_single", "v_keys", "end_us", H, EXCL, 1)
