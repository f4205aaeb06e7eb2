"""Queries over fleet views and history lists."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from augury.functions.clock import plus
from augury.functions.cut import checkpointed
from augury.functions.intervals import overlap_join
from augury.operators import console, features, rates
from augury.plans import common, oracle, oracle_events  # noqa: F401
from augury.plans import queries_incidents as qi
from augury.plans.catalog import query
from augury.plans.oracle import H, ts
from augury.plans.queries_data import hosts as host_rows
from augury.plans.queries_data import stored_windows
from augury.settings import SPARSE
from augury.sources import domain, tables

SINCE = datetime(2024, 1, 25, tzinfo=UTC)
SINCE_SQL = "TIMESTAMP '2024-01-25'"
THR = domain.MODEL_THRESHOLD
# Sparse hosts are probed about once an hour.
FRESH = SPARSE.but(freshness=7200)

oracle.cte("v_hosts", """
SELECT s.host_id, 'node-' || s.host_id AS name, any_value(m.service_job) AS service_job, max(s.ts) AS last_seen
FROM v_samples s LEFT JOIN v_map m USING (host_id) GROUP BY s.host_id
""")
oracle.cte("v_fleet", """
SELECT h.host_id, h.name, h.service_job, p.prediction_id, p.probability, m.threshold, o.outcome,
  (now_us - epoch_us(p.predicted_at)) / 1000000.0 AS prediction_age_seconds,
  coalesce((now_us - epoch_us(p.predicted_at)) / 1000000.0 BETWEEN 0 AND 7200, false) AS prediction_fresh,
  coalesce((now_us - epoch_us(p.predicted_at)) / 1000000.0 BETWEEN 0 AND 7200 AND p.probability >= m.threshold, false) AS high_risk,
  CASE WHEN EXISTS (SELECT 1 FROM v_raw_failures f WHERE f.host_id = h.host_id AND f.recovered_at IS NULL) THEN 'degraded'
    WHEN o.t IS NULL OR (now_us - o.t) / 1000000.0 NOT BETWEEN 0 AND 7200 THEN 'unknown'
    WHEN o.breached THEN 'degraded' ELSE 'healthy' END AS status
FROM v_hosts h CROSS JOIN v_now
LEFT JOIN (SELECT * FROM v_past QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY predicted_at DESC, prediction_id DESC) = 1) p ON p.host_id = h.host_id
LEFT JOIN (SELECT * FROM v_outcomes QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY t DESC, probe_id DESC) = 1) o ON o.host_id = h.host_id
LEFT JOIN v_models m ON m.model_id = p.model_id
""")


def fleet(spark, sf_dir):
    hosts = host_rows(domain.samples(spark, sf_dir), domain.service_map(spark, sf_dir))
    return console.fleet(
        hosts,
        qi.predictions(spark, sf_dir),
        common.outcomes(spark, sf_dir),
        common.events(spark, sf_dir),
        domain.models(spark, sf_dir),
        domain.as_of(spark, sf_dir),
        FRESH,
    )


_FLEET = ["host_id", "name", "service_job", "prediction_id", "probability", "threshold", "outcome", "status", "prediction_age_seconds", "prediction_fresh", "high_risk"]


@query("hosts_view", f"SELECT {', '.join(_FLEET)} FROM v_fleet ORDER BY host_id LIMIT 1000")
def hosts_view(spark, sf_dir):
    return console.hosts_view(fleet(spark, sf_dir), FRESH).select(*_FLEET)


@query("hosts_next_page", f"SELECT {', '.join(_FLEET)} FROM v_fleet WHERE host_id > 'h1' ORDER BY host_id LIMIT 3")
def hosts_next_page(spark, sf_dir):
    return console.hosts_view(fleet(spark, sf_dir), FRESH.but(host_limit=3), after="h1").select(*_FLEET)


@query("host_status", "SELECT host_id, status FROM v_fleet")
def host_status(spark, sf_dir):
    return fleet(spark, sf_dir).select("host_id", "status")


@query("host_counts", """
SELECT count(*) AS hosts, count(*) FILTER (WHERE status = 'healthy') AS healthy, count(*) FILTER (WHERE high_risk) AS high_risk FROM v_fleet
""")
def host_counts(spark, sf_dir):
    return console.host_counts(fleet(spark, sf_dir))


_COVERING = f"a.end_us <= f.onset_us AND f.onset_us <= a.end_us + {H * 10**6}"


@query("useful_lead", f"""
SELECT a.prediction_id, f.event_id, (f.onset_us - a.p_us) / 1000000.0 AS lead_seconds FROM v_seq a JOIN v_raw_failures f ON f.host_id = a.host_id AND {_COVERING}
WHERE (f.onset_us - a.p_us) / 1000000.0 >= {SPARSE.min_lead}
""")
def useful_lead(spark, sf_dir):
    scores = qi.predictions(spark, sf_dir).select(
        "host_id", "prediction_id", "predicted_at", "window_end", plus("window_end", SPARSE.horizon).alias("until")
    )
    onsets = common.events(spark, sf_dir).select("host_id", "event_id", F.col("observed_at").alias("onset"))
    pairs = overlap_join(scores, onsets, ["host_id"], ("window_end", "until"), ("onset", "onset"), bucket_seconds=SPARSE.horizon)
    lead = console.useful_lead(F.col("predicted_at"), "onset", SPARSE)
    return pairs.select("prediction_id", "event_id", lead.alias("lead_seconds")).filter("lead_seconds IS NOT NULL")


_LOOKBACK = 12 * 3600
oracle.cte("v_first_events", """
SELECT experiment_id, arg_min(event_id, (onset_us, event_id)) AS event_id, arg_min(host_id, (onset_us, event_id)) AS host_id, min(onset_us) AS onset_us
FROM v_failures WHERE experiment_id IS NOT NULL GROUP BY experiment_id
""")
oracle.cte("v_foresight", f"""
SELECT e.experiment_id, e.onset_us, a.prediction_id, a.p_us, a.end_us, a.probability >= m.threshold AS warns,
  CASE WHEN (e.onset_us - a.p_us) / 1000000.0 >= {SPARSE.min_lead} AND e.onset_us <= a.end_us + {H * 10**6} THEN (e.onset_us - a.p_us) / 1000000.0 END AS lead
FROM v_first_events e JOIN v_seq a ON a.host_id = e.host_id AND a.p_us <= e.onset_us - {SPARSE.min_lead * 10**6}
  AND a.end_us BETWEEN e.onset_us - {_LOOKBACK * 10**6} AND e.onset_us JOIN v_models m USING (model_id)
""")
oracle.cte("v_foreseen", f"""
SELECT f.experiment_id, count(DISTINCT CASE WHEN lead IS NOT NULL THEN f.prediction_id END) AS eligible_scores, max(lead) FILTER (WHERE warns) AS warning_lead,
  max((f.onset_us - epoch_us(d.delivered_at)) / 1000000.0) FILTER (WHERE warns AND lead IS NOT NULL AND epoch_us(d.delivered_at) >= f.p_us
    AND (f.onset_us - epoch_us(d.delivered_at)) / 1000000.0 >= {SPARSE.min_lead}) AS alert_lead
FROM v_foresight f LEFT JOIN v_alerts d ON d.prediction_id = f.prediction_id AND d.status = 'delivered' GROUP BY f.experiment_id
""")


@query("experiment_view", """
SELECT x.experiment_id, x.host_id, e.event_id, coalesce(f.eligible_scores, 0) AS eligible_scores, f.warning_lead AS warning_lead_seconds, f.alert_lead AS alert_lead_seconds,
  CASE WHEN e.event_id IS NULL THEN 'No observed failure' WHEN f.alert_lead IS NOT NULL THEN 'Alert delivered' WHEN f.warning_lead IS NOT NULL THEN 'Warning recorded'
    WHEN coalesce(f.eligible_scores, 0) > 0 THEN 'No advance warning' ELSE 'No eligible scores' END AS coverage
FROM v_experiments x LEFT JOIN v_first_events e USING (experiment_id) LEFT JOIN v_foreseen f USING (experiment_id)
""")
def experiment_view(spark, sf_dir):
    events = checkpointed(common.attributed_events(spark, sf_dir))
    view = console.experiment_view(
        domain.experiments(spark, sf_dir),
        events,
        qi.predictions(spark, sf_dir),
        qi.alerts(spark, sf_dir),
        domain.models(spark, sf_dir),
        SPARSE,
        _LOOKBACK,
    )
    return view.select(
        "experiment_id", "host_id", "event_id", "eligible_scores", "warning_lead_seconds", "alert_lead_seconds", "coverage"
    )


@query("incident_view", """
SELECT s.incident_id, s.status, s.event_id AS failure_event_id, p.anomaly_score, a.alerts, coalesce(q.proposals, '') AS proposals
FROM v_statuses s JOIN v_past p USING (prediction_id)
JOIN (SELECT incident_id, string_agg(channel || '=' || status, ',' ORDER BY created_at DESC, alert_id DESC) AS alerts FROM v_alerts GROUP BY incident_id) a USING (incident_id)
LEFT JOIN (SELECT incident_id, string_agg(proposal_id, ',') AS proposals FROM v_proposals GROUP BY incident_id) q USING (incident_id)
""")
def incident_view(spark, sf_dir):
    state = checkpointed(qi.statuses(spark, sf_dir))
    view = console.incident_view(state, qi.alerts(spark, sf_dir, state), qi.proposals(spark, sf_dir, state), 100)
    score = qi.predictions(spark, sf_dir).select("prediction_id", "anomaly_score")
    return view.join(score, "prediction_id", "left").select(
        "incident_id",
        "status",
        "failure_event_id",
        "anomaly_score",
        F.array_join(F.transform("alerts", lambda a: F.concat(a["channel"], F.lit("="), a["status"])), ",").alias("alerts"),
        F.coalesce(F.array_join(F.transform("proposals", lambda q: q["proposal_id"]), ","), F.lit("")).alias("proposals"),
    )


@query("snapshot_totals", """
SELECT 'predictions' AS name, count(*) AS "rows" FROM v_past UNION ALL SELECT 'incidents', count(*) FROM v_statuses
UNION ALL SELECT 'open_incidents', count(*) FROM v_statuses WHERE resolved_at IS NULL
UNION ALL SELECT 'alerts', count(*) FROM v_alerts
UNION ALL SELECT 'alerts_last_day', count(*) FROM v_alerts, v_now WHERE created_at >= now_ts - INTERVAL 1 DAY
UNION ALL SELECT 'failure_events', count(*) FROM v_raw_failures UNION ALL SELECT 'experiments', count(*) FROM v_experiments
UNION ALL SELECT 'hosts', count(*) FROM v_hosts UNION ALL SELECT 'models', count(*) FROM v_models
""")
def snapshot_totals(spark, sf_dir):
    now = domain.as_of(spark, sf_dir)
    state = checkpointed(qi.statuses(spark, sf_dir))
    queue = qi.alerts(spark, sf_dir, state)
    day = F.timestamp_micros(F.unix_micros(now) - 86_400_000_000)
    return console.snapshot_totals(
        {
            "predictions": qi.predictions(spark, sf_dir),
            "incidents": state,
            "open_incidents": state.filter("resolved_at IS NULL"),
            "alerts": queue,
            "alerts_last_day": queue.filter(F.col("created_at") >= day),
            "failure_events": common.events(spark, sf_dir),
            "experiments": domain.experiments(spark, sf_dir),
            "hosts": domain.samples(spark, sf_dir).select("host_id").distinct(),
            "models": domain.models(spark, sf_dir),
        }
    )


_PANEL = ("cpu_usage_percent", "memory_usage_percent", "network_receive_bytes_per_second")
_RANGE, _STEP, _HOLD = 7 * 86400, 3600, SPARSE.freshness


@query("telemetry_view", f"""
SELECT host_id, metric, {ts('g')} AS grid_at, arg_max(value, t) AS value
FROM v_samples s JOIN (SELECT unnest(generate_series(now_us - {_RANGE * 10**6}, now_us, {_STEP * 10**6})) AS g FROM v_now) ON t <= g AND t > g - {_HOLD * 10**6}
WHERE metric IN {_PANEL} GROUP BY host_id, metric, g
""")
def telemetry_view(spark, sf_dir):
    chosen = domain.samples(spark, sf_dir).filter(F.col("metric").isin(*_PANEL))
    grid = rates.grid_last(chosen, domain.as_of(spark, sf_dir), lookback=_RANGE, step=_STEP, hold=_HOLD)
    return grid.withColumnRenamed("at", "grid_at")


@query("telemetry_status", """
SELECT host_id, (now_us - max(t)) / 1000000.0 AS sample_age_seconds,
  CASE WHEN (now_us - max(t)) / 1000000.0 BETWEEN 0 AND 7200 THEN 'available' ELSE 'stale' END AS status FROM v_samples, v_now GROUP BY host_id, now_us
""")
def telemetry_status(spark, sf_dir):
    return console.telemetry_status(domain.samples(spark, sf_dir), domain.as_of(spark, sf_dir), FRESH)


@query("host_detail", """
SELECT 'prediction' AS kind, prediction_id AS id, predicted_at AS at_time FROM (SELECT * FROM v_past WHERE host_id = 'h0' ORDER BY predicted_at DESC, prediction_id DESC LIMIT 100)
UNION ALL SELECT 'incident', incident_id, predicted_at FROM (SELECT * FROM v_incidents WHERE host_id = 'h0' ORDER BY predicted_at DESC, incident_id DESC LIMIT 100)
""")
def host_detail(spark, sf_dir):
    scores = tables.recent(qi.predictions(spark, sf_dir), "predicted_at", "prediction_id", 100, host_id="h0")
    opened = tables.recent(qi.incidents(spark, sf_dir), "predicted_at", "incident_id", 100, host_id="h0")
    return scores.select(
        F.lit("prediction").alias("kind"), F.col("prediction_id").alias("id"), F.col("predicted_at").alias("at_time")
    ).unionByName(
        opened.select(F.lit("incident").alias("kind"), F.col("incident_id").alias("id"), F.col("predicted_at").alias("at_time"))
    )


@query("inference_status", """
SELECT CASE WHEN (now_us - epoch_us(predicted_at)) / 1000000.0 BETWEEN 0 AND 7200 THEN 'recent_scores_available' ELSE 'stale' END AS status,
  prediction_id, host_id, probability, (now_us - epoch_us(predicted_at)) / 1000000.0 AS age_seconds
FROM v_past, v_now ORDER BY predicted_at DESC, prediction_id DESC LIMIT 1
""")
def inference_status(spark, sf_dir):
    return console.inference_status(qi.predictions(spark, sf_dir), domain.as_of(spark, sf_dir), FRESH)


@query("chart_segments", """
SELECT host_id, event_id, CAST(sum(CASE WHEN gap IS NULL OR gap > 2.5 * coalesce(med, 60.0) THEN 1 ELSE 0 END) OVER (PARTITION BY host_id ORDER BY t, event_id) AS BIGINT) AS segment
FROM (SELECT host_id, event_id, t, (t - lag(t) OVER (PARTITION BY host_id ORDER BY t, event_id)) / 1000000.0 AS gap FROM v_samples WHERE metric = 'cpu_usage_percent')
LEFT JOIN (SELECT host_id, list_sort(list(gap))[count(*) // 2 + 1] AS med FROM (
  SELECT host_id, (t - lag(t) OVER (PARTITION BY host_id ORDER BY t, event_id)) / 1000000.0 AS gap FROM v_samples WHERE metric = 'cpu_usage_percent')
  WHERE gap > 0 GROUP BY host_id) USING (host_id)
""")
def chart_segments(spark, sf_dir):
    points = domain.samples(spark, sf_dir).filter("metric = 'cpu_usage_percent'").select("host_id", "ts", "event_id")
    return console.chart_segments(points, ["host_id"], "ts", "event_id", SPARSE).select("host_id", "event_id", "segment")


@query("text_filter", """
SELECT host_id, name, status FROM v_fleet WHERE contains(lower(concat_ws(' ', host_id, name, service_job)), lower('JOB-h')) AND status = 'degraded'
""")
def text_filter(spark, sf_dir):
    found = console.text_filter(fleet(spark, sf_dir), "JOB-h", ["host_id", "name", "service_job"], status="degraded")
    return found.select("host_id", "name", "status")


@query("score_sparkline", """
SELECT host_id, prediction_id, predicted_at, probability FROM v_past QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY predicted_at DESC, prediction_id DESC) <= 40
""")
def score_sparkline(spark, sf_dir):
    return console.score_sparkline(qi.predictions(spark, sf_dir), 40).drop("newest_rank")


@query("duplicate_groups", "SELECT host_id, metric, ts, count(*) AS copies FROM v_dirty GROUP BY host_id, metric, ts HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return console.duplicate_groups(domain.dirty_samples(spark, sf_dir), ["host_id", "metric", "ts"])


@query("collection_progress", """
SELECT 'samples' AS name, count(*) AS "rows", max(ts) AS newest FROM v_samples UNION ALL SELECT 'probes', count(*), max(observed_at) FROM v_probes
UNION ALL SELECT 'failures', count(*), max(confirmed_at) FROM v_raw_failures
""")
def collection_progress(spark, sf_dir):
    return console.collection_progress(
        {
            "samples": (domain.samples(spark, sf_dir), "ts"),
            "probes": (domain.probes(spark, sf_dir), "observed_at"),
            "failures": (common.events(spark, sf_dir), "confirmed_at"),
        }
    )


@query("window_audit", f"""
SELECT host_id, CAST(count(*) AS BIGINT) AS windows, {ts('max(end_us)')} AS latest_end,
  max(CASE WHEN rn = 1 AND now_us - end_us >= 172800000000 THEN 1 ELSE 0 END) AS stale,
  max(CASE WHEN rn = 1 AND hour({ts('end_us')}) = 5 THEN 1 ELSE 0 END) AS contract,
  max(CASE WHEN rn = 1 AND (latest NOT BETWEEN 0 AND 100 OR hour({ts('end_us')}) = 7) THEN 1 ELSE 0 END) AS cpu_bounds, 0 AS quality_outside
FROM (SELECT k.host_id, k.end_us, s.latest, now_us, row_number() OVER (PARTITION BY k.host_id ORDER BY k.end_us DESC) AS rn
  FROM v_keys k CROSS JOIN v_now JOIN v_stats s ON s.host_id = k.host_id AND s.end_us = k.end_us AND s.metric = 'cpu_usage_percent')
WHERE rn <= 3 GROUP BY host_id
""")
def window_audit(spark, sf_dir):
    return console.window_audit(
        stored_windows(spark, sf_dir), features.Contract.of(SPARSE), domain.as_of(spark, sf_dir), 172800, 100.0
    )


@query("ledger_lists", """
SELECT 'experiment' AS kind, experiment_id AS id, started_at AS at_time FROM (SELECT * FROM v_experiments ORDER BY started_at DESC, experiment_id DESC LIMIT 100)
UNION ALL SELECT 'failure', event_id, observed_at FROM (SELECT * FROM v_raw_failures ORDER BY observed_at DESC, event_id DESC LIMIT 100)
""")
def ledger_lists(spark, sf_dir):
    lists = [
        ("experiment", tables.recent(domain.experiments(spark, sf_dir), "started_at", "experiment_id"), "experiment_id", "started_at"),
        ("failure", tables.recent(common.events(spark, sf_dir), "observed_at", "event_id"), "event_id", "observed_at"),
    ]
    out = [f.select(F.lit(k).alias("kind"), F.col(i).alias("id"), F.col(a).alias("at_time")) for k, f, i, a in lists]
    return out[0].unionByName(out[1])


@query("health_history", """
SELECT check_id, service_name, checked_at, success FROM v_checks QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY checked_at DESC, check_id DESC) <= 100
""")
def health_history(spark, sf_dir):
    return console.history(
        domain.health_checks(spark, sf_dir), ["service_name"], "checked_at", "check_id", last=100
    ).select("check_id", "service_name", "checked_at", "success")


@query("health_since", f"SELECT check_id, service_name, checked_at FROM v_checks WHERE checked_at >= {SINCE_SQL}")
def health_since(spark, sf_dir):
    return console.history(
        domain.health_checks(spark, sf_dir), ["service_name"], "checked_at", "check_id", since=F.lit(SINCE)
    ).select("check_id", "service_name", "checked_at")


@query("open_incident", """
SELECT service_name, incident_id, started_at, failure_type FROM v_service_incidents WHERE resolved_at IS NULL
QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY started_at DESC, incident_id DESC) = 1
""")
def open_incident(spark, sf_dir):
    return console.open_incident(domain.service_incidents(spark, sf_dir)).select(
        "service_name", "incident_id", "started_at", "failure_type"
    )


@query("incidents_since", f"""
SELECT incident_id, service_name, started_at FROM v_service_incidents WHERE service_name = 'click' AND started_at >= {SINCE_SQL}
ORDER BY started_at DESC, incident_id DESC LIMIT 100
""")
def incidents_since(spark, sf_dir):
    return console.incidents_since(domain.service_incidents(spark, sf_dir), F.lit(SINCE), "click").select(
        "incident_id", "service_name", "started_at"
    )


@query("drift_history", f"SELECT drift_id, service_name, recorded_at, diff_json FROM v_drift WHERE recorded_at >= {SINCE_SQL}")
def drift_history(spark, sf_dir):
    return console.history(
        domain.drift_records(spark, sf_dir), ["service_name"], "recorded_at", "drift_id", since=F.lit(SINCE)
    )


@query("prediction_history", f"""
SELECT 'latest' AS kind, prediction_id, service_name, failure_probability FROM (SELECT * FROM v_service_predictions
  QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY predicted_at DESC, prediction_id DESC) = 1)
UNION ALL SELECT 'since', prediction_id, service_name, failure_probability FROM v_service_predictions WHERE predicted_at >= {SINCE_SQL}
""")
def prediction_history(spark, sf_dir):
    rows = domain.service_predictions(spark, sf_dir)
    latest = console.history(rows, ["service_name"], "predicted_at", "prediction_id", last=1)
    since = console.history(rows, ["service_name"], "predicted_at", "prediction_id", since=F.lit(SINCE))
    columns = ["prediction_id", "service_name", "failure_probability"]
    return latest.select(F.lit("latest").alias("kind"), *columns).unionByName(
        since.select(F.lit("since").alias("kind"), *columns)
    )
