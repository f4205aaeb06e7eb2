"""Queries over scores, incidents, alerts and proposals."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from augury.functions.clock import micros
from augury.functions.cut import checkpointed
from augury.operators import clean, features
from augury.operators import incidents as inc
from augury.plans import common, oracle, oracle_events  # noqa: F401
from augury.plans.catalog import query
from augury.plans.oracle import H, ts
from augury.plans.queries_data import CUT, stored_windows
from augury.settings import SPARSE
from augury.sources import domain, event_log, tables
from augury.sources.event_log import EventLog

THR = domain.MODEL_THRESHOLD
GRACE, CLEAR_SPAN = SPARSE.expiry_grace, SPARSE.clear_span

# ---- shared relations ----------------------------------------------------------------------------


def predictions(spark, sf_dir, now=None):
    """Scores made up to the cutoff."""
    cutoff = domain.as_of(spark, sf_dir) if now is None else now
    return domain.predictions(spark, sf_dir).filter(F.col("predicted_at") <= cutoff)


def known_failures(spark, sf_dir, now=None):
    cutoff = domain.as_of(spark, sf_dir) if now is None else now
    return inc.visible_events(common.events(spark, sf_dir), cutoff)


def incidents(spark, sf_dir, now=None):
    known = checkpointed(known_failures(spark, sf_dir, now))
    return inc.open_incidents(predictions(spark, sf_dir, now), THR, SPARSE, known)


def statuses(spark, sf_dir, now=None):
    cutoff = domain.as_of(spark, sf_dir) if now is None else now
    opened = checkpointed(incidents(spark, sf_dir, now))
    return inc.incident_status(opened, inc.matches_of(opened), cutoff)


def attempts(alerts):
    """Delivery attempts: three per alert, a minute apart."""
    n = (micros("created_at") / 60_000_000).cast("bigint") + F.when(F.col("channel") == "slack", 2).otherwise(0)
    codes = F.array(*[F.lit(c) for c in (200, 503, 429, 400, None)])
    tried = alerts.withColumn("j", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    # Some alerts still wait for their first attempt.
    return tried.filter(F.pmod(n, F.lit(7)) != 0).select(
        "alert_id",
        F.timestamp_micros(micros("next_attempt_at") + F.col("j") * 60_000_000).alias("attempted_at"),
        F.element_at(codes, (F.pmod(n * F.col("j"), F.lit(5)) + 1).cast("int")).alias("status_code"),
    )


def alerts(spark, sf_dir, opened=None):
    base = checkpointed(inc.enqueue_alerts(opened if opened is not None else incidents(spark, sf_dir), SPARSE))
    return inc.delivery_outcomes(base, attempts(base))


oracle.cte("v_past", "SELECT p.* FROM v_predictions p, v_now WHERE p.predicted_at <= now_ts")
oracle.cte("v_seq", f"""
SELECT *, epoch_us(predicted_at) AS p_us, lag(probability) OVER w AS before,
  probability < {THR} AND coalesce(lag(probability, 1) OVER w < {THR}, false) AND coalesce(lag(probability, 2) OVER w < {THR}, false)
    AND end_us - lag(end_us, 2) OVER w <= {CLEAR_SPAN * 10**6} AS clears
FROM v_past WINDOW w AS (PARTITION BY host_id, model_id ORDER BY end_us)
""")
oracle.cte("v_candidates", f"""
SELECT *, CASE WHEN clear_us <= expiry_us THEN clear_us ELSE expiry_us END AS closed_us,
  CASE WHEN clear_us <= expiry_us THEN 'risk_cleared' ELSE 'forecast_expired_unconfirmed' END AS closed_as FROM (
SELECT s.*, s.end_us + {(H + GRACE) * 10**6} AS expiry_us,
  (SELECT min(c.p_us) FROM v_seq c WHERE c.host_id = s.host_id AND c.clears AND c.end_us > s.end_us) AS clear_us
FROM v_seq s WHERE probability >= {THR} AND p_us - end_us <= {SPARSE.max_age * 10**6}
QUALIFY row_number() OVER (PARTITION BY host_id, p_us ORDER BY end_us, prediction_id) = 1)
""")
oracle.cte("v_visible", """
SELECT f.* REPLACE (CASE WHEN recovery_confirmed_at <= now_ts THEN recovered_at END AS recovered_at) FROM v_raw_failures f, v_now WHERE confirmed_at <= now_ts
""")
# Rule: an unresolved incident is matched with the first confirmed failure that one of its high scores foresaw or
# that was active as it opened; it is then resolved by recovery alone.  What is closed is matched no more.
oracle.cte("v_would_match", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY onset_us, event_id, way, matched_us, matched_id) AS rn FROM (
  SELECT c.prediction_id, f.event_id, f.onset_us, f.recovered_at, s.prediction_id AS matched_id, s.p_us AS matched_us, 0 AS way
  FROM v_candidates c JOIN v_seq s ON s.host_id = c.host_id AND s.p_us BETWEEN c.p_us AND c.closed_us AND s.probability >= {THR}
  JOIN v_visible f ON f.host_id = c.host_id AND s.end_us < f.onset_us AND f.onset_us <= s.end_us + {H * 10**6}
  WHERE f.onset_us >= c.p_us - {H * 10**6} AND epoch_us(f.confirmed_at) <= c.closed_us
  UNION ALL
  SELECT c.prediction_id, f.event_id, f.onset_us, f.recovered_at, c.prediction_id, c.p_us, 1
  FROM v_candidates c JOIN v_visible f ON f.host_id = c.host_id AND f.onset_us BETWEEN c.p_us - {H * 10**6} AND c.p_us
  WHERE (f.recovered_at IS NULL OR epoch_us(f.recovered_at) >= c.p_us) AND epoch_us(f.confirmed_at) <= c.closed_us)) WHERE rn = 1
""")
oracle.cte("v_settled", """
SELECT c.*, m.event_id IS NOT NULL AS has_failure,
  CASE WHEN m.event_id IS NULL THEN c.closed_us WHEN m.recovered_at IS NOT NULL THEN greatest(epoch_us(m.recovered_at), c.p_us) END AS until_us
FROM v_candidates c LEFT JOIN v_would_match m USING (prediction_id)
""")
oracle.cte("v_opened", """(host_id, p_us) AS
SELECT host_id, min(p_us) FROM v_settled GROUP BY host_id
UNION ALL
SELECT o.host_id, (SELECT min(n.p_us) FROM v_settled n WHERE n.host_id = o.host_id AND n.p_us > c.until_us)
FROM v_opened o JOIN v_settled c ON c.host_id = o.host_id AND c.p_us = o.p_us
WHERE EXISTS (SELECT 1 FROM v_settled n WHERE n.host_id = o.host_id AND n.p_us > c.until_us)
""")
oracle.cte("v_incidents", f"""
SELECT 'i-' || c.prediction_id AS incident_id, c.host_id, c.model_id, c.prediction_id, c.window_end, c.end_us, c.predicted_at, c.p_us,
  c.probability, c.end_us + {H * 10**6} AS valid_us, c.closed_us, c.closed_as, c.until_us
FROM v_opened o JOIN v_settled c ON c.host_id = o.host_id AND c.p_us = o.p_us
""")
# Without failures, as the stream of scores sees it.
oracle.cte("v_opened_alone", """(host_id, p_us) AS
SELECT host_id, min(p_us) FROM v_candidates GROUP BY host_id
UNION ALL
SELECT o.host_id, (SELECT min(n.p_us) FROM v_candidates n WHERE n.host_id = o.host_id AND n.p_us > c.closed_us)
FROM v_opened_alone o JOIN v_candidates c ON c.host_id = o.host_id AND c.p_us = o.p_us
WHERE EXISTS (SELECT 1 FROM v_candidates n WHERE n.host_id = o.host_id AND n.p_us > c.closed_us)
""")
oracle.cte("v_attached", """
SELECT s.*, i.incident_id, i.p_us AS opened_us FROM v_seq s CROSS JOIN v_now LEFT JOIN v_incidents i
ON i.host_id = s.host_id AND s.p_us BETWEEN i.p_us AND coalesce(i.until_us, now_us)
""")
oracle.cte("v_matched", """
SELECT i.incident_id, m.event_id, m.onset_us, m.recovered_at, m.matched_id,
  CASE WHEN m.matched_us < m.onset_us THEN (m.onset_us - m.matched_us) / 1000000.0 END AS lead
FROM v_incidents i JOIN v_would_match m USING (prediction_id)
""")
oracle.cte("v_statuses", f"""
SELECT i.*, m.event_id, m.onset_us, CASE WHEN m.recovered_at IS NOT NULL THEN 'recovered' WHEN m.event_id IS NOT NULL THEN 'observed'
    WHEN i.closed_us < now_us THEN i.closed_as ELSE 'open' END AS status,
  CASE WHEN m.event_id IS NOT NULL THEN m.recovered_at WHEN i.closed_us < now_us THEN {ts('i.closed_us')} END AS resolved_at
FROM v_incidents i CROSS JOIN v_now LEFT JOIN v_matched m USING (incident_id)
""")
oracle.cte("v_queued", f"""
SELECT incident_id || '/' || channel AS alert_id, incident_id, host_id, prediction_id, channel, predicted_at AS created_at, end_us, valid_us,
  {ts(f'greatest(p_us, coalesce(before_us + {SPARSE.alert_cooldown * 10**6}, p_us))')} AS next_attempt_at
FROM (SELECT *, lag(p_us) OVER (PARTITION BY host_id ORDER BY p_us) AS before_us FROM v_incidents), (SELECT unnest(['generic', 'slack']) AS channel)
""")
oracle.cte("v_attempts", """
SELECT alert_id, j AS n, next_attempt_at + to_seconds(j * 60) AS attempted_at,
  [200, 503, 429, 400, NULL][((epoch_us(created_at) // 60000000 + CASE WHEN channel = 'slack' THEN 2 ELSE 0 END) * j) % 5 + 1] AS code
FROM v_queued, (SELECT unnest([1, 2, 3]) AS j)
WHERE (epoch_us(created_at) // 60000000 + CASE WHEN channel = 'slack' THEN 2 ELSE 0 END) % 7 <> 0
""")
# The first attempt that is not a retry, or the third, ends an alert.
oracle.cte("v_ended", """
SELECT alert_id, min(CASE WHEN n = 3 OR code IS NULL OR NOT (code = 429 OR code >= 500) THEN n END) AS last_n FROM v_attempts GROUP BY alert_id
""")
oracle.cte("v_alerts", """
SELECT q.alert_id, q.incident_id, q.host_id, q.prediction_id, q.channel, q.created_at, q.end_us, q.valid_us,
  CASE WHEN e.last_n IS NULL THEN 'pending' WHEN a.code IS NULL THEN 'unknown' WHEN a.code BETWEEN 200 AND 299 THEN 'delivered' ELSE 'failed' END AS status,
  CAST(coalesce(e.last_n, 0) AS INTEGER) AS attempt_count, CASE WHEN e.last_n IS NULL THEN q.next_attempt_at END AS next_attempt_at,
  CASE WHEN a.code BETWEEN 200 AND 299 THEN a.attempted_at END AS delivered_at
FROM v_queued q LEFT JOIN v_ended e USING (alert_id) LEFT JOIN v_attempts a ON a.alert_id = q.alert_id AND a.n = e.last_n
""")


# ---- scoring -------------------------------------------------------------------------------------


@query("latest_window_per_host", f"""
SELECT host_id, {ts('end_us')} AS window_end, coverage BETWEEN 0.8 * 86400 AND 86400 AND hour({ts('end_us')}) <> 5 AS eligible FROM v_coverage c, v_now
WHERE now_us - end_us BETWEEN 0 AND 172800000000 AND end_us = (SELECT max(end_us) FROM v_coverage d WHERE d.host_id = c.host_id)
""")
def latest_window_per_host(spark, sf_dir):
    now = domain.as_of(spark, sf_dir)
    newest = inc.latest_window_per_host(stored_windows(spark, sf_dir), now, 172800)
    ok = clean.score_eligible(features.Contract.of(SPARSE), now, 172800)
    return newest.select("host_id", "window_end", ok.alias("eligible"))


@query("unscored", f"""
SELECT host_id, {ts('k.end_us')} AS window_end FROM v_keys k WHERE NOT EXISTS (
  SELECT 1 FROM v_past p WHERE p.host_id = k.host_id AND p.end_us = k.end_us AND hour(p.window_end) < 12)
""")
def unscored(spark, sf_dir):
    done = predictions(spark, sf_dir).filter(F.hour("window_end") < 12)
    return inc.unscored(common.keys(spark, sf_dir), done, domain.MODEL_ID).select("host_id", "window_end")


@query("crossing", f"""
SELECT prediction_id, probability >= {THR} AS high, probability >= {THR} AND coalesce(before < {THR}, true) AS crossing FROM v_seq
""")
def crossing(spark, sf_dir):
    return inc.crossing(predictions(spark, sf_dir), THR, SPARSE).select("prediction_id", "high", "crossing")


@query("forecast_validity", f"""
SELECT prediction_id, {ts(f'end_us + {H * 10**6}')} AS valid_until FROM v_seq WHERE p_us - end_us <= 30000000
""")
def forecast_validity(spark, sf_dir):
    return inc.forecast_validity(predictions(spark, sf_dir), 30).select("prediction_id", "valid_until")


@query("explain_mode", f"""
SELECT prediction_id, CASE WHEN probability < {THR} THEN 'below_threshold'
  WHEN before IS NULL OR before < {THR} OR incident_id IS NULL OR opened_us = p_us THEN 'complete' ELSE 'existing_condition' END AS explain_mode
FROM v_attached
""")
def explain_mode(spark, sf_dir):
    crossed = inc.crossing(predictions(spark, sf_dir), THR, SPARSE)
    return inc.explain_mode(crossed, incidents(spark, sf_dir), SPARSE, domain.as_of(spark, sf_dir)).select("prediction_id", "explain_mode")


# ---- incidents -----------------------------------------------------------------------------------


@query("open_incidents", f"""
SELECT incident_id, host_id, predicted_at, probability, {ts('valid_us')} AS valid_until, {ts('closed_us')} AS closed_at, closed_as,
  {ts('until_us')} AS open_until FROM v_incidents
""")
def open_incidents(spark, sf_dir):
    return incidents(spark, sf_dir).select(
        "incident_id", "host_id", "predicted_at", "probability", "valid_until", "closed_at", "closed_as", "open_until"
    )


oracle.cte("v_fact_changes", """
SELECT i.incident_id, string_agg('"' || f.feature || '":' || printf('%.6f', f.value), ',' ORDER BY f.feature) AS changes,
  list('"' || f.feature || '":' || printf('%.6f', f.value) ORDER BY abs(f.value) DESC, f.feature) FILTER (WHERE f.feature LIKE '%.delta') AS largest,
  list(f.feature || ': ' || printf('%+.6f', f.value) ORDER BY abs(f.value) DESC, f.feature) FILTER (WHERE f.feature LIKE '%.delta') AS told
FROM v_incidents i JOIN v_features f ON f.host_id = i.host_id AND f.end_us = i.end_us
WHERE f.value IS NOT NULL AND (ends_with(f.feature, '.delta') OR ends_with(f.feature, '.linear_trend')) GROUP BY i.incident_id
""")
oracle.cte("v_facts", f"""
SELECT i.incident_id, i.host_id, i.valid_us, i.probability, m.service_job, c.told[1:3] AS told, [
  'Host ' || i.host_id || ', service ' || coalesce(m.service_job, 'None') || ': model probability ' || printf('%.6f', i.probability) ||
    '; horizon {H}s anchored at ' || strftime(i.window_end, '%Y-%m-%dT%H:%M:%S') || ', valid until ' || strftime({ts('i.valid_us')}, '%Y-%m-%dT%H:%M:%S') || '.',
  'Separate unfamiliarity score ' || printf('%.6f', s.anomaly_score) || '; it is not an imminent-failure probability.',
  'Model v1 warns from 0.6 on; see its recorded evaluation before acting.',
  'Supplied associations: {{' || coalesce(array_to_string(c.largest[1:3], ','), '') || '}}',
  'Recorded active experiments: ' || coalesce((SELECT '[' || string_agg('{{"id":"' || x.experiment_id || '","type":"' || x.experiment_type || '","status":"' || x.experiment_status || '"}}', ','
      ORDER BY x.experiment_id) || ']' FROM v_experiments x
    WHERE x.host_id = i.host_id AND x.started_at <= i.predicted_at AND (x.ended_at IS NULL OR x.ended_at > i.predicted_at)), '[]'),
  'Recent alerts: [' || coalesce((SELECT array_to_string(list('{{"id":"' || a.alert_id || '","status":"' || a.status || '"}}'
      ORDER BY a.created_at DESC, a.alert_id DESC)[1:3], ',') FROM v_alerts a WHERE a.host_id = i.host_id AND a.created_at < i.predicted_at), '') || ']',
  'Causal feature changes: {{' || coalesce(c.changes, '') || '}}'] AS facts
FROM v_incidents i JOIN v_past s USING (prediction_id) LEFT JOIN v_map m ON m.host_id = i.host_id LEFT JOIN v_fact_changes c ON c.incident_id = i.incident_id
""")


@query("incident_facts", f"""
SELECT incident_id, '{inc.TITLE}' AS title, len(facts) AS n_facts, array_to_string(facts, ' ') AS summary FROM v_facts
""")
def incident_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select("incident_id", "title", F.size("evidence").cast("long").alias("n_facts"), "summary")


def _facts(spark, sf_dir):
    opened = checkpointed(incidents(spark, sf_dir))
    unusual = predictions(spark, sf_dir).select("prediction_id", "anomaly_score")
    told = domain.models(spark, sf_dir).withColumn(
        "warning", F.format_string("Model %s warns from %s on; see its recorded evaluation before acting.", "version", F.col("threshold").cast("string"))
    )
    return inc.incident_facts(
        opened.join(unusual, "prediction_id"),
        domain.service_map(spark, sf_dir),
        domain.experiments(spark, sf_dir),
        domain.as_of(spark, sf_dir),
        SPARSE,
        alerts=alerts(spark, sf_dir, opened),
        windows=features.feature_windows(domain.samples(spark, sf_dir), SPARSE, domain.as_of(spark, sf_dir)),
        models=told,
    )


@query("enqueue_alerts", "SELECT alert_id, incident_id, host_id, channel, created_at, next_attempt_at FROM v_queued")
def enqueue_alerts(spark, sf_dir):
    return inc.enqueue_alerts(incidents(spark, sf_dir), SPARSE).select(
        "alert_id", "incident_id", "host_id", "channel", "created_at", "next_attempt_at"
    )


@query("due_alerts", """
SELECT alert_id, created_at FROM v_alerts, v_now WHERE status IN ('pending', 'retry') AND attempt_count < 3 AND next_attempt_at <= now_ts
ORDER BY created_at, alert_id LIMIT 10
""")
def due_alerts(spark, sf_dir):
    return inc.due_alerts(alerts(spark, sf_dir), domain.as_of(spark, sf_dir)).select("alert_id", "created_at")


@query("delivery_outcomes", "SELECT alert_id, status, attempt_count, next_attempt_at, delivered_at FROM v_alerts")
def delivery_outcomes(spark, sf_dir):
    return alerts(spark, sf_dir).select("alert_id", "status", "attempt_count", "next_attempt_at", "delivered_at")


ALERTS = "alert_id string, host_id string, channel string, created_at timestamp, incident_id string, next_attempt_at timestamp"
DELIVERIES = "alert_id string, number int, change string, at timestamp, status_code int"
# Rule: the newest alert of the channel among the host's three last ones holds a new one back by the cooldown.
oracle.cte("v_h_alerts", """
SELECT incident_id || '/' || channel AS alert_id, incident_id, host_id, channel, p_us FROM v_incidents, (SELECT unnest(['generic', 'slack']) AS channel)
""")
oracle.cte("v_h_recent", """
SELECT * FROM (SELECT q.alert_id, q.channel AS mine, o.channel, o.p_us, row_number() OVER (PARTITION BY q.alert_id ORDER BY o.p_us DESC, o.alert_id DESC) AS rn
FROM v_h_alerts q JOIN v_h_alerts o ON o.host_id = q.host_id AND o.p_us < q.p_us) WHERE rn <= 3
""")
oracle.cte("v_h_queued", f"""
SELECT q.*, greatest(q.p_us, coalesce((SELECT max(r.p_us) FROM v_h_recent r WHERE r.alert_id = q.alert_id AND r.channel = r.mine) + {SPARSE.alert_cooldown * 10**6}, q.p_us)) AS due_us
FROM v_h_alerts q
""")
oracle.cte("v_h_made", "SELECT a.* FROM v_attempts a, v_now WHERE a.attempted_at <= now_ts")
oracle.cte("v_h_last", """
SELECT m.* FROM v_h_made m JOIN (SELECT alert_id, coalesce(min(CASE WHEN n = 3 OR code IS NULL OR NOT (code = 429 OR code >= 500) THEN n END), max(n)) AS n
FROM v_h_made GROUP BY alert_id) USING (alert_id, n)
""")


@query("alert_history", f"""
SELECT alert_id, channel, coalesce(status, 'pending') AS status, coalesce(n, 0)::INTEGER AS attempt_count, delivered_at,
  CASE WHEN status IS NULL THEN {ts('due_us')} WHEN status = 'retry' THEN attempted_at + to_seconds((30 * 2 ** (n - 1))::BIGINT) END AS next_attempt_at
FROM (SELECT q.alert_id, q.channel, q.due_us, a.n, a.attempted_at, CASE WHEN a.code BETWEEN 200 AND 299 THEN a.attempted_at END AS delivered_at,
  CASE WHEN a.n IS NULL THEN NULL WHEN a.code IS NULL THEN 'unknown' WHEN a.code BETWEEN 200 AND 299 THEN 'delivered'
       WHEN a.n < 3 AND (a.code = 429 OR a.code >= 500) THEN 'retry' ELSE 'failed' END AS status
  FROM v_h_queued q LEFT JOIN v_h_last a USING (alert_id))
""")
def alert_history(spark, sf_dir):
    """Alerts queued from stored ones in two runs, and deliveries folded from their log."""
    now = domain.as_of(spark, sf_dir)
    opened = checkpointed(incidents(spark, sf_dir))
    path = tables.scratch_path(spark, "alert-history")
    queue, sent = EventLog(spark, f"{path}/alerts", ALERTS), EventLog(spark, f"{path}/deliveries", DELIVERIES)
    early = F.col("predicted_at") <= F.lit(CUT)
    for run, part in (("early", opened.filter(early)), ("late", opened.filter(~early)), ("late", opened)):  # the last run is a replay
        queue.commit(inc.queue_alerts(part, queue.read(), SPARSE), run)
    queued = queue.read().drop("commit")
    order = Window.partitionBy("alert_id").orderBy("attempted_at")  # three rows
    tried = attempts(queued).withColumn("number", F.row_number().over(order)).filter(F.col("attempted_at") <= now)
    begun = tried.select("alert_id", "number", F.lit("sending").alias("change"), F.col("attempted_at").alias("at"), F.lit(None).cast("int").alias("status_code"))
    answer = tried.filter("status_code IS NOT NULL")
    answer = answer.select("alert_id", "number", F.lit("answered").alias("change"), F.timestamp_micros(micros("attempted_at") + 1_000_000).alias("at"), "status_code")
    sent.commit(begun.unionByName(answer), "deliveries")
    known, _ = inc.delivery_attempts(sent.read(), now)
    told = inc.delivery_outcomes(queued, known)
    return told.select("alert_id", "channel", "status", "attempt_count", "delivered_at", "next_attempt_at")


@query("match_failures", """
SELECT incident_id, event_id AS failure_event_id, matched_id AS matched_prediction_id, lead AS prediction_lead_seconds FROM v_matched
""")
def match_failures(spark, sf_dir):
    opened = checkpointed(incidents(spark, sf_dir))
    return inc.matches_of(opened).select(
        "incident_id", "failure_event_id", "matched_prediction_id", "prediction_lead_seconds"
    )


@query("alert_timing", """
SELECT alert_id, CASE WHEN delivered_at IS NULL THEN 'not_delivered' WHEN epoch_us(delivered_at) >= onset_us THEN 'after_degradation'
  WHEN onset_us > valid_us THEN 'outside_forecast_horizon' ELSE 'before_degradation' END AS timing,
  CASE WHEN epoch_us(delivered_at) < onset_us AND onset_us <= valid_us THEN (onset_us - epoch_us(delivered_at)) / 1000000.0 END AS lead_seconds
FROM v_alerts JOIN v_matched USING (incident_id)
""")
def alert_timing(spark, sf_dir):
    opened = checkpointed(incidents(spark, sf_dir))
    timed = inc.with_alert_timing(alerts(spark, sf_dir, opened), inc.matches_of(opened))
    return timed.select("alert_id", "timing", "lead_seconds")


@query("incident_status", "SELECT incident_id, status, resolved_at FROM v_statuses")
def incident_status(spark, sf_dir):
    return statuses(spark, sf_dir).select("incident_id", "status", "resolved_at")


@query("unresolved_twice", "SELECT host_id, count(*) AS unresolved FROM v_statuses WHERE resolved_at IS NULL GROUP BY host_id HAVING count(*) > 1")
def unresolved_twice(spark, sf_dir):
    """Hosts with more than one unresolved incident: none."""
    unresolved = statuses(spark, sf_dir).filter("resolved_at IS NULL").groupBy("host_id").agg(F.count(F.lit(1)).alias("unresolved"))
    return unresolved.filter("unresolved > 1")


@query("cancel_alerts", """
SELECT alert_id, CASE WHEN a.status IN ('pending', 'retry') AND s.resolved_at IS NOT NULL THEN 'cancelled' ELSE a.status END AS status
FROM v_alerts a JOIN v_statuses s USING (incident_id)
""")
def cancel_alerts(spark, sf_dir):
    state = checkpointed(statuses(spark, sf_dir))
    return inc.cancel_alerts(alerts(spark, sf_dir, state), state).select("alert_id", "status")


# ---- proposals -----------------------------------------------------------------------------------

oracle.cte("v_newest", """
SELECT p.*, m.threshold FROM v_past p JOIN v_models m USING (model_id)
WHERE p.end_us = (SELECT max(q.end_us) FROM v_past q WHERE q.host_id = p.host_id AND q.model_id = p.model_id)
""")
_ELIGIBLE = f"""probability >= greatest({SPARSE.proposal_threshold}, threshold) AND now_us - epoch_us(predicted_at) BETWEEN 0 AND {SPARSE.max_age * 10**6}
  AND now_us - end_us BETWEEN 0 AND {SPARSE.max_age * 10**6} AND now_us < end_us + {H * 10**6}"""


@query("proposal_eligible", f"""
SELECT prediction_id, {_ELIGIBLE} AS eligible FROM v_past JOIN v_models USING (model_id), v_now
""")
def proposal_eligible(spark, sf_dir):
    scored = predictions(spark, sf_dir).join(domain.models(spark, sf_dir).select("model_id", "threshold"), "model_id")
    ok = inc.proposal_eligible("threshold", domain.as_of(spark, sf_dir), SPARSE)
    return scored.select("prediction_id", ok.alias("eligible"))


# Proposals need fresh high scores on open incidents: an earlier cutoff with some of them.
LOW_BAR = SPARSE.but(proposal_threshold=0.6, max_age=6 * 3600)
THEN = datetime(2024, 1, 20, 12, tzinfo=UTC)
oracle.cte("v_then", "SELECT TIMESTAMP '2024-01-20 12:00:00' AS now_ts, epoch_us(TIMESTAMP '2024-01-20 12:00:00') AS now_us")
oracle.cte("v_proposals", f"""
SELECT s.incident_id || '/collect-diagnostics:v1' AS proposal_id, s.incident_id, n.host_id, n.prediction_id, n.probability, n.anomaly_score,
  {ts(f'n.end_us + {H * 10**6}')} AS valid_until
FROM v_statuses s JOIN v_newest n ON n.host_id = s.host_id AND n.model_id = s.model_id, v_now
WHERE s.resolved_at IS NULL AND n.probability >= greatest(0.6, n.threshold) AND now_us - epoch_us(n.predicted_at) BETWEEN 0 AND 21600000000
  AND now_us - n.end_us BETWEEN 0 AND 21600000000 AND now_us < n.end_us + {H * 10**6}
""")
oracle.variant(
    "_then",
    ["v_past", "v_seq", "v_candidates", "v_would_match", "v_settled", "v_opened", "v_incidents", "v_attached", "v_visible", "v_matched", "v_statuses", "v_newest", "v_proposals"],
    {"v_now": "v_then"},
)


def proposals(spark, sf_dir, state, now=None):
    none = spark.createDataFrame([], "incident_id string, runbook string")
    cutoff = domain.as_of(spark, sf_dir) if now is None else now
    return inc.create_proposals(
        state, predictions(spark, sf_dir, now), domain.models(spark, sf_dir), none, cutoff, LOW_BAR
    )


@query("create_proposals", "SELECT proposal_id, incident_id, prediction_id, probability, valid_until FROM v_proposals_then")
def create_proposals(spark, sf_dir):
    now = F.lit(THEN)
    return proposals(spark, sf_dir, statuses(spark, sf_dir, now), now).select(
        "proposal_id", "incident_id", "prediction_id", "probability", "valid_until"
    )


@query("validate_proposals", f"""
SELECT s.incident_id || '/collect-diagnostics:v1' AS proposal_id,
  CASE WHEN p.incident_id IS NULL OR p.prediction_id <> s.prediction_id THEN 'cancelled: resolved, superseded, stale or expired'
       WHEN length(s.incident_id) % 2 = 0 THEN 'cancelled: facts differ from stored score' ELSE 'sending' END AS verdict
FROM v_statuses_then s LEFT JOIN v_proposals_then p USING (incident_id)
""")
def validate_proposals(spark, sf_dir):
    now = F.lit(THEN)
    state = checkpointed(statuses(spark, sf_dir, now))
    # A proposal was made for every incident as it opened; some recorded another probability.
    wrong = F.when(F.length("incident_id") % 2 == 0, 0.001).otherwise(0.0)
    score = predictions(spark, sf_dir, now).select("prediction_id", "anomaly_score")
    claimed = state.join(score, "prediction_id").select(
        F.concat_ws("/", "incident_id", F.lit(inc.RUNBOOK)).alias("proposal_id"),
        "incident_id",
        "host_id",
        "prediction_id",
        (F.col("probability") + wrong).alias("probability"),
        "anomaly_score",
        "valid_until",
    )
    judged = inc.validate_proposals(
        claimed, state, predictions(spark, sf_dir, now), domain.models(spark, sf_dir), now, LOW_BAR
    )
    return judged.select("proposal_id", "verdict")


@query("alert_payload", f"""
SELECT incident_id,
  'Incident ' || incident_id || ' · Host ' || host_id || ' · Service ' || coalesce(service_job, 'None') || chr(10) ||
  'Failure probability ' || printf('%.6f', probability) || '; valid until ' || strftime({ts('valid_us')}, '%Y-%m-%dT%H:%M:%S') AS core,
  'Associated signals (not causes):' || chr(10) || coalesce(array_to_string(told, chr(10)), '') AS signals,
  'Summary excerpt:' || chr(10) || left(array_to_string(facts, ' '), 1800) AS excerpt
FROM v_facts
""")
def alert_payload(spark, sf_dir):
    message = inc.alert_payload(_facts(spark, sf_dir), F.coalesce("drivers", F.array().cast("array<struct<feature:string,contribution:double>>")))
    part = F.col("sections")
    return message.select("incident_id", part[0].alias("core"), part[1].alias("signals"), part[2].alias("excerpt"))


@query("live_outcomes", f"""
SELECT f.event_id, f.host_id, coalesce(c.scores, 0) AS scores, coalesce(c.crossings, 0) AS crossings, c.low, c.high, a.alert_id,
  (f.onset_us - a.at_us) / 1000000.0 AS alert_lead, coalesce((f.onset_us - a.at_us) / 1000000.0 >= {SPARSE.min_lead}, false) AS useful
FROM v_raw_failures f
LEFT JOIN (SELECT f.event_id, count(*) AS scores, count(*) FILTER (WHERE probability >= {THR}) AS crossings, min(probability) AS low, max(probability) AS high
  FROM v_raw_failures f JOIN v_seq s ON s.host_id = f.host_id AND s.end_us < f.onset_us AND f.onset_us <= s.end_us + {H * 10**6} AND s.p_us < f.onset_us
  GROUP BY f.event_id) c USING (event_id)
LEFT JOIN (SELECT event_id, arg_min(alert_id, (delivered_at, alert_id)) AS alert_id, epoch_us(min(delivered_at)) AS at_us
  FROM v_raw_failures f JOIN v_alerts a ON a.host_id = f.host_id AND a.status = 'delivered' AND epoch_us(a.delivered_at) < f.onset_us
    AND a.end_us < f.onset_us AND f.onset_us <= a.valid_us GROUP BY event_id) a USING (event_id)
""")
def live_outcomes(spark, sf_dir):
    out = inc.live_outcomes(
        common.events(spark, sf_dir), predictions(spark, sf_dir), alerts(spark, sf_dir), THR, SPARSE
    )
    return out




@query("registry_log", f"""
SELECT m.version, m.model_id, m.threshold, count(p.prediction_id) AS scored, count(p.prediction_id) FILTER (WHERE p.probability >= m.threshold) AS warned
FROM v_models m LEFT JOIN v_past p USING (model_id) GROUP BY ALL
""")
def registry_log(spark, sf_dir):
    """Models registered with their evaluation run in one commit; a repeated registration changes nothing."""
    log = event_log.EventLog(spark, tables.scratch_path(spark, "registry"), event_log.REGISTRY)
    models = checkpointed(domain.models(spark, sf_dir))
    scored = predictions(spark, sf_dir).join(F.broadcast(models.select("model_id", "threshold")), "model_id")  # three models
    high = F.count(F.when(F.col("probability") >= F.col("threshold"), 1))
    runs = checkpointed(scored.groupBy("model_id").agg(F.count(F.lit(1)).alias("scored"), high.alias("warned")))
    versions = sorted(r["version"] for r in models.select("version").collect())
    for version in [*versions, versions[0]]:
        model = models.filter(F.col("version") == version)
        event_log.register_model(log, version, model.drop("version"), model.select("model_id").join(runs, "model_id", "left").na.fill(0))
    kept = event_log.registered(log, "model", "model_id string, threshold double")
    told = event_log.registered(log, "evaluation", "model_id string, scored bigint, warned bigint").drop("model_id")
    return kept.join(told, "registered_version").select(F.col("registered_version").alias("version"), "model_id", "threshold", "scored", "warned")
