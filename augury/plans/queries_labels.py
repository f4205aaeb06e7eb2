"""Queries over probes, failure events and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.functions.clock import plus
from augury.functions.cut import checkpointed
from augury.operators import clean, features, labels, probes
from augury.plans import common, oracle_events  # noqa: F401
from augury.plans.catalog import query
from augury.plans.oracle import ts
from augury.plans.queries_data import stored_windows
from augury.settings import SPARSE
from augury.sources import domain


@query("classify_probe", "SELECT probe_id, host_id, outcome, breached FROM v_outcomes")
def classify_probe(spark, sf_dir):
    return common.outcomes(spark, sf_dir).select("probe_id", "host_id", "outcome", "breached")


@query("slo_recheck", "SELECT probe_id, healthy FROM v_judged")
def slo_recheck(spark, sf_dir):
    return clean.slo_recheck(domain.probes(spark, sf_dir), SPARSE.latency_slo).select("probe_id", "healthy")


_CONFIRMED = "SELECT host_id, probe_id, first_probe_id, first_at, observed_at AS confirmed_at, first_outcome FROM v_confirmed"


def _confirmed(frame):
    return frame.select("host_id", "probe_id", "first_probe_id", "first_at", "confirmed_at", "first_outcome")


@query("breach_confirm", _CONFIRMED + " WHERE breached")
def breach_confirm(spark, sf_dir):
    return _confirmed(probes.breach_confirm(common.outcomes(spark, sf_dir), SPARSE))


@query("recovery_confirm", _CONFIRMED + " WHERE NOT breached")
def recovery_confirm(spark, sf_dir):
    return _confirmed(probes.recovery_confirm(common.outcomes(spark, sf_dir), SPARSE))


_EVENT = ["event_id", "host_id", "failure_type", "observed_at", "confirmed_at", "recovered_at", "recovery_confirmed_at"]


@query("failure_events", f"SELECT {', '.join(_EVENT)} FROM v_raw_failures")
def failure_events(spark, sf_dir):
    return common.events(spark, sf_dir).select(*_EVENT)


@query("healthy_baseline", """
SELECT host_id, probes, span_seconds, coalesce(now_us - hi <= 14400000000, false) AS fresh FROM v_now, (
  SELECT host_id, count(*) FILTER (WHERE NOT burst) AS probes, max(t) FILTER (WHERE NOT burst) AS hi,
    coalesce((max(t) FILTER (WHERE NOT burst) - min(t) FILTER (WHERE NOT burst)) / 1000000.0, 0.0) AS span_seconds
  FROM (SELECT *, max(CASE WHEN reset THEN rn ELSE 0 END) OVER (PARTITION BY host_id) AS start_rn FROM (
    SELECT host_id, t, row_number() OVER w AS rn,
      coalesce(breached AND lag(breached, 1) OVER w AND lag(breached, 2) OVER w AND t - lag(t, 2) OVER w <= 14400000000, false) AS burst,
      coalesce(breached AND lag(breached, 1) OVER w AND lag(breached, 2) OVER w AND t - lag(t, 2) OVER w <= 14400000000, false)
        OR coalesce(t - lag(t) OVER w > 14400000000, false) AS reset
    FROM v_outcomes WINDOW w AS (PARTITION BY host_id ORDER BY t, probe_id)))
  WHERE rn >= start_rn GROUP BY host_id)
""")
def healthy_baseline(spark, sf_dir):
    return probes.healthy_baseline(
        common.outcomes(spark, sf_dir),
        domain.as_of(spark, sf_dir),
        SPARSE,
        max_gap=SPARSE.max_gap,
        breaches=3,
        span=SPARSE.confirm_span,
    )


@query("probe_experiment", "SELECT host_id, probe_id, experiment_id FROM v_tagged")
def probe_experiment(spark, sf_dir):
    return probes.probe_experiment(
        domain.probes(spark, sf_dir), domain.experiments(spark, sf_dir), domain.as_of(spark, sf_dir), SPARSE
    ).select("host_id", "probe_id", "experiment_id")


@query("experiment_outcome", """
SELECT x.experiment_id, x.host_id, count(f.event_id) > 0 AS degradation_confirmed,
  coalesce(string_agg(f.event_id, ',' ORDER BY f.event_id), '') AS failure_event_ids
FROM v_experiments x LEFT JOIN v_failures f ON f.experiment_id = x.experiment_id
WHERE x.ended_at IS NOT NULL GROUP BY x.experiment_id, x.host_id
""")
def experiment_outcome(spark, sf_dir):
    return probes.experiment_outcome(domain.experiments(spark, sf_dir), common.attributed_events(spark, sf_dir))


@query("active_experiments_at", """
SELECT p.prediction_id, x.experiment_id, x.experiment_type, x.experiment_status
FROM v_predictions p JOIN v_experiments x ON x.host_id = p.host_id AND x.started_at <= p.predicted_at
  AND (x.ended_at IS NULL OR x.ended_at > p.predicted_at), v_now
WHERE p.predicted_at <= now_ts
""")
def active_experiments_at(spark, sf_dir):
    now = domain.as_of(spark, sf_dir)
    points = domain.predictions(spark, sf_dir).select("host_id", "prediction_id", "predicted_at")
    return probes.active_experiments_at(
        points.filter(F.col("predicted_at") <= now), domain.experiments(spark, sf_dir), "predicted_at", SPARSE, now
    ).select("prediction_id", "experiment_id", "experiment_type", "experiment_status")


@query("detection_delay", """
SELECT event_id, host_id, (confirmed_us - onset_us) / 1000000.0 AS confirmation_seconds,
  (recovered_us - onset_us) / 1000000.0 AS outage_seconds FROM v_raw_failures
""")
def detection_delay(spark, sf_dir):
    return probes.detection_delay(common.events(spark, sf_dir))


# ---- labels ------------------------------------------------------------------------------------

_LABELLED = f"""
SELECT l.host_id, {ts('l.end_us')} AS window_end, l.label, l.reason AS label_reason, l.failure_event_id,
  f.experiment_id, f.failure_type, f.observed_at AS failure_onset
FROM v_labels l LEFT JOIN v_failures f ON f.event_id = l.failure_event_id
"""


@query("known_events", """
SELECT event_id, host_id, confirmed_at FROM v_failures, v_now
WHERE onset_us <= confirmed_us AND confirmed_us <= now_us - 10 * 86400000000
""")
def known_events(spark, sf_dir):
    cutoff = F.timestamp_micros(F.unix_micros(domain.as_of(spark, sf_dir)) - 10 * 86_400_000_000)
    return labels.known_events(common.attributed_events(spark, sf_dir), cutoff).select(
        "event_id", "host_id", "confirmed_at"
    )


@query("labelled_windows", _LABELLED)
def labelled_windows(spark, sf_dir):
    return common.labelled(spark, sf_dir).select(
        "host_id",
        "window_end",
        F.col("label").cast("double").alias("label"),
        "label_reason",
        "failure_event_id",
        "experiment_id",
        "failure_type",
        "failure_onset",
    )


def _reason_query(name: str, reason: str) -> None:
    @query(name, f"SELECT host_id, {ts('end_us')} AS window_end, label, failure_event_id FROM v_labels WHERE reason = '{reason}'")
    def run(spark, sf_dir):
        return (
            common.labelled(spark, sf_dir)
            .filter(F.col("label_reason") == reason)
            .select("host_id", "window_end", F.col("label").cast("double").alias("label"), "failure_event_id")
        )


for _name, _reason in {
    "label_active": "active_failure_or_recovery",
    "label_positive": "confirmed_future_failure",
    "label_censored": "right_censored",
    "label_censored_tail": "right_censored_confirmation",
    "label_coverage": "incomplete_observation_coverage",
    "label_gap": "observation_gap",
    "label_criteria": "unknown_or_changed_criteria",
    "label_negative": "observed_no_sustained_failure_horizon",
}.items():
    _reason_query(_name, _reason)


@query("label_unconfirmed", f"""
SELECT host_id, {ts('end_us')} AS window_end, label FROM v_single WHERE reason = 'unconfirmed_degradation'
""")
def label_unconfirmed(spark, sf_dir):
    """In single-breach mode, where one bad probe already forbids a negative label."""
    strict = labels.label_windows(
        common.keys(spark, sf_dir),
        common.attributed_events(spark, sf_dir),
        common.judged_probes(spark, sf_dir),
        domain.as_of(spark, sf_dir),
        SPARSE,
        count=1,
    )
    return strict.filter("label_reason = 'unconfirmed_degradation'").select(
        "host_id", "window_end", F.col("label").cast("double").alias("label")
    )


@query("input_health", f"""
SELECT host_id, {ts('start_us')} AS window_start, label AS input_label, reason AS input_reason FROM v_inputs
""")
def input_health(spark, sf_dir):
    return common.health(spark, sf_dir).withColumn("input_label", F.col("input_label").cast("double"))


@query("healthy_inputs", f"""
SELECT l.host_id, {ts('l.end_us')} AS window_end, l.label, l.reason AS label_reason
FROM v_labels l JOIN v_inputs i ON i.host_id = l.host_id AND i.end_us = l.end_us
WHERE i.label = 0 AND coalesce(l.label, 0) <> 1
""")
def healthy_inputs(spark, sf_dir):
    health = common.health(spark, sf_dir).withColumn("window_start", plus("window_start", common.INPUT_SPAN - SPARSE.window))
    return labels.healthy_inputs(common.labelled(spark, sf_dir), health).select(
        "host_id", "window_end", F.col("label").cast("double").alias("label"), "label_reason"
    )


@query("skip_counts", f"""
SELECT reason, count(*) AS windows FROM (
SELECT CASE WHEN l.end_us > now_us - 5 * 86400000000 THEN 'future_feature_window' WHEN hour({ts('l.end_us')}) = 5 THEN 'schema_mismatch'
  WHEN hour({ts('l.end_us')}) = 7 THEN 'nonfinite_feature' WHEN coverage < 0.8 * 86400 THEN 'insufficient_feature_history'
  WHEN l.label IS NULL THEN l.reason END AS reason
FROM v_labels l JOIN v_coverage c USING (host_id, end_us) CROSS JOIN v_now) WHERE reason IS NOT NULL GROUP BY reason
""")
def skip_counts(spark, sf_dir):
    """Why stored windows stay out of a dataset: first what makes them unfit, then what keeps them without a label."""
    cutoff = plus(domain.as_of(spark, sf_dir), -5 * 86400)
    windows = clean.assert_causal_quality(stored_windows(spark, sf_dir))
    reason = clean.training_skip_reason(features.Contract.of(SPARSE), cutoff)
    judged = checkpointed(windows.select("host_id", "window_start", "window_end", reason.alias("skip_reason")))
    fit = judged.filter("skip_reason IS NULL").drop("skip_reason")
    return labels.skip_counts(judged.filter("skip_reason IS NOT NULL"), common.labels_of(spark, sf_dir, fit))


@query("label_distribution", """
SELECT 'label' AS kind, CAST(CAST(label AS INTEGER) AS VARCHAR) AS name, count(*) AS n FROM v_labels WHERE label IS NOT NULL GROUP BY label
UNION ALL SELECT 'failure', failure_type, count(*) FROM v_failures GROUP BY failure_type
UNION ALL SELECT 'positive', f.failure_type, count(*) FROM v_labels l JOIN v_failures f ON f.event_id = l.failure_event_id
  GROUP BY f.failure_type
""")
def label_distribution(spark, sf_dir):
    rows = common.labelled(spark, sf_dir).filter(F.col("label").isNotNull())

    def counted(frame, kind, column):
        return frame.groupBy(F.col(column).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), "name", "n"
        )

    return (
        counted(rows, "label", "label")
        .unionByName(counted(common.events(spark, sf_dir), "failure", "failure_type"))
        .unionByName(counted(rows.filter("label = 1"), "positive", "failure_type"))
    )


