"""Queries over sources, sinks, table upkeep, cleaning and eligibility."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from augury.functions.clock import micros, plus
from augury.functions.cut import checkpointed
from augury.operators import clean, features
from augury.plans import common, oracle, oracle_events  # noqa: F401
from augury.plans.catalog import query
from augury.plans.oracle import ts
from augury.settings import SPARSE
from augury.sources import domain, tables

CUT = datetime(2024, 1, 15, tzinfo=UTC)
CUT_SQL = "TIMESTAMP '2024-01-15'"


# ---- sources and sinks ---------------------------------------------------------------------------


def _documents(spark, sf_dir):
    """Range-query answers, one per host, metric and day; some of them unusable."""
    day = F.to_date("ts")
    point = F.concat(F.lit("["), (micros("ts") / 1_000_000).cast("string"), F.lit(',"'), F.col("value").cast("string"), F.lit('"]'))
    grouped = (
        domain.samples(spark, sf_dir)
        .groupBy("host_id", "metric", day.alias("day"))
        .agg(F.array_join(F.collect_list(point), ",").alias("points"))
    )
    digit = F.dayofmonth("day") % 10
    return grouped.select(
        F.concat(
            F.lit('{"status":"'),
            F.when(digit == 3, "error").otherwise("success"),
            F.lit('","data":{"resultType":"'),
            F.when(digit == 7, "vector").otherwise("matrix"),
            F.lit('","result":[{"metric":{"host_id":"'),
            F.col("host_id"),
            F.lit('","name":"'),
            F.col("metric"),
            F.lit('"},"values":['),
            F.col("points"),
            F.lit("]}]}}"),
        ).alias("document")
    )


@query("matrix_flatten", """
SELECT host_id, metric, ts, value FROM v_samples WHERE day(ts) % 10 NOT IN (3, 7)
""")
def matrix_flatten(spark, sf_dir):
    rows = tables.matrix_flatten(_documents(spark, sf_dir))
    return rows.select(F.col("labels")["host_id"].alias("host_id"), F.col("labels")["name"].alias("metric"), "ts", "value")


@query("matrix_rejected", """
SELECT count(*) AS rejected FROM (SELECT DISTINCT host_id, metric, CAST(ts AS DATE) AS d FROM v_samples) WHERE day(d) % 10 IN (3, 7)
""")
def matrix_rejected(spark, sf_dir):
    return tables.matrix_rejected(_documents(spark, sf_dir)).agg(F.count(F.lit(1)).alias("rejected"))


@query("service_map_join", """
SELECT s.event_id, s.host_id, m.service_job FROM v_samples s LEFT JOIN v_map m USING (host_id)
""")
def service_map_join(spark, sf_dir):
    joined = tables.service_map_join(domain.samples(spark, sf_dir), domain.service_map(spark, sf_dir))
    return joined.select("event_id", "host_id", "service_job")


def hosts(frame, service_map):
    described = frame.groupBy("host_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return tables.service_map_join(described, service_map).select(
        "host_id",
        F.concat(F.lit("node-"), F.col("host_id")).alias("name"),
        F.lit("demo").alias("environment"),
        "service_job",
        "first_seen",
        "last_seen",
    )


@query("host_upsert", f"""
SELECT s.host_id, 'node-' || s.host_id || CASE WHEN max(s.ts) > {CUT_SQL} THEN '-renamed' ELSE '' END AS name, 'demo' AS environment,
  any_value(m.service_job) AS service_job, min(s.ts) AS first_seen, max(s.ts) AS last_seen
FROM v_samples s LEFT JOIN v_map m USING (host_id) GROUP BY s.host_id
""")
def host_upsert(spark, sf_dir):
    samples, jobs = domain.samples(spark, sf_dir), domain.service_map(spark, sf_dir)
    existing = hosts(samples.filter(F.col("ts") <= F.lit(CUT)), jobs)
    incoming = hosts(samples.filter(F.col("ts") > F.lit(CUT)), jobs).withColumn(
        "name", F.concat("name", F.lit("-renamed"))
    )
    return tables.host_upsert(existing, incoming)


@query("append_windows_once", f"""
SELECT host_id, {ts('end_us')} AS window_end, CASE WHEN {ts('end_us')} <= {CUT_SQL} THEN 'stored' ELSE 'appended' END AS origin
FROM v_keys
""")
def append_windows_once(spark, sf_dir):
    keys = common.keys(spark, sf_dir).withColumn("schema_version", F.lit(features.Contract.of(SPARSE).version))
    stored = keys.filter(F.col("window_end") <= F.lit(CUT)).withColumn("origin", F.lit("stored"))
    # The retry repeats everything, twice.
    retry = keys.withColumn("origin", F.lit("appended"))
    added = tables.append_once(stored, retry.unionByName(retry), ["host_id", "window_end", "schema_version"], ["origin"])
    return stored.unionByName(added).select("host_id", "window_end", "origin")


@query("partitioned_windows", f"""
SELECT host_id, {ts('end_us')} AS window_end FROM v_keys
WHERE {ts('end_us')} >= TIMESTAMP '2024-01-10' AND {ts('end_us')} < TIMESTAMP '2024-01-13'
""")
def partitioned_windows(spark, sf_dir):
    path = tables.scratch_path(spark, "windows")
    tables.write_partitioned(common.keys(spark, sf_dir), path, "window_end")
    days = spark.read.parquet(path).filter(F.col("day").between("2024-01-10", "2024-01-12"))
    return days.select("host_id", "window_end")


@query("snapshot_as_of", f"""
SELECT 'samples' AS input, host_id, count(*) AS n, max(ts) AS newest FROM v_samples WHERE ts <= {CUT_SQL} GROUP BY host_id
UNION ALL SELECT 'probes', host_id, count(*), max(observed_at) FROM v_probes WHERE observed_at <= {CUT_SQL} GROUP BY host_id
UNION ALL SELECT 'experiments', host_id, count(*), max(started_at) FROM v_experiments WHERE started_at <= {CUT_SQL} GROUP BY host_id
""")
def snapshot_as_of(spark, sf_dir):
    inputs = {
        "samples": (domain.samples(spark, sf_dir), "ts"),
        "probes": (domain.probes(spark, sf_dir), "observed_at"),
        "experiments": (domain.experiments(spark, sf_dir), "started_at"),
    }
    cut = tables.snapshot_as_of(list(inputs.values()), F.lit(CUT))
    counted = [
        frame.groupBy("host_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max(column).alias("newest"))
        .select(F.lit(name).alias("input"), "host_id", "n", "newest")
        for frame, (name, (_, column)) in zip(cut, inputs.items())
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


PARTS = ["host_id", "window_start", "window_end", "label", "label_reason", "failure_event_id"]


def _dataset(spark, sf_dir):
    """Labelled rows, and rows of healthy input whatever their label."""
    rows = checkpointed(common.dataset(spark, sf_dir))
    return rows.filter(F.col("label").isNotNull()).select(*PARTS), common.healthy_part(spark, sf_dir, rows).select(*PARTS)


@query("write_dataset", f"""
SELECT 'samples' AS part, host_id, {ts('end_us')} AS window_end, label, failure_event_id FROM v_dataset WHERE label IS NOT NULL
UNION ALL SELECT 'healthy', host_id, {ts('end_us')}, label, failure_event_id FROM v_healthy_part
""")
def write_dataset(spark, sf_dir):
    rows, healthy = (checkpointed(part) for part in _dataset(spark, sf_dir))
    root = tables.scratch_path(spark, "dataset")
    path = tables.write_dataset(rows, healthy, "check", root)
    again = tables.write_dataset(rows, healthy, "check", root)
    if again != path:
        raise ValueError("dataset is not reproducible")
    parts = [
        tables.read_dataset(spark, path, part, rows.schema).select(
            F.lit(part).alias("part"), "host_id", "window_end", F.col("label").cast("double").alias("label"), "failure_event_id"
        )
        for part in ("samples", "healthy")
    ]
    return parts[0].unionByName(parts[1])


oracle.cte("v_row_hashes", """
SELECT sha256(host_id || '|' || CAST(end_us AS VARCHAR) || '|' || reason) AS h FROM v_labels
""")


def _lane(i: int) -> str:
    digits = " || ".join(["'0x'", f"substr(h, {1 + 15 * i}, 15)"])
    return f"CAST(sum(CAST(CAST({digits} AS BIGINT) AS HUGEINT)) AS VARCHAR)"


@query("dataset_digest", f"""
SELECT count(*) AS row_count, sha256(CAST(count(*) AS VARCHAR) || '~' || {" || '~' || ".join(_lane(i) for i in range(4))}) AS digest
FROM v_row_hashes
""")
def dataset_digest(spark, sf_dir):
    text = F.concat_ws("|", "host_id", micros("window_end").cast("string"), "label_reason")
    return tables.content_digest(common.labelled(spark, sf_dir), text)


@query("registry_append", "SELECT model_id, version, threshold, created_at FROM v_models")
def registry_append(spark, sf_dir):
    models = domain.models(spark, sf_dir)
    return tables.registry_append(models.filter("model_id <> 'model-3'"), models, ["model_id", "threshold"])


@query("registry_conflicts", "SELECT model_id, version, threshold + 0.5 AS threshold FROM v_models WHERE version = 'v2'")
def registry_conflicts(spark, sf_dir):
    models = domain.models(spark, sf_dir)
    changed = models.withColumn("threshold", F.col("threshold") + F.when(F.col("version") == "v2", 0.5).otherwise(0.0))
    return tables.registry_conflicts(models, changed, ["model_id", "threshold"]).select("model_id", "version", "threshold")


@query("dedupe_receipts", f"""
SELECT idempotency_key, received_at, channel, kind, receipt_id FROM (
  SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY received_at, receipt_id) AS rn
  FROM v_receipts WHERE length(idempotency_key) BETWEEN 1 AND 128 AND received_at > {CUT_SQL})
WHERE rn = 1 AND idempotency_key NOT IN (SELECT idempotency_key FROM v_receipts WHERE received_at <= {CUT_SQL})
""")
def dedupe_receipts(spark, sf_dir):
    receipts = domain.receipts(spark, sf_dir)
    history = tables.dedupe_receipts(receipts.filter(F.col("received_at") <= F.lit(CUT)))
    return tables.dedupe_receipts(receipts.filter(F.col("received_at") > F.lit(CUT)), history)


@query("retention_prune", "SELECT event_id, host_id, metric, ts FROM v_samples, v_now WHERE t > now_us - 7 * 86400000000")
def retention_prune(spark, sf_dir):
    kept = tables.retention_prune(domain.samples(spark, sf_dir), "ts", domain.as_of(spark, sf_dir))
    return kept.select("event_id", "host_id", "metric", "ts")


@query("recent_n", """
SELECT prediction_id, host_id, predicted_at, probability FROM v_predictions ORDER BY predicted_at DESC, prediction_id DESC LIMIT 100
""")
def recent_n(spark, sf_dir):
    newest = tables.recent(domain.predictions(spark, sf_dir), "predicted_at", "prediction_id", 100)
    return newest.select("prediction_id", "host_id", "predicted_at", "probability")


@query("redact", "SELECT receipt_id, received_at, channel FROM v_receipts")
def redact(spark, sf_dir):
    return tables.redact(domain.receipts(spark, sf_dir), "idempotency_key", "kind")


# ---- cleaning and identity -------------------------------------------------------------------------


@query("clean_samples", """
SELECT host_id, metric, ts, any_value(value) AS value FROM v_dirty, v_now
WHERE NOT isnan(value) AND t > now_us - 20 * 86400000000 AND t <= now_us
GROUP BY host_id, metric, ts HAVING count(DISTINCT value) = 1
""")
def clean_samples(spark, sf_dir):
    now = domain.as_of(spark, sf_dir)
    return clean.clean_samples(domain.dirty_samples(spark, sf_dir), plus(now, -20 * 86400), now)


@query("conflicting_samples", """
SELECT host_id, metric, ts, min(value) AS low, max(value) AS high FROM v_dirty WHERE NOT isnan(value)
GROUP BY host_id, metric, ts HAVING count(DISTINCT value) > 1
""")
def conflicting_samples(spark, sf_dir):
    return clean.conflicting_samples(domain.dirty_samples(spark, sf_dir))


oracle.cte("v_series_age", """
SELECT host_id, metric, max(ts) AS last_ts, max(now_us) - max(t) AS age_us FROM v_samples, v_now GROUP BY host_id, metric
""")


@query("fresh_hosts", "SELECT host_id, last_ts FROM v_series_age WHERE metric = 'cpu_usage_percent' AND age_us <= 43200000000")
def fresh_hosts(spark, sf_dir):
    return clean.fresh_hosts(domain.samples(spark, sf_dir), domain.as_of(spark, sf_dir), SPARSE.freshness).select(
        "host_id", "last_ts"
    )


@query("fresh_metrics", """
SELECT host_id, metric, last_ts FROM v_series_age a WHERE age_us <= 43200000000 AND EXISTS (
  SELECT 1 FROM v_series_age c WHERE c.host_id = a.host_id AND c.metric = 'cpu_usage_percent' AND c.age_us <= 43200000000)
""")
def fresh_metrics(spark, sf_dir):
    return clean.usable_series(domain.samples(spark, sf_dir), domain.as_of(spark, sf_dir), SPARSE.freshness)


@query("ambiguous_hosts", """
SELECT host_id, count(DISTINCT (host_name, environment)) AS identities,
  bool_or(length(host_id) > 128 OR length(host_name) > 256 OR length(environment) > 32) AS too_long
FROM v_series WHERE metric = 'cpu_usage_percent' GROUP BY host_id HAVING identities > 1 OR too_long
""")
def ambiguous_hosts(spark, sf_dir):
    return clean.ambiguous_hosts(domain.labelled_series(spark, sf_dir))


oracle.cte("v_identity", """
SELECT host_id, min(host_name) AS host_name FROM v_series WHERE metric = 'cpu_usage_percent' GROUP BY host_id
""")


@query("inconsistent_identity", """
SELECT DISTINCT s.host_id, s.metric, s.host_name AS claimed_name FROM v_series s JOIN v_identity i USING (host_id)
WHERE s.metric <> 'cpu_usage_percent' AND s.host_name IS DISTINCT FROM i.host_name
""")
def inconsistent_identity(spark, sf_dir):
    return clean.inconsistent_identity(domain.labelled_series(spark, sf_dir))


@query("query_errors", """
SELECT host_id, string_agg(metric, ',' ORDER BY metric) AS query_errors FROM (
SELECT DISTINCT s.host_id, s.metric FROM v_series s JOIN v_identity i USING (host_id)
WHERE s.metric <> 'cpu_usage_percent' AND s.host_name <> i.host_name) GROUP BY host_id
""")
def query_errors(spark, sf_dir):
    return clean.query_errors(domain.labelled_series(spark, sf_dir))


@query("aligned_ticks", "SELECT DISTINCT host_id, date_trunc('hour', ts) AS tick FROM v_events")
def aligned_ticks(spark, sf_dir):
    return clean.due_ticks(domain.events(spark, sf_dir), "ts", ["host_id"], SPARSE.tick)


@query("poll_status", """
SELECT check_id, CASE WHEN status_code = 200 THEN 'success' WHEN status_code IS NOT NULL THEN 'non_2xx'
  WHEN check_id % 4 = 0 THEN 'timeout' WHEN check_id % 4 = 1 THEN 'connection_refused'
  WHEN check_id % 4 = 2 THEN 'dns_failure' ELSE 'unknown' END AS poll_status FROM v_checks
""")
def poll_status(spark, sf_dir):
    texts = F.array(
        *[F.lit(t) for t in ("Request timeout", "Cannot connect to host", "Name or service not known", "reset by peer")]
    )
    checks = domain.health_checks(spark, sf_dir).withColumn(
        "error_text", F.when(F.col("status_code").isNull(), F.element_at(texts, (F.col("check_id") % 4 + 1).cast("int")))
    )
    return checks.select("check_id", clean.poll_status().alias("poll_status"))


# ---- eligibility ---------------------------------------------------------------------------------


def stored_windows(spark, sf_dir):
    """Feature windows as stored, some damaged on purpose."""
    good = features.feature_windows(domain.samples(spark, sf_dir), SPARSE, domain.as_of(spark, sf_dir))
    hour = F.hour("window_end")
    damaged = F.transform("feature_values", lambda v, i: F.when(i == 0, F.lit(float("inf"))).otherwise(v))
    return (
        good.withColumn("schema_hash", F.when(hour == 5, "other").otherwise(F.col("schema_hash")))
        .withColumn("feature_values", F.when(hour == 7, damaged).otherwise(F.col("feature_values")))
        .withColumn("features", F.map_from_arrays("feature_names", "feature_values"))
    )


@query("training_eligible", f"""
SELECT host_id, {ts('end_us')} AS window_end, CASE
  WHEN end_us > now_us - 5 * 86400000000 THEN 'future_feature_window'
  WHEN hour({ts('end_us')}) = 5 THEN 'schema_mismatch'
  WHEN hour({ts('end_us')}) = 7 THEN 'nonfinite_feature'
  WHEN coverage < 0.8 * 86400 THEN 'insufficient_feature_history' END AS skip_reason
FROM v_coverage, v_now
""")
def training_eligible(spark, sf_dir):
    contract = features.Contract.of(SPARSE)
    cutoff = plus(domain.as_of(spark, sf_dir), -5 * 86400)
    windows = clean.assert_causal_quality(stored_windows(spark, sf_dir))
    return windows.select("host_id", "window_end", clean.training_skip_reason(contract, cutoff).alias("skip_reason"))


@query("score_eligible", f"""
SELECT host_id, {ts('end_us')} AS window_end, (now_us - end_us) / 1000000.0 BETWEEN 0 AND 864000
  AND hour({ts('end_us')}) <> 5 AND coverage BETWEEN 0.8 * 86400 AND 86400 AS eligible
FROM v_coverage, v_now
""")
def score_eligible(spark, sf_dir):
    contract = features.Contract.of(SPARSE)
    windows = stored_windows(spark, sf_dir)
    ok = clean.score_eligible(contract, domain.as_of(spark, sf_dir), 10 * 86400)
    return windows.select("host_id", "window_end", ok.alias("eligible"))


