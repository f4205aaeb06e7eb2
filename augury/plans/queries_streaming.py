"""Streaming queries: replay the table through a stream and return what reached the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.functions.clock import r6
from augury.operators import clean
from augury.operators.features import STATS
from augury.plans import oracle, oracle_events, queries_incidents  # noqa: F401
from augury.plans.catalog import query
from augury.plans.oracle import r6 as o6
from augury.plans.oracle import ts
from augury.plans.queries_features import _digits
from augury.settings import SPARSE
from augury.sources import domain, tables
from augury.sources.event_log import EventLog, append_stream
from augury.streaming import pipelines as st

DELAY = 3600
# Watermarks have milliseconds.
PASSED = f"({{}} // 1000 * 1000 - {DELAY * 10**6})"


def replay(spark, frame, name: str):
    """Run a stream to its end into files below the shared folder, and read them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    path = tables.scratch_path(spark, name)
    st.run_once(frame, f"{path}/rows", f"{path}/progress")
    return spark.read.schema(frame.schema).parquet(f"{path}/rows")


@query("features_stream", f"""
SELECT host_id, metric, {ts('end_us')} AS window_end, {', '.join(f'{o6(chr(34) + c + chr(34), _digits(c))} AS "{c}"' for c in STATS)}
FROM v_stats, v_now WHERE end_us <= now_us - 1 - {DELAY * 10**6}
""")
def features_stream(spark, sf_dir):
    samples = domain.as_samples(domain.events_stream(spark, sf_dir))
    stats = replay(spark, st.feature_stats_stream(samples, SPARSE, DELAY), "features")
    return stats.select("host_id", "metric", "window_end", *[r6(c, _digits(c)).alias(c) for c in STATS])


@query("failure_events_stream", """
SELECT c.* FROM (SELECT host_id, event_id, 'failure' AS change, observed_at AS first_at, confirmed_at FROM v_raw_failures
UNION ALL SELECT host_id, event_id, 'recovery', recovered_at, recovery_confirmed_at FROM v_raw_failures WHERE recovered_at IS NOT NULL) c, v_now
WHERE epoch_us(confirmed_at) <= {PASSED}
""".replace("{PASSED}", PASSED.format("now_us")))
def failure_events_stream(spark, sf_dir):
    probes = clean.with_outcome(domain.as_probes(domain.events_stream(spark, sf_dir)), SPARSE.latency_slo)
    changes = replay(spark, st.failure_events_stream(probes, SPARSE, DELAY), "failures")
    return changes.select("host_id", "event_id", "change", "first_at", "confirmed_at")


oracle.cte("v_stream_incidents", f"""
SELECT o.host_id, 'i-' || c.prediction_id AS incident_id, c.p_us, c.predicted_at, c.closed_us, c.closed_as,
  (SELECT {PASSED.format("max(p_us)")} FROM v_seq) AS passed
FROM v_opened_alone o JOIN v_candidates c ON c.host_id = o.host_id AND c.p_us = o.p_us
""")


@query("incidents_stream", f"""
SELECT host_id, incident_id, 'opened' AS change, predicted_at AS at_time FROM v_stream_incidents WHERE p_us <= passed
UNION ALL
SELECT host_id, incident_id, closed_as, {ts('closed_us')} FROM v_stream_incidents
WHERE CASE WHEN closed_as = 'risk_cleared' THEN closed_us <= passed ELSE closed_us < passed END
""")
def incidents_stream(spark, sf_dir):
    # Scores are written by the scoring job and picked up as a stream.
    path = tables.scratch_path(spark, "scores")
    queries_incidents.predictions(spark, sf_dir).write.parquet(path)
    scores = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    changes = replay(spark, st.incidents_stream(scores, domain.MODEL_THRESHOLD, SPARSE, DELAY), "incidents")
    return changes.select("host_id", "incident_id", "change", "at_time")


@query("receipts_stream", """
SELECT idempotency_key, count(*) AS kept FROM (SELECT DISTINCT idempotency_key FROM v_receipts WHERE length(idempotency_key) BETWEEN 1 AND 128) GROUP BY 1
""")
def receipts_stream(spark, sf_dir):
    usable = domain.as_receipts(domain.events_stream(spark, sf_dir)).filter(F.length("idempotency_key").between(1, 128))
    first = replay(spark, st.dedupe_stream(usable, ["idempotency_key"], "received_at", 40 * 86400), "receipts")
    return first.groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("kept"))


@query("receipts_log", """
SELECT idempotency_key, received_at, channel, kind, receipt_id FROM v_receipts WHERE length(idempotency_key) BETWEEN 1 AND 128
QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY received_at, receipt_id) = 1
""")
def receipts_log(spark, sf_dir):
    """Receipts appended to a log by a stream that is started twice; the one kept is that of the batch."""
    receipts = domain.as_receipts(domain.events_stream(spark, sf_dir))
    path = tables.scratch_path(spark, "receipts-log")
    log = EventLog(spark, f"{path}/log", receipts.schema)
    for attempt in ("first", "restarted"):  # a lost checkpoint replays everything
        append_stream(receipts, log, f"{path}/{attempt}").awaitTermination()
    log.compact()
    return tables.dedupe_receipts(log.read().drop("commit"))


@query("enriched_stream", "SELECT s.event_id, s.host_id, m.service_job FROM v_samples s LEFT JOIN v_map m USING (host_id)")
def enriched_stream(spark, sf_dir):
    samples = domain.as_samples(domain.events_stream(spark, sf_dir)).select("event_id", "host_id")
    return replay(spark, st.enrich_stream(samples, domain.service_map(spark, sf_dir), "host_id"), "enriched").select(
        "event_id", "host_id", "service_job"
    )


@query("daily_stream", """
SELECT host_id, date_trunc('day', ts) AS day, count(*) AS "rows" FROM v_events, v_now
GROUP BY host_id, day HAVING max(now_us) - 3600000000 >= epoch_us(day) + 86400000000
""")
def daily_stream(spark, sf_dir):
    return replay(spark, st.daily_counts_stream(domain.events_stream(spark, sf_dir), "ts", DELAY), "daily")


@query("exactly_once_stream", """
SELECT event_id, host_id FROM v_samples
""")
def exactly_once_stream(spark, sf_dir):
    samples = domain.as_samples(domain.events_stream(spark, sf_dir)).select("event_id", "host_id")
    path = tables.scratch_path(spark, "once")
    for attempt in ("first", "restarted"):  # a lost checkpoint replays everything
        st.run_batches(samples, f"{path}/rows", f"{path}/{attempt}", ["event_id"]).awaitTermination()
    return st.read_batches(spark, f"{path}/rows", ["event_id"])
