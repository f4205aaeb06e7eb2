"""Queries over counters, histograms, gauges and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.functions.clock import r6
from augury.operators import clean, rates
from augury.plans import oracle
from augury.plans.catalog import query
from augury.plans.oracle import r6 as o6, ts
from augury.settings import SPARSE
from augury.sources import domain

STEP = SPARSE.rate_step


def _increments(name: str, source: str, by: str) -> None:
    oracle.cte(name, f"""
SELECT *, CASE WHEN value >= pv THEN value - pv ELSE value END AS inc FROM (
  SELECT *, lag(value) OVER w AS pv, lag(t) OVER w AS pt FROM {source}
  WINDOW w AS (PARTITION BY {by} ORDER BY t, event_id)) WHERE pt IS NOT NULL
""")


_increments("v_increments", "v_counters", "host_id, counter")
_increments("v_bucket_increments", "v_buckets", "host_id, le")
oracle.cte("v_grid", f"""
SELECT unnest(generate_series((min(t) // {STEP * 10**6}) * {STEP * 10**6}, (max(t) // {STEP * 10**6}) * {STEP * 10**6}, {STEP * 10**6})) AS g FROM v_events
""")


def _rate(name: str, source: str, keys: str, window: int) -> None:
    oracle.cte(name, f"""
SELECT {keys}, g, sum(inc) / {float(window)} AS rate, sum(inc) AS growth, count(*) AS steps,
  min(pt) AS first_us, max(t) AS last_us, arg_min(pv, t) AS first_value, arg_min(value - inc, t) AS base
FROM {source} JOIN v_grid ON t <= g AND pt > g - {window * 10**6} GROUP BY ALL
""")


_rate("v_rates", "v_increments", "host_id, counter", SPARSE.rate_window)
_rate("v_rates_12h", "v_increments", "host_id, counter", 43200)
_rate("v_bucket_rates", "v_bucket_increments", "host_id, le", SPARSE.rate_window)


def _quantile(name: str, source: str, keys: str) -> None:
    """Bucket quantile written with window functions."""
    oracle.cte(f"{name}_cum", f"""
SELECT *, max(rate) OVER (PARTITION BY {keys} ORDER BY le) AS cum,
  max(rate) OVER (PARTITION BY {keys}) AS total FROM {source}
""")
    oracle.cte(name, f"""
SELECT {keys}, CASE WHEN max(total) > 0 THEN CASE WHEN arg_min(le, le) FILTER (WHERE cum >= 0.95 * total) = CAST('inf' AS DOUBLE)
  THEN coalesce(max(le) FILTER (WHERE cum < 0.95 * total), 0.0)
  ELSE coalesce(max(le) FILTER (WHERE cum < 0.95 * total), 0.0)
    + (min(le) FILTER (WHERE cum >= 0.95 * total) - coalesce(max(le) FILTER (WHERE cum < 0.95 * total), 0.0))
    * (0.95 * max(total) - coalesce(max(cum) FILTER (WHERE cum < 0.95 * total), 0.0))
    / nullif(arg_min(cum, le) FILTER (WHERE cum >= 0.95 * total) - coalesce(max(cum) FILTER (WHERE cum < 0.95 * total), 0.0), 0) END END AS quantile
FROM {name}_cum GROUP BY {keys}
""")


_quantile("v_p95", "v_bucket_rates", "host_id, g")
oracle.cte("v_all_bucket_rates", "SELECT g, le, sum(rate) AS rate FROM v_bucket_rates GROUP BY g, le")
_quantile("v_all_p95", "v_all_bucket_rates", "g")


@query("counter_rate", f"""
SELECT host_id, counter, ts, value, CASE WHEN t > pt AND value >= pv THEN {o6('(value - pv) / ((t - pt) / 1000000.0)', 9)} END AS rate
FROM (SELECT *, lag(value) OVER w AS pv, lag(t) OVER w AS pt FROM v_counters
      WINDOW w AS (PARTITION BY host_id, counter ORDER BY t, event_id))
""")
def counter_rate(spark, sf_dir):
    return rates.counter_rate(domain.counters(spark, sf_dir), SPARSE).select(
        "host_id", "counter", "ts", "value", r6("rate", 9).alias("rate")
    )


def _service_rate(name: str, counter: str) -> None:
    @query(name, f"SELECT host_id, {ts('g')} AS at, {o6('rate', 9)} AS rate FROM v_rates WHERE counter = '{counter}'")
    def run(spark, sf_dir):
        summed = rates.summed_rate(
            domain.counters(spark, sf_dir), counter, ["host_id"], SPARSE, until=domain.as_of(spark, sf_dir)
        )
        return summed.select("host_id", "at", r6("rate", 9).alias("rate"))


_service_rate("request_rate", "requests_total")
_service_rate("error_rate", "errors_total")

_START = f"(first_us - (g - {SPARSE.rate_window * 10**6})) / 1000000.0"
_END = "(g - last_us) / 1000000.0"


@query("request_rate_extrapolated", f"""
SELECT host_id, "at", {o6(f'growth * (span + least(CASE WHEN to_first >= average * 1.1 THEN average / 2 ELSE to_first END, coalesce(zero, 1e18)) + CASE WHEN to_last >= average * 1.1 THEN average / 2 ELSE to_last END) / nullif(span, 0) / {float(SPARSE.rate_window)}', 9)} AS rate
FROM (SELECT *, span / steps AS average, CASE WHEN growth > 0 THEN span * first_value / growth END AS zero FROM (
  SELECT host_id, {ts('g')} AS "at", growth, steps, first_value, (last_us - first_us) / 1000000.0 AS span, {_START} AS to_first, {_END} AS to_last
  FROM v_rates WHERE counter = 'requests_total'))
""")
def request_rate_extrapolated(spark, sf_dir):
    summed = rates.summed_rate(
        domain.counters(spark, sf_dir),
        "requests_total",
        ["host_id"],
        SPARSE,
        mode="extrapolated",
        until=domain.as_of(spark, sf_dir),
    )
    return summed.select("host_id", "at", r6("rate", 9).alias("rate"))


def _bucket_rates(spark, sf_dir):
    return rates.windowed_rate(
        domain.buckets(spark, sf_dir), ["host_id", "le"], SPARSE, until=domain.as_of(spark, sf_dir)
    )


@query("latency_p95", f"SELECT host_id, {ts('g')} AS at, {o6('quantile')} AS p95 FROM v_p95")
def latency_p95(spark, sf_dir):
    per_bound = _bucket_rates(spark, sf_dir)
    return rates.bucket_quantile(per_bound, ["host_id", "at"], 0.95).select(
        "host_id", "at", r6("quantile").alias("p95")
    )


@query("dash_p95", f"SELECT {ts('g')} AS at, {o6('quantile')} AS p95 FROM v_all_p95")
def dash_p95(spark, sf_dir):
    summed = _bucket_rates(spark, sf_dir).groupBy("at", "le").agg(F.sum("rate").alias("rate"))
    return rates.bucket_quantile(summed, ["at"], 0.95).select("at", r6("quantile").alias("p95"))


@query("dash_rates", f"""
SELECT counter, {ts('g')} AS at, {o6('sum(rate)', 9)} AS rate FROM v_rates_12h GROUP BY counter, g
""")
def dash_rates(spark, sf_dir):
    per_series = rates.windowed_rate(
        domain.counters(spark, sf_dir),
        ["host_id", "counter"],
        SPARSE,
        window=43200,
        until=domain.as_of(spark, sf_dir),
    )
    return per_series.groupBy("counter", "at").agg(r6(F.sum("rate"), 9).alias("rate"))


@query("sample_age", f"""
SELECT host_id, metric, (now_us - max(t)) / 1000000.0 AS age_seconds FROM v_samples, v_now
GROUP BY host_id, metric, now_us HAVING arg_max(value, t) > 0
""")
def sample_age(spark, sf_dir):
    return rates.sample_age(domain.samples(spark, sf_dir), domain.as_of(spark, sf_dir))


@query("target_up", """
SELECT 'job-' || host_id AS job, CASE WHEN arg_max(coalesce(status_code, -1), (t, probe_id)) = -1 THEN 0 ELSE 1 END AS up
FROM v_probes WHERE regexp_full_match('job-' || host_id, 'job-h[0-4]') GROUP BY host_id
""")
def target_up(spark, sf_dir):
    return rates.target_up(domain.probes(spark, sf_dir), "job-h[0-4]")


@query("gauge_latest", """
SELECT host_id, metric, arg_max(value, (t, event_id)) AS value, max(ts) AS ts FROM v_samples GROUP BY host_id, metric
""")
def gauge_latest(spark, sf_dir):
    return rates.gauge_latest(domain.samples(spark, sf_dir))


_BOUNDS = domain.BUCKET_BOUNDS[:-1]


@query("http_rollup", f"""
SELECT CASE WHEN method IN ('GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS') THEN method ELSE 'OTHER' END AS method,
  coalesce(route, 'unmatched') AS route, status_code, count(*) AS requests,
  count(*) FILTER (WHERE status_code >= 400) AS errors, {o6('sum(duration_seconds)')} AS duration_sum,
  {', '.join(f'count(*) FILTER (WHERE duration_seconds <= {b}) AS le_{i}' for i, b in enumerate(_BOUNDS))}
FROM v_requests WHERE route IS NULL OR route <> '/metrics' GROUP BY 1, 2, 3
""")
def http_rollup(spark, sf_dir):
    return rates.http_rollup(domain.requests(spark, sf_dir), _BOUNDS).withColumn("duration_sum", r6("duration_sum"))


@query("inflight", f"""
SELECT host_id, request_id, ts, change, CAST(sum(change) OVER (PARTITION BY host_id ORDER BY ts, change, request_id) AS BIGINT) AS inflight
FROM (SELECT host_id, request_id, started_at AS ts, 1 AS change FROM v_requests
      UNION ALL SELECT host_id, request_id, {ts('t + CAST(round(duration_seconds * 1000000) AS BIGINT)')}, -1 FROM v_requests)
""")
def inflight(spark, sf_dir):
    return rates.inflight(domain.requests(spark, sf_dir), SPARSE)


@query("changing_series", """
SELECT host_id, metric, count(DISTINCT value) > 1 AS changing, count(*) AS samples FROM v_samples, v_now
WHERE t >= now_us - 172800000000 GROUP BY host_id, metric
""")
def changing_series(spark, sf_dir):
    return rates.changing_series(domain.samples(spark, sf_dir), domain.as_of(spark, sf_dir), 172800)


@query("label_select", """
SELECT event_id, host_id, metric FROM v_series WHERE metric = 'cpu_usage_percent' AND regexp_full_match(host_name, 'node-h[13].*')
""")
def label_select(spark, sf_dir):
    return clean.label_select(
        domain.labelled_series(spark, sf_dir), {"metric": "cpu_usage_percent"}, {"host_name": "node-h[13].*"}
    ).select("event_id", "host_id", "metric")
