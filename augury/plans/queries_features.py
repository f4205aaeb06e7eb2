"""Queries over samples and feature windows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from augury.functions.clock import r6
from augury.operators import clean
from augury.operators import features as ft
from augury.plans import queries_data  # noqa: F401  (relations its SQL uses)
from augury.plans.catalog import query
from augury.plans.oracle import r6 as o6, ts as ots
from augury.settings import SPARSE
from augury.sources import domain

STAT_KEYS = {
    "f_latest": ["latest"],
    "f_mean": ["mean"],
    "f_median": ["median"],
    "f_std": ["std"],
    "f_min_max": ["min", "max"],
    "f_delta": ["delta"],
    "f_pct_change": ["percentage_change"],
    "f_trend": ["linear_trend"],
    "f_rate": ["rate_of_change"],
    "f_ewma": ["ewma"],
    "f_rolling_var": ["rolling_variance"],
    "feature_stats": list(ft.STATS),
}


def _digits(stat: str) -> int:
    return 9 if stat in ("linear_trend", "rate_of_change") else 6


def stats(spark, sf_dir):
    return ft.feature_stats(domain.samples(spark, sf_dir), SPARSE, domain.as_of(spark, sf_dir))


def windows(spark, sf_dir):
    return ft.feature_windows(domain.samples(spark, sf_dir), SPARSE, domain.as_of(spark, sf_dir))


def _register(name: str, columns: list[str]) -> None:
    picked = ", ".join(f"{o6(chr(34) + c + chr(34), _digits(c))} AS \"{c}\"" for c in columns)

    @query(name, f"SELECT host_id, metric, {ots('end_us')} AS window_end, {picked} FROM v_stats")
    def run(spark, sf_dir):
        return stats(spark, sf_dir).select(
            "host_id", "metric", "window_end", *[r6(c, _digits(c)).alias(c) for c in columns]
        )


for _name, _columns in STAT_KEYS.items():
    _register(_name, _columns)


@query("sliding_windows", f"""
SELECT host_id, metric, {ots('end_us')} AS window_end, count(*) AS samples,
  {ots('min(t)')} AS first_ts, {ots('max(t)')} AS last_ts
FROM v_windows GROUP BY host_id, metric, end_us
""")
def sliding_windows(spark, sf_dir):
    placed = ft.sliding_windows(domain.samples(spark, sf_dir), SPARSE, domain.as_of(spark, sf_dir))
    return placed.groupBy("host_id", "chunk", "metric", "end_us").agg(
        F.count(F.lit(1)).alias("samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).select("host_id", "metric", F.timestamp_micros("end_us").alias("window_end"), "samples", "first_ts", "last_ts")


@query("finite_out", f"""
SELECT host_id, {ots('end_us')} AS window_end, count(*) AS metrics,
  {' + '.join(f'count("{s}")' for s in ft.STATS)} AS present
FROM v_stats GROUP BY host_id, end_us
""")
def finite_out(spark, sf_dir):
    present = sum((F.count(s) for s in ft.STATS[1:]), F.count(ft.STATS[0]))
    return (
        stats(spark, sf_dir)
        .groupBy("host_id", "chunk", "end_us")
        .agg(F.count(F.lit(1)).alias("metrics"), present.alias("present"))
        .select("host_id", F.timestamp_micros("end_us").alias("window_end"), "metrics", "present")
    )


def _scaled(name: str, digits: int = 9) -> str:
    return f"{o6(name, digits)} AS {name}"


@query("cross_signals", f"""
SELECT host_id, {ots('end_us')} AS window_end, {', '.join(_scaled(n) for n in ft.CROSS_SIGNALS)} FROM v_cross
""")
def cross_signals(spark, sf_dir):
    first = len(ft.METRICS) * len(ft.STATS)
    values = F.col("feature_values")
    return windows(spark, sf_dir).select(
        "host_id",
        "window_end",
        *[r6(values[first + i], 9).alias(n) for i, n in enumerate(ft.CROSS_SIGNALS)],
    )


@query("quality", f"""
SELECT q.*, coalesce(e.query_errors, '') AS query_errors, m.service_job FROM (
SELECT host_id, {ots('end_us')} AS window_end, metric, n AS "count",
  {ots('t0')} AS first_ts, {ots('tn')} AS last_ts,
  (tn - t0) / 1000000.0 AS coverage_seconds, (end_us - tn) / 1000000.0 AS age_seconds
FROM v_fresh
UNION ALL
SELECT host_id, {ots('end_us')}, metric, 0, NULL, NULL, 0.0, NULL
FROM v_cross, (SELECT unnest([{', '.join(f"'{m}'" for m in ft.METRICS)}]) AS metric) m
WHERE NOT EXISTS (SELECT 1 FROM v_fresh f WHERE f.host_id = v_cross.host_id AND f.end_us = v_cross.end_us AND f.metric = m.metric)) q
LEFT JOIN (SELECT host_id, string_agg(DISTINCT metric, ',' ORDER BY metric) AS query_errors FROM v_series JOIN v_identity USING (host_id)
  WHERE metric <> 'cpu_usage_percent' AND v_series.host_name <> v_identity.host_name GROUP BY host_id) e USING (host_id)
LEFT JOIN v_map m USING (host_id)
""")
def quality(spark, sf_dir):
    errors = clean.query_errors(domain.labelled_series(spark, sf_dir))
    rows = ft.with_origin(windows(spark, sf_dir), errors, domain.service_map(spark, sf_dir))
    told = rows.select("host_id", "window_end", "query_errors", "service_job", F.explode("quality").alias("metric", "q"))
    return told.select("host_id", "window_end", "metric", "q.*", "query_errors", "service_job")


@query("feature_vector", f"""
SELECT host_id, {ots('end_us')} AS window_end, feature, round(value, 6) + 0.0 AS value
FROM v_features WHERE value IS NOT NULL
""")
def feature_vector(spark, sf_dir):
    return (
        ft.long_features(windows(spark, sf_dir))
        .filter(F.col("value").isNotNull())
        .select("host_id", "window_end", "feature", r6("value").alias("value"))
    )


# The contract's canonical text, hashed by the other engine.
_CONTRACT = ft.Contract.of(SPARSE)
_TEXT = json.dumps({"version": _CONTRACT.version, "names": _CONTRACT.names, **ft.CONTRACT_TERMS}, sort_keys=True).replace("'", "''")


@query("schema_contract", f"""
SELECT '{_CONTRACT.version}' AS schema_version, sha256('{_TEXT}') AS schema_hash, CAST({len(_CONTRACT.names)} AS INTEGER) AS width,
  count(*) AS windows, true AS same_names FROM v_cross
""")
def schema_contract(spark, sf_dir):
    c = ft.Contract.of(SPARSE)
    return (
        windows(spark, sf_dir)
        .groupBy("schema_version", "schema_hash", F.size("feature_names").alias("width"))
        .agg(F.count(F.lit(1)).alias("windows"), F.min(F.col("feature_names") == F.array(*[F.lit(n) for n in c.names])).alias("same_names"))
    )
