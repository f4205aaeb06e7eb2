"""Cleaning, identity and eligibility of samples, probes and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.functions.clock import floor_to, is_finite, micros, seconds_between

SERIES = ["host_id", "metric"]


def clean_samples(samples: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Finite samples in ``(start, end]``, one per (host, metric, instant); conflicts are left out.

    Copies are collapsed by a partial aggregate before the shuffle.
    """
    kept = samples.filter(is_finite("value") & F.col("ts").isNotNull())
    if start is not None:
        kept = kept.filter(F.col("ts") > start)
    if end is not None:
        kept = kept.filter(F.col("ts") <= end)
    return (
        kept.groupBy(*SERIES, "ts")
        .agg(F.min("value").alias("value"), F.max("value").alias("__high"))
        .filter(F.col("value") == F.col("__high"))
        .drop("__high")
    )


def conflicting_samples(samples: DataFrame) -> DataFrame:
    """Instants of a series that carry more than one value."""
    return (
        samples.filter(is_finite("value"))
        .groupBy(*SERIES, "ts")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .filter(F.col("low") != F.col("high"))
    )


def fresh_hosts(samples: DataFrame, end: Column, freshness: int) -> DataFrame:
    """Hosts whose CPU series reaches within ``freshness`` seconds of ``end``."""
    return fresh_metrics(samples, end, freshness).filter(F.col("metric") == "cpu_usage_percent")


def fresh_metrics(samples: DataFrame, end: Column, freshness: int) -> DataFrame:
    last = samples.filter(F.col("ts") <= end).groupBy(*SERIES).agg(F.max("ts").alias("last_ts"))
    return last.filter(micros(end) - micros("last_ts") <= F.lit(freshness * 1_000_000))


def usable_series(samples: DataFrame, end: Column, freshness: int) -> DataFrame:
    """Fresh series of hosts that exist at ``end``, i.e. have a fresh CPU series."""
    fresh = fresh_metrics(samples, end, freshness)
    return fresh.join(fresh_hosts(samples, end, freshness).select("host_id"), "host_id", "left_semi")


def ambiguous_hosts(series: DataFrame) -> DataFrame:
    """Hosts announced by CPU series under more than one name or environment, or over-long ones."""
    cpu = series.filter(F.col("metric") == "cpu_usage_percent")
    identity = cpu.groupBy("host_id", "host_name", "environment").agg(F.count(F.lit(1)).alias("n"))
    too_long = (F.length("host_id") > 128) | (F.length("host_name") > 256) | (F.length("environment") > 32)
    return (
        identity.groupBy("host_id")
        .agg(F.count(F.lit(1)).alias("identities"), F.max(too_long).alias("too_long"))
        .filter((F.col("identities") > 1) | F.col("too_long"))
    )


def series_identity(series: DataFrame) -> DataFrame:
    """Identity of a host: the smallest (name, environment) its CPU series carries."""
    return (
        series.filter(F.col("metric") == "cpu_usage_percent")
        .groupBy("host_id")
        .agg(F.min(F.struct("host_name", "environment")).alias("identity"))
    )


def inconsistent_identity(series: DataFrame) -> DataFrame:
    """Optional metrics that name their host differently from its CPU series."""
    labels = (
        series.filter(F.col("metric") != "cpu_usage_percent")
        .select("host_id", "metric", F.struct("host_name", "environment").alias("claimed"))
        .distinct()
    )
    return (
        labels.join(series_identity(series), "host_id")
        .filter(~F.col("claimed").eqNullSafe(F.col("identity")))
        .select("host_id", "metric", F.col("claimed.host_name").alias("claimed_name"))
    )


def query_errors(series: DataFrame) -> DataFrame:
    """Sorted failed metrics per host: identity clashes and contradicting samples."""
    failed = inconsistent_identity(series).select("host_id", "metric")
    clashes = conflicting_samples(series).select("host_id", "metric")
    return (
        failed.unionByName(clashes)
        .groupBy("host_id")
        .agg(F.sort_array(F.collect_set("metric")).alias("errors"))
        .select("host_id", F.array_join("errors", ",").alias("query_errors"))
    )


def aligned_tick(now: str | Column, interval: int) -> Column:
    """Start of the current interval; emit only when newer than the previous tick."""
    return F.timestamp_micros(floor_to(micros(now), interval))


def due_ticks(times: DataFrame, at: str, keys: list[str], interval: int) -> DataFrame:
    """Distinct ticks in the order they become due."""
    return times.select(*keys, aligned_tick(at, interval).alias("tick")).distinct()


def label_select(series: DataFrame, equals: dict[str, str], matches: dict[str, str]) -> DataFrame:
    """``=`` and ``=~`` selectors; patterns are anchored at both ends."""
    out = series
    for name, value in equals.items():
        out = out.filter(F.col(name) == value)
    for name, pattern in matches.items():
        out = out.filter(F.col(name).rlike(f"^(?:{pattern})$"))
    return out


def classify_probe(status: str = "status_code", latency: str = "latency_seconds", slo: Column | float = 0.5) -> Column:
    limit = slo if isinstance(slo, Column) else F.lit(slo)
    return (
        F.when(F.col(status).isNull(), "service_unavailable")
        .when(F.col(status) >= 500, "http_error_slo_breach")
        .when(F.col(status) != 200, "unexpected_response")
        .when(F.col(latency) > limit, "latency_slo_breach")
        .otherwise("healthy")
    )


def with_outcome(probes: DataFrame, slo: float) -> DataFrame:
    outcome = classify_probe(slo=slo)
    return probes.withColumn("outcome", outcome).withColumn("breached", F.col("outcome") != "healthy")


def slo_recheck(probes: DataFrame, slo: float) -> DataFrame:
    """Re-evaluate recorded status and latency under the dataset's own objective."""
    healthy = F.coalesce((F.col("status_code") == 200) & (F.col("latency_seconds") <= slo), F.lit(False))
    return probes.withColumn("healthy", healthy)


def _quality_inside(start: str, end: str, quality: str) -> Column:
    """Every metric with samples has ``start < first <= last <= end``."""
    def ok(m: Column) -> Column:
        return (m["count"] == 0) | (
            (m["first_ts"] > F.col(start)) & (m["first_ts"] <= m["last_ts"]) & (m["last_ts"] <= F.col(end))
        )
    return F.forall(F.map_values(quality), ok)


def contract_violation(contract) -> Column:
    """Window written under another feature contract, or whose vector and map disagree."""
    names = F.array(*[F.lit(n) for n in contract.names])
    # A lookup reads the map from its start; a map in the order of the names needs none.
    in_order = F.map_keys("features") == F.col("feature_names")
    looked_up = F.when(in_order, F.map_values("features")).otherwise(
        F.transform("feature_names", lambda n: F.try_element_at("features", n))
    )
    same = (
        (F.col("schema_version") == contract.version)
        & (F.col("schema_hash") == contract.digest)
        & (F.col("feature_names") == names)
        & (F.size("features") == len(contract.names))
        & F.col("feature_values").eqNullSafe(looked_up)
    )
    return ~F.coalesce(same, F.lit(False))


def training_skip_reason(contract, as_of: Column) -> Column:
    """First reason a window may not be used for training, or null."""
    coverage = F.col("quality")["cpu_usage_percent"]["coverage_seconds"]
    nonfinite = F.exists("feature_values", lambda v: v.isNotNull() & ~is_finite(v))
    return (
        F.when(F.col("window_end") > as_of, "future_feature_window")
        .when(contract_violation(contract), "schema_mismatch")
        .when(nonfinite, "nonfinite_feature")
        .when(F.coalesce(coverage, F.lit(0.0)) < 0.8 * contract.window, "insufficient_feature_history")
    )


def assert_causal_quality(windows: DataFrame) -> DataFrame:
    """Fail the job when a window's quality mentions observations outside the window."""
    broken = ~F.coalesce(_quality_inside("window_start", "window_end", "quality"), F.lit(False))
    guard = F.when(broken, F.raise_error(F.lit("feature quality lies outside its window"))).otherwise(F.lit(True))
    return windows.filter(guard.cast("boolean"))


def score_eligible(contract, now: Column, max_age: int) -> Column:
    """Window may be scored now; anything malformed is simply not eligible."""
    age = seconds_between(now, "window_end")
    coverage = F.col("quality")["cpu_usage_percent"]["coverage_seconds"]
    verdict = (
        age.between(0, max_age)
        & ~contract_violation(contract)
        & is_finite(coverage)
        & coverage.between(0.8 * contract.window, contract.window)
        & _quality_inside("window_start", "window_end", "quality")
        & (seconds_between("window_end", "window_start") == contract.window)
    )
    return F.coalesce(verdict, F.lit(False))


def poll_status(expected: int = 200) -> Column:
    """Outcome of a plain health poll from its status code or error text."""
    text = F.lower("error_text")
    return (
        F.when(F.col("status_code") == expected, "success")
        .when(F.col("status_code").isNotNull(), "non_2xx")
        .when(text.contains("timeout"), "timeout")
        .when(text.contains("cannot connect") | text.contains("connection refused"), "connection_refused")
        .when(text.contains("name or service not known") | text.contains("nodename"), "dns_failure")
        .otherwise("unknown")
    )
