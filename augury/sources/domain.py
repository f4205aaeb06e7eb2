"""Telemetry views over the ``events`` table.

``events`` has one row per (user, instant) with a type, a value and a small JSON payload.  Read
as telemetry, fifteen neighbouring users form one host, and the event type together with the
parity of the payload number ``k`` names the metric.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augury.functions.clock import micros, plus
from augury.settings import SPARSE

USERS_PER_HOST = 15
# Long fractions keep interpolated quantiles away from rounding ties.
BUCKET_BOUNDS = (0.10271828, 0.25271828, 0.50271828, 1.00271828, 2.50271828, 5.00271828, float("inf"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return described(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as an unbounded input."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A file stream takes a folder or pattern, not a single file name.
    # The byte limit bounds what one host can bring into a micro-batch.
    source = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(8 << 30))
    return described(source.parquet(f"{sf_dir}/event[s].parquet"))


def described(raw: DataFrame) -> DataFrame:
    host_number = F.floor(F.col("user_id") / USERS_PER_HOST)
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("h"), host_number.cast("string")).alias("host_id"),
    )


def _as_of(spark: SparkSession, sf_dir: str) -> datetime:
    return events(spark, sf_dir).agg(F.max("ts").alias("t")).first()["t"]


def as_of(spark: SparkSession, sf_dir: str) -> Column:
    """Cutoff of every batch query: the newest instant in the data, as a literal.  Not remembered, so rows
    that arrive later count."""
    return F.lit(_as_of(spark, sf_dir))


def metric_name() -> Column:
    even = F.col("k") % 2 == 0
    kind = F.col("event_type")
    return (
        F.when(kind == "click", F.when(even, "cpu_usage_percent").otherwise("network_receive_bytes_per_second"))
        .when(kind == "view", F.when(even, "memory_usage_percent").otherwise("network_transmit_bytes_per_second"))
        .when(kind == "purchase", F.when(even, "disk_read_bytes_per_second").otherwise("disk_write_bytes_per_second"))
        .when(kind == "signup", F.lit("latency_p95_seconds"))
        .otherwise(F.lit("error_rate"))
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(events(spark, sf_dir))


def as_samples(described_events: DataFrame) -> DataFrame:
    value = (
        F.when(F.col("event_type") == "signup", F.col("value") * 0.01428571828)
        .when(F.col("event_type") == "error", F.col("value") * 0.001428571828)
        .otherwise(F.col("value"))
    )
    return described_events.select(
        "host_id", metric_name().alias("metric"), "ts", value.alias("value"), "event_id"
    )


def dirty_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with exact duplicates, contradicting copies and non-finite values mixed in."""
    base = samples(spark, sf_dir)
    shifts = F.filter(
        F.array(
            F.lit(0.0),
            F.when(F.col("event_id") % 50 == 0, 0.0),
            F.when(F.col("event_id") % 97 == 0, 1.0),
            F.when(F.col("event_id") % 101 == 0, float("nan")),
        ),
        lambda s: s.isNotNull(),
    )
    return base.withColumn("__shift", F.explode(shifts)).select(
        "host_id",
        "metric",
        "ts",
        (F.col("value") + F.col("__shift")).alias("value"),
        "event_id",
    )


def labelled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with the identity labels an exporter attaches, some of them wrong."""
    wrong = (F.col("event_id") % 211 == 0) & (F.col("metric") != "cpu_usage_percent")
    ambiguous = (F.col("event_id") % 1013 == 0) & (F.col("metric") == "cpu_usage_percent")
    return samples(spark, sf_dir).select(
        "*",
        F.concat(F.lit("node-"), F.col("host_id"), F.when(wrong | ambiguous, "-x").otherwise("")).alias("host_name"),
        F.lit("demo").alias("environment"),
    )


def service_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host to service job; two hosts of three run a service."""
    number = F.substring("host_id", 2, 12).cast("bigint")
    hosts = events(spark, sf_dir).select("host_id").distinct()
    return hosts.filter(number % 3 != 2).select(
        "host_id", F.concat(F.lit("job-"), F.col("host_id")).alias("service_job")
    )


def status_code() -> Column:
    return (
        F.when(F.col("k") < 2, F.lit(None).cast("int"))
        .when(F.col("event_type") == "error", 503)
        .when(F.col("k") == 50, 404)
        .otherwise(200)
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_probes(events(spark, sf_dir))


def as_probes(described_events: DataFrame) -> DataFrame:
    return described_events.select(
        "host_id",
        F.col("event_id").alias("probe_id"),
        F.col("ts").alias("observed_at"),
        (F.col("value") / 100.0).alias("latency_seconds"),
        status_code().alias("status_code"),
        # A few probes were taken under another objective.
        F.when(F.col("event_id") % 503 == 0, 1.0).otherwise(2.0).alias("slo_seconds"),
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = as_of(spark, sf_dir)
    late = (F.col("k") == 4) & (micros("ts") >= micros(newest) - F.lit(3 * 86400 * 1_000_000))
    kinds = F.array(*[F.lit(x) for x in ("latency", "http_503", "crash", "latency", "http_503")])
    return (
        events(spark, sf_dir)
        .filter((F.col("event_type") == "signup") & (F.col("k") < 5))
        .select(
            F.concat(F.lit("x"), F.col("event_id")).alias("experiment_id"),
            "host_id",
            F.element_at(kinds, F.col("k") + 1).alias("experiment_type"),
            F.col("ts").alias("started_at"),
            F.when(~late, plus("ts", (F.col("k") + 1).cast("bigint") * 3600)).alias("ended_at"),
            F.when(late, "running").otherwise("completed").alias("experiment_status"),
        )
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative request and error counters per host, reset at midnight."""
    day = Window.partitionBy("host_id", F.to_date("ts")).orderBy("ts", "event_id")
    counted = events(spark, sf_dir).select(
        "host_id",
        "ts",
        "event_id",
        F.count(F.lit(1)).over(day).alias("requests"),
        F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(day).alias("errors"),
    )
    return counted.select(
        "host_id",
        "ts",
        "event_id",
        F.explode(
            F.create_map(
                F.lit("errors_total"), F.col("errors"), F.lit("requests_total"), F.col("requests")
            )
        ).alias("counter", "value"),
    )


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative duration histogram per host, reset at midnight: one row per bound and scrape."""
    day = Window.partitionBy("host_id", F.to_date("ts")).orderBy("ts", "event_id")
    duration = F.col("value") / 100.0
    counted = events(spark, sf_dir).select(
        "host_id",
        "ts",
        "event_id",
        *[F.sum(F.when(duration <= b, 1).otherwise(0)).over(day).alias(f"b{i}") for i, b in enumerate(BUCKET_BOUNDS)],
    )
    pairs = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("value")) for i, b in enumerate(BUCKET_BOUNDS)]
    return counted.select("host_id", "ts", "event_id", F.inline(F.array(*pairs)))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = F.array(*[F.lit(m) for m in ("GET", "POST", "PUT", "DELETE", "TRACE")])
    return events(spark, sf_dir).select(
        "host_id",
        F.col("event_id").alias("request_id"),
        F.element_at(methods, (F.col("k") % 5 + 1)).alias("method"),
        F.when(F.col("k") == 7, F.lit(None))
        .when(F.col("k") == 8, F.lit("/metrics"))
        .otherwise(F.concat(F.lit("/"), F.col("event_type")))
        .alias("route"),
        F.coalesce(status_code(), F.lit(500)).alias("status_code"),
        F.col("ts").alias("started_at"),
        (F.col("value") / 100.0).alias("duration_seconds"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook deliveries; every seventh is a repeat of an earlier key, some keys are unusable."""
    return as_receipts(events(spark, sf_dir))


def as_receipts(described_events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    key = (
        F.when(e % 89 == 0, F.lit(""))
        .when(e % 97 == 0, F.rpad(F.lit("k"), 129, "k"))
        .otherwise(F.concat(F.lit("a"), (e - F.when(e % 7 == 0, F.pmod(e, F.lit(5))).otherwise(0)).cast("string")))
    )
    return described_events.select(
        F.col("ts").alias("received_at"),
        F.when(F.col("k") % 2 == 0, "generic").otherwise("slack").alias("channel"),
        key.alias("idempotency_key"),
        F.col("event_type").alias("kind"),
        e.alias("receipt_id"),
    )


def health_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = status_code()
    return events(spark, sf_dir).select(
        F.col("event_id").alias("check_id"),
        F.col("event_type").alias("service_name"),
        F.col("ts").alias("checked_at"),
        code.alias("status_code"),
        (F.col("value") * 10).alias("latency_ms"),
        F.coalesce(code == 200, F.lit(False)).alias("success"),
    )


def service_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy incident log: one row per outage sample of a service."""
    still_open = F.col("event_id") % 17 == 0
    return (
        events(spark, sf_dir)
        .filter(F.col("k") < 5)
        .select(
            F.col("event_id").alias("incident_id"),
            F.col("event_type").alias("service_name"),
            F.col("ts").alias("started_at"),
            F.when(~still_open, plus("ts", 600)).alias("resolved_at"),
            F.when(F.col("k") < 2, "unavailable").otherwise("slow").alias("failure_type"),
        )
    )


def drift_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .filter(F.col("k") == 42)
        .select(
            F.col("event_id").alias("drift_id"),
            F.col("event_type").alias("service_name"),
            F.col("ts").alias("recorded_at"),
            F.format_string('{"k": %d}', F.col("k")).alias("diff_json"),
        )
    )


def service_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .filter(F.col("k") % 10 == 0)
        .select(
            F.col("event_id").alias("prediction_id"),
            F.col("event_type").alias("service_name"),
            F.col("ts").alias("predicted_at"),
            (F.col("k") / 100.0).alias("failure_probability"),
            F.lit("legacy-1").alias("model_version"),
        )
    )


MODEL_ID = "model-1"
MODEL_THRESHOLD = 0.6


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered models: one row per decile of k, the active one first."""
    first = events(spark, sf_dir).groupBy((F.col("k") % 3).alias("n")).agg(F.min("ts").alias("created_at"))
    return first.select(
        F.concat(F.lit("model-"), (F.col("n") + 1).cast("string")).alias("model_id"),
        F.concat(F.lit("v"), (F.col("n") + 1).cast("string")).alias("version"),
        F.round(F.lit(MODEL_THRESHOLD) + F.col("n") / 10.0, 6).alias("threshold"),
        "created_at",
    )


def predictions(spark: SparkSession, sf_dir: str, params=SPARSE) -> DataFrame:
    """Scores of the active model: a fixed logistic over the probes of the last six hours."""
    tick_us = params.tick * 1_000_000
    reach = 6
    first = -F.floor(-micros("observed_at") / F.lit(tick_us)).cast("bigint") * F.lit(tick_us)
    newest = micros(as_of(spark, sf_dir))
    ticks = F.sequence(first, first + F.lit((reach - 1) * tick_us), F.lit(tick_us))
    bad = F.when(F.coalesce(F.col("status_code"), F.lit(0)) == 200, 0.0).otherwise(1.0)
    per_tick = (
        probes(spark, sf_dir)
        .select("host_id", "latency_seconds", bad.alias("bad"), F.explode(ticks).alias("end_us"))
        .filter(F.col("end_us") <= newest)
        .groupBy("host_id", "end_us")
        .agg(
            F.avg("latency_seconds").alias("latency"),
            F.avg("bad").alias("bad"),
            F.max("latency_seconds").alias("peak"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    logit = F.col("bad") * 4.0 + F.col("latency") * 1.5 - 2.0
    end = F.timestamp_micros("end_us")
    return per_tick.select(
        F.concat_ws("@", F.col("host_id"), F.floor(F.col("end_us") / 1_000_000).cast("string")).alias("prediction_id"),
        "host_id",
        F.lit(MODEL_ID).alias("model_id"),
        end.alias("window_end"),
        F.timestamp_micros(F.col("end_us") + (F.col("n") * 7 % 60) * 1_000_000).alias("predicted_at"),
        F.round(1.0 / (1.0 + F.exp(-logit)), 6).alias("probability"),
        F.round(F.col("peak") / 10.0 - 0.3, 6).alias("anomaly_score"),
        F.lit(params.horizon).alias("horizon_seconds"),
    )
