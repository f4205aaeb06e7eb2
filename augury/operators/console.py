"""Fleet views over the current state: latest rows per key, joins and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions.clock import plus, seconds_between
from augury.functions.intervals import overlap_join
from augury.functions.ordered import Scan, running, with_previous
from augury.functions.ranked import latest_per_key, top_per_key
from augury.settings import Params


def host_status(now: Column, p: Params, active: str = "active_failure") -> Column:
    """Observed health: an open failure degrades, no fresh probe is unknown, else the last probe counts."""
    age = seconds_between(now, "observed_at")
    return (
        F.when(F.coalesce(active, F.lit(False)), "degraded")
        .when(F.col("observed_at").isNull() | ~age.between(0, p.freshness), "unknown")
        .when(F.col("breached"), "degraded")
        .otherwise("healthy")
    )


def fleet(hosts: DataFrame, predictions: DataFrame, probes: DataFrame, events: DataFrame, models: DataFrame, now: Column, p: Params) -> DataFrame:
    """Every host with its newest score, newest probe, open failure and model threshold."""
    score = latest_per_key(
        predictions.select("host_id", "predicted_at", "probability", "model_id", "prediction_id"),
        ["host_id"],
        ["predicted_at", "prediction_id"],
    )
    probe = latest_per_key(
        probes.select("host_id", "observed_at", "breached", "outcome", "probe_id"), ["host_id"], ["observed_at", "probe_id"]
    )
    failing = events.filter(F.col("recovered_at").isNull()).select("host_id").distinct().withColumn("active_failure", F.lit(True))
    age = seconds_between(now, "predicted_at")
    fresh = F.coalesce(age.between(0, p.freshness), F.lit(False))
    return (
        hosts.join(score, "host_id", "left")
        .join(probe, "host_id", "left")
        .join(failing, "host_id", "left")
        .join(models.select("model_id", "threshold"), "model_id", "left")
        .withColumn("status", host_status(now, p))
        .withColumn("prediction_age_seconds", age)
        .withColumn("prediction_fresh", fresh)
        .withColumn("high_risk", fresh & F.coalesce(F.col("probability") >= F.col("threshold"), F.lit(False)))
    )


def hosts_view(fleet_rows: DataFrame, p: Params, after: str | None = None) -> DataFrame:
    """A page of the fleet in the order of host_id: the first ``host_limit`` hosts behind ``after``, the last host
    of the page before.  Pages together hold every host."""
    behind = fleet_rows if after is None else fleet_rows.filter(F.col("host_id") > after)
    return behind.orderBy("host_id").limit(p.host_limit)


def host_counts(fleet_rows: DataFrame) -> DataFrame:
    return fleet_rows.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.when(F.col("status") == "healthy", 1).otherwise(0)).alias("healthy"),
        F.sum(F.when(F.col("high_risk"), 1).otherwise(0)).alias("high_risk"),
    )


def useful_lead(warning: Column, onset: str, p: Params) -> Column:
    """Lead of a warning; only one made after its score and early enough, within its forecast, counts."""
    lead = seconds_between(onset, warning)
    until = plus("window_end", p.horizon)
    counts = (
        (warning >= F.col("predicted_at"))
        & (lead >= p.min_lead)
        & (F.col("window_end") <= F.col(onset))
        & (F.col(onset) <= until)
    )
    return F.when(counts, lead)


def experiment_view(experiments: DataFrame, events: DataFrame, predictions: DataFrame, alerts: DataFrame, models: DataFrame, p: Params, lookback: int) -> DataFrame:
    """What each experiment caused, and whether it was foreseen."""
    first = latest_first(events)
    onsets = experiments.select("experiment_id").join(first, "experiment_id")
    spans = predictions.join(models.select("model_id", "threshold"), "model_id").select(
        "host_id",
        "prediction_id",
        "predicted_at",
        "probability",
        "threshold",
        "window_end",
        plus("window_end", lookback).alias("look_end"),
    )
    candidates = overlap_join(
        onsets, spans, ["host_id"], ("onset", "onset"), ("window_end", "look_end"), bucket_seconds=lookback
    ).filter(F.col("predicted_at") <= plus("onset", -p.min_lead))
    scored = candidates.withColumn("lead", useful_lead(F.col("predicted_at"), "onset", p)).withColumn(
        "warns", F.col("probability") >= F.col("threshold")
    )
    # An incident's alerts belong to the score that opened it.
    sent = alerts.filter(F.col("status") == "delivered").groupBy("prediction_id").agg(
        F.min("delivered_at").alias("first_delivery"), F.array_sort(F.collect_set("delivered_at")).alias("deliveries")
    )
    joined = scored.join(sent, "prediction_id", "left")
    best = F.array_max(F.transform("deliveries", lambda d: useful_lead(d, "onset", p)))
    warned = F.col("warns") & F.col("lead").isNotNull()
    measured = joined.groupBy("experiment_id").agg(
        F.count("lead").alias("eligible_scores"),
        F.count(F.when(warned, 1)).alias("warnings"),
        F.max(F.when(warned, F.col("lead"))).alias("warning_lead_seconds"),
        F.max(F.when(warned, best)).alias("alert_lead_seconds"),
    )
    out = experiments.join(first.select("experiment_id", "event_id", "onset"), "experiment_id", "left").join(
        measured, "experiment_id", "left"
    )
    coverage = (
        F.when(F.col("event_id").isNull(), "No observed failure")
        .when(F.col("alert_lead_seconds").isNotNull(), "Alert delivered")
        .when(F.coalesce("warnings", F.lit(0)) > 0, "Warning recorded")
        .when(F.coalesce("eligible_scores", F.lit(0)) > 0, "No advance warning")
        .otherwise("No eligible scores")
    )
    return out.withColumn("coverage", coverage).withColumn(
        "eligible_scores", F.coalesce("eligible_scores", F.lit(0))
    )


def latest_first(events: DataFrame) -> DataFrame:
    """Earliest failure of each experiment."""
    return (
        events.filter(F.col("experiment_id").isNotNull())
        .groupBy("experiment_id")
        .agg(F.min(F.struct("observed_at", "event_id", "host_id")).alias("e"))
        .select("experiment_id", F.col("e.event_id").alias("event_id"), F.col("e.host_id").alias("host_id"), F.col("e.observed_at").alias("onset"))
    )


def incident_view(statuses: DataFrame, alerts: DataFrame, proposals: DataFrame, limit: int) -> DataFrame:
    """Incidents with their newest alerts and proposals nested, at most ``limit`` of each."""
    def nested(frame: DataFrame, created: str, key: str, columns: list[str], name: str) -> DataFrame:
        newest = top_per_key(frame, ["incident_id"], [F.col(created).desc(), F.col(key).desc()], limit)
        rows = F.sort_array(F.collect_list(F.struct(created, key, *columns)), asc=False)
        return newest.groupBy("incident_id").agg(rows.alias(name))

    return statuses.join(
        nested(alerts, "created_at", "alert_id", ["channel", "status"], "alerts"), "incident_id", "left"
    ).join(nested(proposals, "valid_until", "proposal_id", ["runbook"], "proposals"), "incident_id", "left")


def snapshot_totals(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in tables.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def telemetry_status(samples: DataFrame, now: Column, p: Params) -> DataFrame:
    """Per host: age of the newest sample and whether that is fresh."""
    age = seconds_between(now, "last_ts")
    return samples.groupBy("host_id").agg(F.max("ts").alias("last_ts")).select(
        "host_id",
        age.alias("sample_age_seconds"),
        F.when(age.between(0, p.freshness), "available").otherwise("stale").alias("status"),
    )


def inference_status(predictions: DataFrame, now: Column, p: Params) -> DataFrame:
    """Newest score overall and whether scoring is current; one row even without scores."""
    newest = predictions.agg(
        F.max(F.struct("predicted_at", "prediction_id", "host_id", "probability", "model_id")).alias("n")
    )
    age = seconds_between(now, "n.predicted_at")
    status = (
        F.when(F.col("n").isNull(), "no_predictions")
        .when(age.between(0, p.freshness), "recent_scores_available")
        .otherwise("stale")
    )
    return newest.select(status.alias("status"), "n.prediction_id", "n.host_id", "n.probability", age.alias("age_seconds"))


def chart_segments(points: DataFrame, keys: list[str], at: str, tie: str, p: Params, default_gap: float = 60.0) -> DataFrame:
    """Break a drawn series wherever a gap exceeds 2.5 times its upper median gap.

    The median is exact: gaps collapse to (gap, count) before their running count is taken.
    """
    seen = with_previous(points, keys, at, [tie], [], slice_seconds=p.slice_seconds)
    gap = seconds_between(at, f"prev.{at}")
    stepped = seen.withColumn("gap", gap).drop("prev")
    counted = stepped.filter(F.col("gap") > 0).groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("c"))
    # Gap magnitudes are cut in ranges of the logarithm so that no series is sorted in one task.
    ranged = counted.withColumn("__b", F.floor(F.log2("gap") * 8))
    totals = ranged.groupBy(*keys, "__b").agg(F.sum("c").alias("__t"))
    over = Window.partitionBy(*keys).orderBy("__b")
    shifts = totals.select(
        *keys, "__b",
        F.coalesce(F.sum("__t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__c"),
        F.sum("__t").over(Window.partitionBy(*keys)).alias("__all"),
    )
    local = Window.partitionBy(*keys, "__b").orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("__s", F.sum("c").over(local)).join(shifts, [*keys, "__b"])
    reached = F.col("__s") + F.col("__c")
    # Index n/2 (from 0) is the first gap whose running count exceeds n/2.
    median = placed.filter(reached > F.floor(F.col("__all") / 2)).groupBy(*keys).agg(F.min("gap").alias("median_gap"))
    limit = F.coalesce("median_gap", F.lit(default_gap)) * 2.5
    joined = stepped.join(median, keys, "left")
    breaks = F.coalesce(F.col("gap") > limit, F.lit(True))
    return running(
        joined, keys, at, [tie], {"segment": Scan("sum", F.when(breaks, 1).otherwise(0))}, slice_seconds=p.slice_seconds
    ).drop("gap", "median_gap")


def text_filter(frame: DataFrame, text: str, columns: list[str], **equals) -> DataFrame:
    """Rows whose joined columns contain the text, ignoring case, with equal status columns."""
    joined = F.lower(F.concat_ws(" ", *columns))
    out = frame.filter(joined.contains(text.lower()))
    for name, value in equals.items():
        out = out.filter(F.col(name) == value)
    return out


def score_sparkline(predictions: DataFrame, n: int = 40) -> DataFrame:
    """Last ``n`` scores per host, numbered in ascending time."""
    newest = top_per_key(predictions, ["host_id"], [F.col("predicted_at").desc(), F.col("prediction_id").desc()], n)
    return newest.select("host_id", "prediction_id", "predicted_at", "probability", F.col("rank").alias("newest_rank"))


def duplicate_groups(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def collection_progress(inputs: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    counted = [
        f.agg(F.count(F.lit(1)).alias("rows"), F.max(c).alias("newest")).select(F.lit(n).alias("name"), "rows", "newest")
        for n, (f, c) in inputs.items()
    ]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def window_audit(windows: DataFrame, contract, now: Column, max_age: int, bound: float) -> DataFrame:
    """Audit the three newest windows of each host: counts of violated expectations."""
    newest = top_per_key(windows, ["host_id"], [F.col("window_end").desc()], 3)
    first = F.col("rank") == 1
    cpu = F.col("features")["cpu_usage_percent.latest"]
    inside = F.forall(
        F.map_values("quality"),
        lambda q: (q["count"] == 0)
        | ((q["first_ts"] > F.col("window_start")) & (q["first_ts"] <= q["last_ts"]) & (q["last_ts"] <= F.col("window_end"))),
    )
    def broken(c: Column) -> Column:
        return F.max(F.when(first & ~F.coalesce(c, F.lit(False)), 1).otherwise(0))

    return newest.groupBy("host_id").agg(
        F.count(F.lit(1)).alias("windows"),
        F.max("window_end").alias("latest_end"),
        broken(seconds_between(now, "window_end") < max_age).alias("stale"),
        broken(F.col("schema_hash") == contract.digest).alias("contract"),
        broken(cpu.between(0.0, bound)).alias("cpu_bounds"),
        broken(inside).alias("quality_outside"),
    )


def history(frame: DataFrame, keys: list[str], at: str, tie: str, *, last: int | None = None, since: Column | None = None) -> DataFrame:
    """Last ``n`` rows per key, or all rows since an instant."""
    out = frame
    if since is not None:
        out = out.filter(F.col(at) >= since)
    if last is not None:
        out = top_per_key(out, keys, [F.col(at).desc(), F.col(tie).desc()], last).drop("rank")
    return out


def open_incident(incidents: DataFrame) -> DataFrame:
    """Newest unresolved incident per service."""
    return latest_per_key(
        incidents.filter(F.col("resolved_at").isNull()), ["service_name"], ["started_at", "incident_id"]
    )


def incidents_since(incidents: DataFrame, since: Column | None = None, service: str | None = None, limit: int = 100) -> DataFrame:
    out = incidents
    if service is not None:
        out = out.filter(F.col("service_name") == service)
    if since is not None:
        out = out.filter(F.col("started_at") >= since)
    return out.orderBy(F.col("started_at").desc(), F.col("incident_id").desc()).limit(limit)


