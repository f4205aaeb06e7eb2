"""Probe streaks, failure events and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from augury.functions.clock import MICROS, micros, seconds_between
from augury.functions.intervals import overlap_join
from augury.functions.ordered import Scan, halo_chunks, islands, own_chunk, running
from augury.functions.ranked import latest_per_key
from augury.settings import Params


def _streak_window(p: Params) -> tuple[int, WindowSpec]:
    chunk = max(p.slice_seconds, 4 * max(p.confirm_span, p.max_gap))
    return chunk, Window.partitionBy("host_id", "chunk").orderBy("observed_at", "probe_id")


def confirmations(probes: DataFrame, p: Params) -> DataFrame:
    """Probes completing a run of equal outcomes (breached or healthy) within the allowed span."""
    n = p.confirm_count
    chunk, order = _streak_window(p)
    row = F.struct("observed_at", "probe_id", "breached", "outcome", "latency_seconds", "status_code")
    seen = halo_chunks(probes, "observed_at", chunk, before=p.confirm_span)
    for j in range(1, n):
        seen = seen.withColumn(f"prev_{j}", F.lag(row, j).over(order))
    run = [F.col(f"prev_{j}") for j in range(n - 1, 0, -1)] + [row]
    first = run[0]
    same = first.isNotNull()
    for earlier in run[:-1]:
        same = same & (earlier["breached"] == F.col("breached"))
    close = seconds_between("observed_at", first["observed_at"]) <= p.confirm_span
    parts = ("probe_id", "latency_seconds", "status_code")
    evidence = F.array(*[F.struct(*[r[c].alias(c) for c in parts]) for r in run])
    return seen.filter(own_chunk("observed_at", chunk) & same & close).select(
        "host_id",
        "breached",
        F.col("observed_at").alias("confirmed_at"),
        "probe_id",
        first["observed_at"].alias("first_at"),
        first["probe_id"].alias("first_probe_id"),
        first["outcome"].alias("first_outcome"),
        evidence.alias("evidence"),
    )


def breach_confirm(probes: DataFrame, p: Params) -> DataFrame:
    return confirmations(probes, p).filter("breached")


def recovery_confirm(probes: DataFrame, p: Params) -> DataFrame:
    return confirmations(probes, p).filter("NOT breached")


def failure_events(probes: DataFrame, p: Params) -> DataFrame:
    """Failures alternate with recoveries: a confirmation counts only if its kind differs from the
    one before it.  The first recovery without a failure does not count either."""
    recovery = F.when(~F.col("breached"), F.struct("first_at", "confirmed_at"))
    turns = running(
        confirmations(probes, p),
        ["host_id"],
        "confirmed_at",
        ["probe_id"],
        {
            "kind_before": Scan("last", "breached", inclusive=False),
            "recovery": Scan("last", recovery, inclusive=False, descending=True),
        },
        slice_seconds=p.slice_seconds,
    )
    # A failure starts where the kind turns; it ends with the next recovery confirmation.
    return turns.filter(F.col("breached") & ~F.coalesce("kind_before", F.lit(False))).select(
        F.concat(F.lit("f"), F.col("first_probe_id").cast("string")).alias("event_id"),
        "host_id",
        F.col("first_outcome").alias("failure_type"),
        F.col("first_at").alias("observed_at"),
        "confirmed_at",
        F.col("recovery.first_at").alias("recovered_at"),
        F.col("recovery.confirmed_at").alias("recovery_confirmed_at"),
        "first_probe_id",
        "evidence",
    )


def experiment_at(points: DataFrame, at: str, experiments: DataFrame, as_of: Column, p: Params) -> DataFrame:
    """Tag rows with the experiment running on their host, the earliest started if several."""
    spans = experiments.select(
        "host_id",
        "experiment_id",
        F.col("started_at").alias("span_start"),
        F.coalesce("ended_at", as_of).alias("span_end"),
    )
    hit = overlap_join(
        points, spans, ["host_id"], (at, at), ("span_start", "span_end"), bucket_seconds=p.slice_seconds, how="left"
    )
    return hit.groupBy(*points.columns).agg(
        F.min_by("experiment_id", F.struct("span_start", "experiment_id")).alias("experiment_id")
    )


def probe_experiment(probes: DataFrame, experiments: DataFrame, as_of: Column, p: Params) -> DataFrame:
    return experiment_at(probes, "observed_at", experiments, as_of, p)


def attributed_events(events: DataFrame, experiments: DataFrame, as_of: Column, p: Params) -> DataFrame:
    """Failure events with the experiment that was running at their first breach."""
    return experiment_at(events, "observed_at", experiments, as_of, p)


def active_experiments_at(points: DataFrame, experiments: DataFrame, at: str, p: Params, as_of: Column) -> DataFrame:
    """Experiments started at or before each point and not ended by then."""
    spans = experiments.select(
        "host_id",
        "experiment_id",
        "experiment_type",
        "experiment_status",
        F.col("started_at").alias("span_start"),
        # An experiment is over at its end instant.
        F.coalesce(F.timestamp_micros(micros("ended_at") - 1), as_of).alias("span_end"),
    )
    return overlap_join(
        points, spans, ["host_id"], (at, at), ("span_start", "span_end"), bucket_seconds=p.slice_seconds
    ).drop("span_end")


def experiment_outcome(experiments: DataFrame, events: DataFrame) -> DataFrame:
    """Closed experiments with the failure events they produced."""
    ids = events.filter(F.col("experiment_id").isNotNull()).groupBy("experiment_id").agg(
        F.sort_array(F.collect_list("event_id")).alias("event_ids")
    )
    closed = experiments.filter(F.col("ended_at").isNotNull())
    return closed.join(ids, "experiment_id", "left").select(
        "experiment_id",
        "host_id",
        F.col("event_ids").isNotNull().alias("degradation_confirmed"),
        F.coalesce(F.array_join("event_ids", ","), F.lit("")).alias("failure_event_ids"),
    )


def detection_delay(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "host_id",
        seconds_between("confirmed_at", "observed_at").alias("confirmation_seconds"),
        seconds_between("recovered_at", "observed_at").alias("outage_seconds"),
    )


def healthy_baseline(probes: DataFrame, as_of: Column, p: Params, *, max_gap: int, breaches: int, span: int) -> DataFrame:
    """Length of the covered tail since the last gap or confirmed breach run, per host.

    A probe completing ``breaches`` consecutive breaches within ``span`` empties the tail and is
    not part of it; a gap starts a new tail at the probe after it.
    """
    reach = max(span, max_gap)
    chunk = max(p.slice_seconds, 4 * reach)
    order = Window.partitionBy("host_id", "chunk").orderBy("observed_at", "probe_id")
    seen = halo_chunks(probes.select("host_id", "probe_id", "observed_at", "breached"), "observed_at", chunk, before=reach)
    burst = F.col("breached")
    for j in range(1, breaches):
        burst = burst & F.coalesce(F.lag("breached", j).over(order), F.lit(False))
    if breaches > 1:
        burst = burst & (seconds_between("observed_at", F.lag("observed_at", breaches - 1).over(order)) <= span)
    # No predecessor within reach is a gap as well; on the very first probe it changes nothing.
    gap = F.coalesce(seconds_between("observed_at", F.lag("observed_at").over(order)) > max_gap, F.lit(True))
    marked = (
        seen.withColumn("__burst", F.coalesce(burst, F.lit(False)))
        .withColumn("__gap", gap)
        .withColumn("__reset", F.col("__burst") | F.col("__gap"))
        .filter(own_chunk("observed_at", chunk))
    )
    numbered = islands(
        marked.select("host_id", "probe_id", "observed_at", "__burst", "__reset"),
        ["host_id"],
        "observed_at",
        ["probe_id"],
        F.col("__reset"),
        slice_seconds=p.slice_seconds,
    )
    tails = numbered.groupBy("host_id", "island").agg(
        F.min(F.when(~F.col("__burst"), F.col("observed_at"))).alias("tail_start"),
        F.max(F.when(~F.col("__burst"), F.col("observed_at"))).alias("tail_end"),
        F.count(F.when(~F.col("__burst"), 1)).alias("probes"),
    )
    last = latest_per_key(tails, ["host_id"], ["island"])
    length = F.coalesce(seconds_between("tail_end", "tail_start"), F.lit(0.0))
    fresh = F.coalesce(micros(as_of) - micros("tail_end") <= F.lit(max_gap * MICROS), F.lit(False))
    return last.select("host_id", "probes", length.alias("span_seconds"), fresh.alias("fresh"))
