"""Future-failure labels with evidence of healthy observation.

A window ending at ``end`` is positive when a confirmed failure of its host starts in
``(end, end + horizon]``.  It is negative only when probes prove that nothing sustained happened;
otherwise the label is null with a reason.  The first matching reason wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions.clock import MICROS, floor_to, micros, plus, seconds_between
from augury.functions.intervals import overlap_join
from augury.functions.ordered import halo_chunks
from augury.settings import Params


def known_events(events: DataFrame, as_of: Column) -> DataFrame:
    return events.filter((F.col("observed_at") <= F.col("confirmed_at")) & (F.col("confirmed_at") <= as_of))


def event_evidence(windows: DataFrame, events: DataFrame, as_of: Column, p: Params, horizon: int, exclusion: int) -> DataFrame:
    """Add whether a failure is active or cooling down at ``end``, and the nearest future onset."""
    reach = known_events(events, as_of).select(
        "host_id",
        F.struct(F.col("observed_at").alias("onset"), "event_id", "experiment_id", "failure_type").alias("event"),
        plus("observed_at", -horizon).alias("reach_start"),
        # An open failure reaches every window up to the cutoff.
        F.greatest(F.coalesce(plus("recovered_at", exclusion), as_of), F.col("observed_at")).alias("reach_end"),
    )
    pairs = overlap_join(
        windows,
        reach,
        ["host_id"],
        ("end", "end"),
        ("reach_start", "reach_end"),
        # Open failures span many horizons; wide buckets keep their number small.
        bucket_seconds=max(p.horizon, p.slice_seconds),
        how="left",
    )
    upcoming = F.col("event.onset") > F.col("end")
    return pairs.groupBy(*windows.columns).agg(
        F.coalesce(F.max(~upcoming), F.lit(False)).alias("active"),
        F.min(F.when(upcoming, F.col("event"))).alias("next_event"),
    )


def observation_evidence(
    windows: DataFrame, probes: DataFrame, as_of: Column, p: Params, horizon: int, count: int, span: int
) -> DataFrame:
    """Add the probe coverage of ``[end, end + horizon (+ confirmation tail)]`` to each window.

    Windows and probes meet in time chunks that also hold the probes shortly before and one
    horizon after; inside a chunk they are interleaved by time once and looked up with carried
    values.  Nothing is multiplied by the number of probes inside a horizon.
    """
    tail = span if count > 1 else 0
    back = max(span, p.max_gap)
    ahead = horizon + tail + p.max_gap
    chunk = max(p.slice_seconds, 2 * ahead)
    order = Window.partitionBy("host_id", "chunk").orderBy("observed_at", "probe_id")
    seen = halo_chunks(
        probes.filter(F.col("observed_at") <= as_of).select(
            "host_id", "probe_id", "observed_at", "healthy", "known_criteria"
        ),
        "observed_at",
        chunk,
        before=p.max_gap + back,
        after=ahead,
    )
    run = ~F.col("healthy")
    for j in range(1, count):
        run = run & F.coalesce(~F.lag("healthy", j).over(order), F.lit(False))
    first = F.lag("observed_at", count - 1).over(order) if count > 1 else F.col("observed_at")
    run = run & (seconds_between("observed_at", first) <= span)
    # A probe without predecessor in reach starts after a gap.
    gap = F.coalesce(seconds_between("observed_at", F.lag("observed_at").over(order)) > p.max_gap, F.lit(True))
    marks = seen.select(
        "host_id",
        "chunk",
        F.col("observed_at").alias("at"),
        "probe_id",
        gap.alias("gap"),
        (~F.col("known_criteria")).alias("other"),
        F.when(run, first).alias("burst_first"),
    )
    # A mark is an observation, a burst (placed at its first probe) or one of three lookups.
    points = marks.select(
        "host_id",
        "chunk",
        "probe_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.col("at"), F.lit("probe").alias("kind"), "gap", "other"),
                    F.when(
                        F.col("burst_first").isNotNull(),
                        F.struct(F.col("burst_first").alias("at"), F.lit("burst").alias("kind"), "gap", "other"),
                    ),
                )
            )
        ).alias("m"),
    ).select("host_id", "chunk", "probe_id", "m.*", F.lit(0).alias("side"))
    future, cover = plus("end", horizon), plus("end", horizon + tail)
    carried = [c for c in windows.columns if c not in ("host_id", "end")]
    looks = windows.select(
        "host_id",
        "end",
        floor_to(micros("end"), chunk).alias("chunk"),
        F.explode(
            F.array(
                F.struct(F.col("end").alias("at"), F.lit("left").alias("kind")),
                F.struct(future.alias("at"), F.lit("future").alias("kind")),
                F.struct(cover.alias("at"), F.lit("cover").alias("kind")),
            )
        ).alias("l"),
        F.struct(*carried).alias("row"),
    ).select("host_id", "end", "chunk", "row", "l.*", F.lit(1).alias("side"))
    timeline = points.unionByName(looks, allowMissingColumns=True)

    before = (
        Window.partitionBy("host_id", "chunk")
        .orderBy("at", "side", "probe_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # At equal times lookups come after observations, in either direction.
    behind = (
        Window.partitionBy("host_id", "chunk")
        .orderBy(F.col("at").desc(), "side", F.col("probe_id").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    is_probe = F.col("kind") == "probe"
    looked = timeline.select(
        "*",
        F.max(F.when(is_probe, F.col("at"))).over(before).alias("last_probe"),
        F.max(F.when(is_probe & F.col("gap"), F.col("at"))).over(before).alias("last_gap"),
        F.max(F.when(is_probe & F.col("other"), F.col("at"))).over(before).alias("last_other"),
        F.max(F.when(F.col("kind") == "burst", F.col("at"))).over(before).alias("last_burst"),
        F.last(F.when(is_probe, F.struct("at", "gap", "other")), ignorenulls=True).over(behind).alias("next_probe"),
    ).filter(F.col("side") == 1)

    def of(kind: str, name: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(name)))

    grouped = looked.groupBy("host_id", "chunk", "end").agg(
        of("left", "last_probe").alias("left_at"),
        of("future", "last_burst").alias("burst_at"),
        of("cover", "last_gap").alias("gap_at"),
        of("cover", "last_other").alias("other_at"),
        of("cover", "next_probe").alias("right"),
        F.any_value("row").alias("row"),
    )
    return grouped.select(
        "host_id", "end", "left_at", "burst_at", "gap_at", "other_at", "right", *[F.col(f"row.{c}").alias(c) for c in carried]
    )


def label_windows(
    windows: DataFrame,
    events: DataFrame,
    probes: DataFrame,
    as_of: Column,
    p: Params,
    *,
    end: str = "window_end",
    horizon: int | None = None,
    exclusion: int | None = None,
    count: int | None = None,
    span: int | None = None,
) -> DataFrame:
    """Add label, reason and the matched failure to every window; (host, end) must be unique."""
    horizon = p.horizon if horizon is None else horizon
    exclusion = p.recovery_exclusion if exclusion is None else exclusion
    count = p.confirm_count if count is None else count
    span = p.confirm_span if span is None else span
    if horizon <= 0 or exclusion < 0 or count < 1 or span < 1:
        raise ValueError("invalid label durations")
    tail = span if count > 1 else 0
    target = windows.withColumn("end", F.col(end))
    with_events = event_evidence(target, events, as_of, p, horizon, exclusion)
    joined = observation_evidence(with_events, probes, as_of, p, horizon, count, span)

    future, cover = plus("end", horizon), plus("end", horizon + tail)
    right = F.col("right")
    gap = F.lit(p.max_gap * MICROS)
    covered = F.coalesce(
        (micros("end") - micros("left_at") <= gap) & (micros(right["at"]) - micros(cover) <= gap), F.lit(False)
    )
    # The bracket probe's own gap lies outside the slice; a gap counts strictly after it.
    has_gap = F.coalesce(F.col("gap_at") > F.col("left_at"), F.lit(False)) | right["gap"]
    foreign = F.coalesce(F.col("other_at") >= F.col("left_at"), F.lit(False)) | right["other"]
    degraded = F.coalesce(F.col("burst_at") >= F.col("left_at"), F.lit(False))
    reason = (
        F.when(F.col("active"), "active_failure_or_recovery")
        .when(F.col("next_event").isNotNull(), "confirmed_future_failure")
        .when(future > as_of, "right_censored")
        .when(cover > as_of, "right_censored_confirmation")
        .when(~covered, "incomplete_observation_coverage")
        .when(has_gap, "observation_gap")
        .when(foreign, "unknown_or_changed_criteria")
        .when(degraded, "unconfirmed_degradation")
        .otherwise("observed_healthy_horizon" if count == 1 else "observed_no_sustained_failure_horizon")
    )
    hit = F.col("label_reason") == "confirmed_future_failure"
    label = F.when(hit, 1).when(F.col("label_reason").startswith("observed_"), 0)
    return (
        joined.withColumn("label_reason", reason)
        .withColumn("label", label)
        .withColumn("failure_event_id", F.when(hit, F.col("next_event.event_id")))
        .withColumn("experiment_id", F.when(hit, F.col("next_event.experiment_id")))
        .withColumn("failure_type", F.when(hit, F.col("next_event.failure_type")))
        .withColumn("failure_onset", F.when(hit, F.col("next_event.onset")))
        .drop("end", "active", "next_event", "left_at", "burst_at", "gap_at", "other_at", "right")
    )


def input_health(windows: DataFrame, events: DataFrame, probes: DataFrame, as_of: Column, p: Params) -> DataFrame:
    """Label of the input span itself: every probe in the window must be healthy."""
    keyed = windows.select("host_id", "window_start").distinct()
    judged = label_windows(
        keyed, events, probes, as_of, p, end="window_start", horizon=p.window, exclusion=0, count=1
    )
    return judged.select(
        "host_id",
        "window_start",
        F.col("label").alias("input_label"),
        F.col("label_reason").alias("input_reason"),
    )


def healthy_inputs(labelled: DataFrame, health: DataFrame) -> DataFrame:
    """Windows with fully observed healthy input that do not precede a failure."""
    clean = health.filter(F.col("input_label") == 0).select("host_id", "window_start")
    return labelled.join(clean, ["host_id", "window_start"], "left_semi").filter(
        F.coalesce(F.col("label") != 1, F.lit(True))
    )


def skip_counts(unfit: DataFrame, labelled: DataFrame) -> DataFrame:
    """Windows left out by reason: unfit ones by their skip_reason, labelled ones by why they have no label."""
    reasons = unfit.select(F.col("skip_reason").alias("reason")).unionByName(
        labelled.filter(F.col("label").isNull()).select(F.col("label_reason").alias("reason"))
    )
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("windows"))
