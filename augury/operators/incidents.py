"""Scores to incidents, alerts and proposals, as batch jobs over whole histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions.chain import NEVER, greedy_chain
from augury.functions.clock import MICROS, micros, plus, seconds_between
from augury.functions.cut import checkpointed
from augury.functions.intervals import overlap_join
from augury.functions.ordered import asof, halo_chunks, own_chunk, with_previous
from augury.functions.ranked import latest_per_key
from augury.operators.features import Contract
from augury.operators.probes import active_experiments_at
from augury.settings import Params

# Title and pattern are fixed wording; the checks are this library's own text.
TITLE = "Model threshold crossing requires review"
PATTERN = (
    "Supplied feature associations may indicate a change in behavior; they do not establish causation."
)
CHECKS = {
    "telemetry": "Check host telemetry freshness and gaps.",
    "service": "Check service latency, errors and reachability.",
    "model": "Review the model's recorded evaluation before acting.",
}
CHANNELS = ("generic", "slack")
RUNBOOK = "collect-diagnostics:v1"


def latest_window_per_host(windows: DataFrame, now: Column, max_age: int) -> DataFrame:
    """Newest window of each host that is at most ``max_age`` seconds old."""
    age = micros(now) - micros("window_end")
    return latest_per_key(windows.filter(age.between(0, max_age * MICROS)), ["host_id"], ["window_end"])


def unscored(windows: DataFrame, predictions: DataFrame, model_id: str) -> DataFrame:
    done = predictions.filter(F.col("model_id") == model_id).select("host_id", "window_end")
    return windows.join(done, ["host_id", "window_end"], "left_anti")


def crossing(predictions: DataFrame, threshold: float, p: Params) -> DataFrame:
    """Add whether a score reaches the threshold while the one before (by window) did not."""
    seen = with_previous(
        predictions,
        ["host_id", "model_id"],
        "window_end",
        ["prediction_id"],
        ["probability"],
        slice_seconds=p.slice_seconds,
    )
    before = F.col("prev.probability")
    high = F.col("probability") >= threshold
    return (
        seen.withColumn("high", high)
        .withColumn("crossing", high & (before.isNull() | (before < threshold)))
        .drop("prev")
    )


def forecast_validity(predictions: DataFrame, max_age: int) -> DataFrame:
    """Scores that were in time, with the instant their forecast ends."""
    late = seconds_between("predicted_at", "window_end") > max_age
    until = F.timestamp_micros(micros("window_end") + F.col("horizon_seconds").cast("bigint") * MICROS)
    return predictions.filter(~late).withColumn("valid_until", until)


def incident_candidates(predictions: DataFrame, threshold: float, p: Params) -> DataFrame:
    """Every high score as if it opened an incident: when would that incident be closed again?

    It closes with the score completing ``clear_count`` low ones within ``clear_span`` seconds,
    or unconfirmed one grace period after its forecast ends, whichever is first.  Both lie within
    one horizon, so chunks with that margin answer it.
    """
    ahead = p.horizon + p.expiry_grace + p.max_age
    chunk = max(p.slice_seconds, 2 * (ahead + p.clear_span))
    placed = halo_chunks(
        predictions.select("prediction_id", "host_id", "model_id", "window_end", "predicted_at", "probability"),
        "window_end",
        chunk,
        before=p.clear_span + p.tick,
        after=ahead + p.tick,
    )
    order = Window.partitionBy("host_id", "model_id", "chunk").orderBy("window_end", "prediction_id")
    low = F.col("probability") < threshold
    clears = low
    for j in range(1, p.clear_count):
        clears = clears & F.coalesce(F.lag("probability", j).over(order) < threshold, F.lit(False))
    span = seconds_between("window_end", F.lag("window_end", p.clear_count - 1).over(order))
    clears = clears & (span <= p.clear_span)
    marked = placed.withColumn("__clear", F.when(clears, F.col("predicted_at")))
    # Running minimum from the back; a frame open to the end would be recomputed for every row.
    later = (
        Window.partitionBy("host_id", "model_id", "chunk")
        .orderBy(F.col("window_end").desc(), F.col("prediction_id").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    expiry = plus("window_end", p.horizon + p.expiry_grace)
    first_clear = F.min("__clear").over(later)
    cleared = F.coalesce(first_clear <= expiry, F.lit(False))
    return (
        marked.withColumn("closed_at", F.when(cleared, first_clear).otherwise(expiry))
        .withColumn("closed_as", F.when(cleared, "risk_cleared").otherwise("forecast_expired_unconfirmed"))
        .filter(own_chunk("window_end", chunk) & ~low)
        .select("prediction_id", "host_id", "model_id", "window_end", "predicted_at", "probability", "closed_at", "closed_as")
    )


# What an incident keeps of the failure it is matched with.
MATCH = ("failure_event_id", "onset", "event_confirmed_at", "event_recovered_at", "matched_prediction_id", "prediction_lead_seconds")

MATCH_TYPE = (
    "struct<failure_event_id:string,onset:timestamp,event_confirmed_at:timestamp,event_recovered_at:timestamp,"
    "matched_prediction_id:string,prediction_lead_seconds:double>"
)


def settled_candidates(candidates: DataFrame, predictions: DataFrame, events: DataFrame, threshold: float, p: Params) -> DataFrame:
    """Add open_until, when the incident a candidate would open is resolved, and its match (null: none).

    A failure confirmed while the incident is open keeps it open until the failure recovers (null: not
    yet); otherwise it ends at closed_at.  An incident that was closed is matched no more.
    """
    named = candidates.withColumn("incident_id", F.concat(F.lit("i-"), "prediction_id"))
    high = predictions.filter(F.col("probability") >= threshold)
    own = attach_incidents(high, named, p, until="closed_at").filter(F.col("incident_id").isNotNull())
    found = match_failures(named, own, events, p).select("incident_id", F.struct(*MATCH).alias("match"))
    until = F.when(F.col("match").isNull(), F.col("closed_at")).when(
        F.col("match.event_recovered_at").isNotNull(), F.greatest("match.event_recovered_at", "predicted_at")
    )
    return named.join(found, "incident_id", "left").withColumn("open_until", until)


def open_incidents(predictions: DataFrame, threshold: float, p: Params, events: DataFrame | None = None) -> DataFrame:
    """At most one unresolved incident per host: a timely high score opens one unless one is still open.

    The scores that do are a greedy chain over the high scores of a host, resumed when the opened
    incident is resolved.  Of scores made at one instant the one of the earliest window counts.
    """
    candidates = incident_candidates(predictions, threshold, p)
    late = seconds_between("predicted_at", "window_end") > p.max_age
    first = Window.partitionBy("host_id", "predicted_at").orderBy("window_end", "prediction_id")
    candidates = candidates.filter(~late).withColumn("__first", F.row_number().over(first)).filter("__first = 1").drop("__first")
    candidates = checkpointed(candidates)
    if events is None:
        settled = candidates.withColumn("open_until", F.col("closed_at")).withColumn("match", F.lit(None).cast(MATCH_TYPE))
    else:
        settled = settled_candidates(candidates, predictions, events, threshold, p)
    at = micros("predicted_at")
    resume = F.when(F.col("open_until").isNull(), F.lit(NEVER)).otherwise(F.greatest(micros("open_until"), at) + 1)
    keyed = checkpointed(settled.withColumn("at", at).withColumn("resume", resume))
    opened = greedy_chain(
        keyed,
        "host_id",
        "at",
        "resume",
        # An outage that lasts longer is a long jump and widens no slice.
        reach_seconds=p.horizon + p.expiry_grace + p.max_age,
        slice_seconds=p.slice_seconds,
    )
    return keyed.join(opened, ["host_id", "at"]).select(
        F.concat(F.lit("i-"), F.col("prediction_id")).alias("incident_id"),
        "host_id",
        "model_id",
        "prediction_id",
        "window_end",
        "predicted_at",
        "probability",
        plus("window_end", p.horizon).alias("valid_until"),
        "closed_at",
        "closed_as",
        "open_until",
        "match",
    )


def matches_of(incidents: DataFrame) -> DataFrame:
    """The failures incidents were matched with as they were opened; the same rows as match_failures gives."""
    return incidents.filter(F.col("match").isNotNull()).select("incident_id", *[F.col(f"match.{c}").alias(c) for c in MATCH])


def attach_incidents(
    predictions: DataFrame, incidents: DataFrame, p: Params, until: str = "open_until", now: Column | None = None
) -> DataFrame:
    """Incident open on the host when each score was made, opened by it or before it.

    ``until`` names the end of a span; spans without an end reach to ``now``."""
    end = F.col(until) if now is None else F.coalesce(F.col(until), now)
    spans = incidents.select(
        "host_id",
        "incident_id",
        F.col("predicted_at").alias("opened_at"),
        F.coalesce(end, F.col("closed_at")).alias("open_until"),
        F.col("closed_at"),
    )
    return overlap_join(
        predictions,
        spans,
        ["host_id"],
        ("predicted_at", "predicted_at"),
        ("opened_at", "open_until"),
        bucket_seconds=p.horizon,
        how="left",
    )


def explain_mode(crossed: DataFrame, incidents: DataFrame, p: Params, now: Column | None = None) -> DataFrame:
    """Complete explanation for a new condition, a reference for a known one, none below threshold."""
    known = attach_incidents(crossed, incidents, p, now=now)
    already = F.col("incident_id").isNotNull() & (F.col("opened_at") < F.col("predicted_at"))
    mode = (
        F.when(F.col("high") & (~F.coalesce(already, F.lit(False)) | F.col("crossing")), "complete")
        .when(F.col("high"), "existing_condition")
        .otherwise("below_threshold")
    )
    return known.withColumn("explain_mode", mode).drop("opened_at", "open_until", "closed_at")


def recent_alerts(incidents: DataFrame, alerts: DataFrame, p: Params) -> DataFrame:
    """(incident_id, recent_alerts): the host's three newest alerts created before each incident, newest first."""
    told = alerts.select("host_id", "created_at", "alert_id", "status")
    once = with_previous(told, ["host_id"], "created_at", ["alert_id"], ["status"], name="p1", slice_seconds=p.slice_seconds)
    twice = with_previous(once, ["host_id"], "created_at", ["alert_id"], ["p1"], name="before", slice_seconds=p.slice_seconds)
    chained = twice.select("host_id", "created_at", "alert_id", "status", "p1", F.col("before.p1").alias("p2"))
    found = asof(
        incidents.select("host_id", "incident_id", "predicted_at"), chained, ["host_id"], "predicted_at", "created_at",
        ["alert_id", "status", "p1", "p2"], inclusive=False, tie="alert_id", slice_seconds=p.slice_seconds,
    )
    one = lambda c: F.when(c["alert_id"].isNotNull(), F.struct(c["alert_id"].alias("id"), c["status"].alias("status")))
    newest = F.array_compact(F.array(one(F.col("match")), one(F.col("match.p1")), one(F.col("match.p2"))))
    return found.select("incident_id", newest.alias("recent_alerts"))


def feature_changes(incidents: DataFrame, windows: DataFrame) -> DataFrame:
    """(incident_id, changes): name and value of every known difference and trend in the incident's window, by name."""
    # Places in the vector are fixed by the contract, so no map is built and no names are compared for the many other windows.
    places = sorted((n, i) for i, n in enumerate(Contract().names) if n.endswith((".delta", ".linear_trend")))
    given = [(n, F.get("feature_values", F.lit(i))) for n, i in places]
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("key"), v.alias("value"))) for n, v in given]))
    return incidents.select("incident_id", "host_id", "window_end").join(
        windows.select("host_id", "window_end", entries.alias("changes")), ["host_id", "window_end"]
    ).select("incident_id", "changes")


def largest_changes(changes: Column, n: int = 3) -> Column:
    """The n largest differences as (feature, contribution), by size, then by name."""
    deltas = F.filter(changes, lambda e: e["key"].endswith(".delta"))
    ranked = F.array_sort(F.transform(deltas, lambda e: F.struct(-F.abs(e["value"]), e["key"].alias("feature"), e["value"].alias("contribution"))))
    return F.slice(F.transform(ranked, lambda e: F.struct(e["feature"].alias("feature"), e["contribution"].alias("contribution"))), 1, n)


def incident_facts(
    incidents: DataFrame,
    service_map: DataFrame,
    experiments: DataFrame,
    as_of: Column,
    p: Params,
    *,
    alerts: DataFrame,
    windows: DataFrame,
    models: DataFrame,
    drivers: Column | None = None,
) -> DataFrame:
    """The seven ordered facts of each incident and its deterministic summary.

    ``alerts`` are stored alerts with their status, ``windows`` feature windows, ``models`` have a warning; ``drivers`` is an
    array of (feature, contribution), by default the largest differences.  Incidents carry their score's anomaly_score.
    """
    at = incidents.select("host_id", "incident_id", "predicted_at")
    named = F.struct(F.col("experiment_id").alias("id"), F.col("experiment_type").alias("type"), F.col("experiment_status").alias("status"))
    running = (
        active_experiments_at(at, experiments, "predicted_at", p, as_of)
        .groupBy("incident_id")
        .agg(F.array_sort(F.collect_set(named)).alias("experiments"))
    )
    joined = (
        incidents.join(running, "incident_id", "left")
        .join(recent_alerts(incidents, alerts, p), "incident_id", "left")
        .join(feature_changes(incidents, windows), "incident_id", "left")
        .join(service_map, "host_id", "left")
        .join(models.select("model_id", "warning"), "model_id", "left")
    )
    joined = joined.withColumn("drivers", largest_changes(F.col("changes")) if drivers is None else drivers)
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    nothing = F.lit("[]")
    signed = lambda pairs, name, value: F.transform(
        pairs, lambda e: F.concat(F.lit('"'), e[name], F.lit('":'), F.format_string("%.6f", e[value]))
    )
    listed = lambda pairs, name, value: F.concat(F.lit("{"), F.coalesce(F.array_join(signed(pairs, name, value), ","), F.lit("")), F.lit("}"))
    facts = [
        F.format_string(
            "Host %s, service %s: model probability %.6f; horizon %ds anchored at %s, valid until %s.",
            F.col("host_id"),
            F.coalesce("service_job", F.lit("None")),
            F.col("probability"),
            F.lit(p.horizon),
            F.date_format("window_end", stamp),
            F.date_format("valid_until", stamp),
        ),
        F.format_string("Separate unfamiliarity score %.6f; it is not an imminent-failure probability.", F.col("anomaly_score")),
        F.coalesce("warning", F.lit("The model has no recorded evaluation.")),
        F.concat(F.lit("Supplied associations: "), listed(F.col("drivers"), "feature", "contribution")),
        F.concat(F.lit("Recorded active experiments: "), F.coalesce(F.to_json("experiments"), nothing)),
        F.concat(F.lit("Recent alerts: "), F.coalesce(F.to_json("recent_alerts"), nothing)),
        F.concat(F.lit("Causal feature changes: "), listed(F.col("changes"), "key", "value")),
    ]
    checks = F.array(*[F.lit(c) for c in CHECKS.values()])
    return (
        joined.withColumn("evidence", F.array(*facts))
        .withColumn("title", F.lit(TITLE))
        .withColumn("pattern", F.lit(PATTERN))
        .withColumn("checks", checks)
        .withColumn("summary", F.array_join("evidence", " "))
    )


def enqueue_alerts(incidents: DataFrame, p: Params, channels: tuple[str, ...] = CHANNELS, remembered: int = 3) -> DataFrame:
    """One alert per incident and channel, held back by the cooldown of the host's recent alerts.

    Only the host's ``remembered`` newest alerts count.  Every incident alerts all channels, so the
    newest ones stem from the previous incident, channel by channel.
    """
    seen = with_previous(
        incidents, ["host_id"], "predicted_at", ["incident_id"], [], slice_seconds=p.slice_seconds
    )
    channel = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("channel")) for i, c in enumerate(channels)]))
    spread = seen.withColumn("__c", channel)
    last = F.when(F.col("__c.place") < remembered, F.col("prev.predicted_at"))
    due = F.greatest(F.col("predicted_at"), plus(last, p.alert_cooldown))
    return spread.select(
        F.concat_ws("/", "incident_id", "__c.channel").alias("alert_id"),
        "incident_id",
        "host_id",
        "prediction_id",
        F.col("__c.channel").alias("channel"),
        F.col("predicted_at").alias("created_at"),
        due.alias("next_attempt_at"),
        "window_end",
        "valid_until",
    )


def queue_alerts(incidents: DataFrame, stored: DataFrame, p: Params, channels: tuple[str, ...] = CHANNELS, remembered: int = 3) -> DataFrame:
    """As :func:`enqueue_alerts`, with the cooldown read from the stored alerts and from those queued here.

    ``stored`` are alert rows (alert_id, host_id, channel, created_at); an incident that has stored alerts queues
    none again.  Of a host's ``remembered`` alerts made last before the incident (ties by descending id), the newest
    one of the channel counts.  Alerts older than the cooldown hold nothing back, so the look back is bounded and a
    busy host is spread over time chunks.
    """
    channel = F.explode(F.array(*map(F.lit, channels))).alias("channel")
    at = F.col("predicted_at").alias("created_at")
    wanted = incidents.select("incident_id", "host_id", "prediction_id", "window_end", "valid_until", at, channel)
    wanted = wanted.withColumn("alert_id", F.concat_ws("/", "incident_id", "channel"))
    known = stored.select("alert_id", "host_id", "channel", "created_at")
    fresh = wanted.join(known.select("alert_id"), "alert_id", "left_anti")
    shown = ["alert_id", "host_id", "channel", "created_at"]
    made = known.unionByName(fresh.select(*shown))
    # One row per host and instant with its newest alerts; an instant has at most its incident's channels.
    alert = F.struct("alert_id", "channel", "created_at")
    instants = made.groupBy("host_id", "created_at").agg(F.slice(F.sort_array(F.collect_list(alert), asc=False), 1, remembered).alias("own"))
    chunk = max(p.slice_seconds, 4 * p.alert_cooldown)
    order = Window.partitionBy("host_id", "chunk").orderBy("created_at")
    placed = halo_chunks(instants, "created_at", chunk, before=p.alert_cooldown)
    none = F.array().cast("array<struct<alert_id:string,channel:string,created_at:timestamp>>")
    before = F.concat(*[F.coalesce(F.lag("own", i).over(order), none) for i in range(1, remembered + 1)])
    recent = placed.withColumn("before", F.slice(before, 1, remembered)).filter(own_chunk("created_at", chunk))
    found = fresh.join(recent.select("host_id", "created_at", "before"), ["host_id", "created_at"])
    last = F.get(F.filter("before", lambda a: a["channel"] == F.col("channel")), F.lit(0))["created_at"]
    due = F.greatest("created_at", plus(last, p.alert_cooldown))
    return found.select(*shown, "incident_id", "prediction_id", due.alias("next_attempt_at"), "window_end", "valid_until")


def delivery_attempts(changes: DataFrame, restarted_at: Column) -> tuple[DataFrame, DataFrame]:
    """(attempts, underway) of a log of deliveries (alert_id, number, change, at, status_code).

    Each attempt leaves 'sending' and, if there was one, 'answered'.  One that was still sending when the worker
    restarted has an unknown outcome: an attempt without status code.  One that began later is underway.
    """
    per = changes.groupBy("alert_id", "number").agg(
        F.min(F.when(F.col("change") == "sending", F.col("at"))).alias("attempted_at"),
        F.min_by(F.struct("status_code"), F.when(F.col("change") == "answered", F.col("at"))).alias("answer"),
        F.max(F.when(F.col("change") == "answered", 1)).alias("answered"),
    )
    ended = F.col("answered").isNotNull() | (F.col("attempted_at") <= restarted_at)
    known = per.filter(F.col("attempted_at").isNotNull())
    attempts = known.filter(ended).select("alert_id", "number", "attempted_at", F.col("answer.status_code").alias("status_code"))
    return attempts, known.filter(~ended).select("alert_id", "number", "attempted_at")


def due_alerts(alerts: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """Oldest alerts ready for delivery."""
    ready = alerts.filter(
        F.col("status").isin("pending", "retry") & (F.col("next_attempt_at") <= now) & (F.col("attempt_count") < 3)
    )
    return ready.orderBy("created_at", "alert_id").limit(limit)


def delivery_outcomes(alerts: DataFrame, attempts: DataFrame) -> DataFrame:
    """Fold the attempt log: final status, count and next attempt of each alert.

    Success delivers; throttling and server errors retry up to three attempts with a doubling
    pause; other rejections fail; without an answer the outcome stays unknown and is not retried.
    An alert has a handful of attempts at most.
    """
    code = F.col("status_code")
    outcome = (
        F.when(code.isNull(), "unknown")
        .when(code.between(200, 299), "delivered")
        .when((code == 429) | (code >= 500), "retry")
        .otherwise("failed")
    )
    # Attempts at one instant follow their numbers where they have one.
    ties = ["number"] if "number" in attempts.columns else []
    order = Window.partitionBy("alert_id").orderBy("attempted_at", *ties, "status_code")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = attempts.withColumn("n", F.row_number().over(order)).withColumn("outcome", outcome)
    final_before = F.coalesce(F.max(F.when(F.col("outcome") != "retry", 1)).over(earlier), F.lit(0))
    made = numbered.withColumn("__done", final_before).filter((F.col("__done") == 0) & (F.col("n") <= 3))
    last = made.groupBy("alert_id").agg(
        F.max_by(F.struct("n", "outcome", "attempted_at"), "n").alias("a"),
    )
    status = F.when((F.col("a.outcome") == "retry") & (F.col("a.n") >= 3), "failed").otherwise(F.col("a.outcome"))
    pause = (F.lit(30) * F.pow(F.lit(2.0), F.col("a.n") - 1)).cast("bigint")
    folded = last.select(
        "alert_id",
        status.alias("status"),
        F.col("a.n").alias("attempt_count"),
        F.when(status == "delivered", F.col("a.attempted_at")).alias("delivered_at"),
        F.when(status == "retry", F.timestamp_micros(micros("a.attempted_at") + pause * MICROS)).alias("retry_at"),
    )
    joined = alerts.join(folded, "alert_id", "left")
    return joined.withColumn("next_attempt_at", F.when(F.col("status").isNull(), F.col("next_attempt_at")).otherwise(F.col("retry_at"))).drop(
        "retry_at"
    ).withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn(
        "attempt_count", F.coalesce("attempt_count", F.lit(0))
    )


def visible_events(events: DataFrame, as_of: Column) -> DataFrame:
    """Failure events as known at the cutoff: confirmed by then, recovered only if that was seen."""
    seen = F.when(F.col("recovery_confirmed_at") <= as_of, F.col("recovered_at"))
    return events.filter(F.col("confirmed_at") <= as_of).withColumn("recovered_at", seen)


def match_failures(incidents: DataFrame, attached: DataFrame, events: DataFrame, p: Params) -> DataFrame:
    """First confirmed failure belonging to each incident, with the score that foresaw it.

    A failure starting no earlier than one horizon before the incident belongs to it when a high
    score of the incident has its window end in ``[onset - horizon, onset)``, or when it was
    already active as the incident opened, and when it was confirmed before the incident was closed.
    ``attached`` are high scores with their incident, up to its closing.
    """
    known = events.filter(F.col("confirmed_at").isNotNull()).select(
        "host_id",
        "event_id",
        F.col("observed_at").alias("onset"),
        F.col("confirmed_at").alias("event_confirmed_at"),
        F.col("recovered_at").alias("event_recovered_at"),
    )
    # (a) a high score of the incident foresees the onset
    scores = attached.select(
        "host_id",
        "incident_id",
        F.col("opened_at").alias("incident_at"),
        F.col("prediction_id").alias("matched_id"),
        F.col("predicted_at").alias("matched_at"),
        "closed_at",
        F.timestamp_micros(micros("window_end") + 1).alias("from_us"),
        plus("window_end", p.horizon).alias("to_us"),
    )
    foreseen = overlap_join(
        scores, known, ["host_id"], ("from_us", "to_us"), ("onset", "onset"), bucket_seconds=p.horizon
    ).filter(F.col("onset") >= plus("incident_at", -p.horizon))
    # (b) the failure was active when the incident opened
    opened = incidents.select(
        "host_id",
        "incident_id",
        F.col("predicted_at").alias("incident_at"),
        F.col("prediction_id").alias("matched_id"),
        F.col("predicted_at").alias("matched_at"),
        "closed_at",
        plus("predicted_at", -p.horizon).alias("from_us"),
        F.col("predicted_at").alias("to_us"),
    )
    active = overlap_join(
        opened, known, ["host_id"], ("from_us", "to_us"), ("onset", "onset"), bucket_seconds=p.horizon
    ).filter(F.col("event_recovered_at").isNull() | (F.col("event_recovered_at") >= F.col("incident_at")))
    columns = ["incident_id", "event_id", "onset", "event_confirmed_at", "event_recovered_at", "matched_id", "matched_at"]
    in_time = F.col("event_confirmed_at") <= F.col("closed_at")
    both = foreseen.filter(in_time).select(*columns, F.lit(0).alias("way"))
    both = both.unionByName(active.filter(in_time).select(*columns, F.lit(1).alias("way")))
    best = both.groupBy("incident_id").agg(
        F.min(
            F.struct(
                "onset", "event_id", "way", "matched_at", "matched_id", "event_confirmed_at", "event_recovered_at"
            )
        ).alias("m")
    )
    lead = F.when(F.col("m.matched_at") < F.col("m.onset"), seconds_between("m.onset", "m.matched_at"))
    return best.select(
        "incident_id",
        F.col("m.event_id").alias("failure_event_id"),
        F.col("m.onset").alias("onset"),
        F.col("m.event_confirmed_at").alias("event_confirmed_at"),
        F.col("m.event_recovered_at").alias("event_recovered_at"),
        F.col("m.matched_id").alias("matched_prediction_id"),
        lead.alias("prediction_lead_seconds"),
    )


def alert_timing(delivered: str = "delivered_at", onset: str = "onset", valid_until: str = "valid_until") -> Column:
    return (
        F.when(F.col(delivered).isNull(), "not_delivered")
        .when(F.col(delivered) >= F.col(onset), "after_degradation")
        .when(F.col(onset) > F.col(valid_until), "outside_forecast_horizon")
        .otherwise("before_degradation")
    )


def with_alert_timing(alerts: DataFrame, matches: DataFrame) -> DataFrame:
    joined = alerts.join(matches.select("incident_id", "onset"), "incident_id")
    timing = alert_timing()
    lead = F.when(timing == "before_degradation", seconds_between("onset", "delivered_at"))
    return joined.withColumn("timing", timing).withColumn("lead_seconds", lead)


def incident_status(incidents: DataFrame, matches: DataFrame, as_of: Column) -> DataFrame:
    """Current status: observed or recovered once a failure is matched, else how the forecast ended."""
    joined = incidents.drop("match").join(matches, "incident_id", "left")
    matched = F.col("failure_event_id").isNotNull()
    over = F.col("closed_at") < as_of
    status = (
        F.when(matched & F.col("event_recovered_at").isNotNull(), "recovered")
        .when(matched, "observed")
        .when(over, F.col("closed_as"))
        .otherwise("open")
    )
    resolved = F.when(matched, F.col("event_recovered_at")).when(over, F.col("closed_at"))
    return joined.withColumn("status", status).withColumn("resolved_at", resolved)


def cancel_alerts(alerts: DataFrame, statuses: DataFrame) -> DataFrame:
    """Undelivered alerts of resolved incidents are cancelled."""
    resolved = statuses.select("incident_id", F.col("resolved_at").isNotNull().alias("__over"))
    waiting = F.col("status").isin("pending", "retry")
    return (
        alerts.join(resolved, "incident_id", "left")
        .withColumn("status", F.when(waiting & F.coalesce("__over", F.lit(False)), "cancelled").otherwise(F.col("status")))
        .drop("__over")
    )


def proposal_eligible(threshold: Column | str, now: Column, p: Params) -> Column:
    limit = F.greatest(F.lit(p.proposal_threshold), F.col(threshold) if isinstance(threshold, str) else threshold)
    until = micros("window_end") + F.col("horizon_seconds").cast("bigint") * MICROS
    return (
        (F.col("probability") >= limit)
        & seconds_between(now, "predicted_at").between(0, p.max_age)
        & seconds_between(now, "window_end").between(0, p.max_age)
        & (micros(now) < until)
    )


def latest_predictions(predictions: DataFrame) -> DataFrame:
    return latest_per_key(predictions, ["host_id", "model_id"], ["window_end", "prediction_id"])


def create_proposals(statuses: DataFrame, predictions: DataFrame, models: DataFrame, existing: DataFrame, now: Column, p: Params) -> DataFrame:
    """Diagnostics proposals for unresolved incidents whose host's newest score is eligible."""
    unresolved = statuses.filter(F.col("resolved_at").isNull()).select("incident_id", "host_id", "model_id")
    newest = latest_predictions(predictions)
    joined = unresolved.join(newest, ["host_id", "model_id"]).join(models.select("model_id", "threshold"), "model_id")
    known = existing.filter(F.col("runbook") == RUNBOOK).select("incident_id")
    reason = F.format_string(
        "Recorded probability %.6f meets proposal threshold %.6f; request human review of diagnostics.",
        F.col("probability"),
        F.lit(p.proposal_threshold),
    )
    return (
        joined.filter(proposal_eligible("threshold", now, p))
        .join(known, "incident_id", "left_anti")
        .select(
            F.concat_ws("/", "incident_id", F.lit(RUNBOOK)).alias("proposal_id"),
            "incident_id",
            "host_id",
            "prediction_id",
            F.lit(RUNBOOK).alias("runbook"),
            "probability",
            "anomaly_score",
            F.timestamp_micros(micros("window_end") + F.col("horizon_seconds").cast("bigint") * MICROS).alias("valid_until"),
            reason.alias("reason"),
            F.lit("pending").alias("submission_status"),
            F.lit("pending").alias("approval_status"),
            F.lit("not_started").alias("execution_status"),
        )
    )


def validate_proposals(proposals: DataFrame, statuses: DataFrame, predictions: DataFrame, models: DataFrame, now: Column, p: Params) -> DataFrame:
    """Pending proposals are cancelled when overtaken by events or when their facts changed."""
    incident = statuses.select("incident_id", F.col("resolved_at").isNull().alias("__unresolved"))
    newest = latest_predictions(predictions).select(
        "host_id", "model_id", F.col("prediction_id").alias("__newest")
    )
    stored = predictions.join(newest, ["host_id", "model_id"]).join(
        models.select("model_id", "threshold"), "model_id"
    )
    facts = stored.filter(F.col("prediction_id") == F.col("__newest")).select(
        "prediction_id",
        F.struct(
            "host_id", "probability", "anomaly_score",
            F.timestamp_micros(micros("window_end") + F.col("horizon_seconds").cast("bigint") * MICROS).alias("valid_until"),
        ).alias("__facts"),
        proposal_eligible("threshold", now, p).alias("__eligible"),
    )
    claimed = F.struct("host_id", "probability", "anomaly_score", "valid_until")
    joined = proposals.join(incident, "incident_id", "left").join(facts, "prediction_id", "left")
    current = F.coalesce(F.col("__unresolved") & F.col("__eligible"), F.lit(False))
    verdict = (
        F.when(~current, "cancelled: resolved, superseded, stale or expired")
        .when(~F.col("__facts").eqNullSafe(claimed), "cancelled: facts differ from stored score")
        .otherwise("sending")
    )
    return joined.withColumn("verdict", verdict).drop("__unresolved", "__facts", "__eligible")


def alert_payload(facts: DataFrame, drivers: Column | None = None) -> DataFrame:
    """Message sections; long texts are cut at the receiver's limits, contributions are signed."""
    core = F.format_string(
        "Incident %s · Host %s · Service %s\nFailure probability %.6f; valid until %s",
        F.col("incident_id"),
        F.col("host_id"),
        F.coalesce("service_job", F.lit("None")),
        F.col("probability"),
        F.date_format("valid_until", "yyyy-MM-dd'T'HH:mm:ss"),
    )
    sections = [core, F.concat(F.lit("Summary excerpt:\n"), F.substring("summary", 1, 1800))]
    if drivers is not None:
        lines = F.transform(drivers, lambda d: F.format_string("%s: %+.6f", d["feature"], d["contribution"]))
        sections.insert(1, F.concat(F.lit("Associated signals (not causes):\n"), F.array_join(lines, "\n")))
    return facts.withColumn("sections", F.transform(F.array(*sections), lambda s: F.substring(s, 1, 2900)))


def live_outcomes(events: DataFrame, predictions: DataFrame, alerts: DataFrame, threshold: float, p: Params) -> DataFrame:
    """Per failure: scores whose forecast covered it beforehand, and the earliest delivered alert."""
    onsets = events.select("event_id", "host_id", F.col("observed_at").alias("onset"))
    spans = predictions.select(
        "host_id",
        "predicted_at",
        "probability",
        F.timestamp_micros(micros("window_end") + 1).alias("from_us"),
        plus("window_end", p.horizon).alias("to_us"),
    )
    covered = (
        overlap_join(onsets, spans, ["host_id"], ("onset", "onset"), ("from_us", "to_us"), bucket_seconds=p.horizon)
        .filter(F.col("predicted_at") < F.col("onset"))
        .groupBy("event_id")
        .agg(
            F.count(F.lit(1)).alias("scores"),
            F.sum(F.when(F.col("probability") >= threshold, 1).otherwise(0)).alias("crossings"),
            F.min("probability").alias("low"),
            F.max("probability").alias("high"),
        )
    )
    sent = alerts.filter(F.col("status") == "delivered").select(
        "host_id",
        "alert_id",
        "delivered_at",
        F.timestamp_micros(micros("window_end") + 1).alias("from_us"),
        F.col("valid_until").alias("to_us"),
    )
    warned = (
        overlap_join(onsets, sent, ["host_id"], ("onset", "onset"), ("from_us", "to_us"), bucket_seconds=p.horizon)
        .filter(F.col("delivered_at") < F.col("onset"))
        .groupBy("event_id", "onset")
        .agg(F.min(F.struct("delivered_at", "alert_id")).alias("a"))
        .select("event_id", F.col("a.alert_id").alias("alert_id"), seconds_between("onset", "a.delivered_at").alias("alert_lead"))
    )
    joined = onsets.join(covered, "event_id", "left").join(warned, "event_id", "left")
    return joined.select(
        "event_id",
        "host_id",
        F.coalesce("scores", F.lit(0)).alias("scores"),
        F.coalesce("crossings", F.lit(0)).alias("crossings"),
        "low",
        "high",
        "alert_id",
        "alert_lead",
        F.coalesce(F.col("alert_lead") >= p.min_lead, F.lit(False)).alias("useful"),
    )


