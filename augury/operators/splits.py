"""Dataset splits that keep experiments and overlapping intervals on one side."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.functions.clock import plus
from augury.functions.cut import checkpointed
from augury.functions.intervals import label_islands, merge_intervals, overlap_join
from augury.functions.ordered import Scan, asof, running
from augury.functions.ranked import global_rank
from augury.settings import Params

ROW = ["host_id", "window_start", "window_end"]


def influence_members(experiments: DataFrame, as_of: Column, p: Params) -> DataFrame:
    """Every experiment with its influence span and the number of its merged group on the host."""
    spans = experiments.select(
        "host_id",
        "experiment_id",
        plus("started_at", -p.horizon).alias("start"),
        plus(F.coalesce("ended_at", as_of), p.recovery_exclusion).alias("stop"),
    )
    return label_islands(spans, ["host_id"], "start", "stop", ["experiment_id"], slice_seconds=p.slice_seconds)


def influence_intervals(experiments: DataFrame, as_of: Column, p: Params) -> DataFrame:
    """Merged influence spans per host; touching spans merge."""
    return (
        influence_members(experiments, as_of, p)
        .groupBy("host_id", "island")
        .agg(
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.array_sort(F.collect_list("experiment_id")).alias("experiment_ids"),
        )
    )


def _touched(rows: DataFrame, merged: DataFrame, p: Params) -> DataFrame:
    """Pairs of a row's key and a merged span it overlaps together with its future."""
    reach = rows.select(*ROW, plus("window_end", p.horizon).alias("reach"))
    return overlap_join(
        reach, merged, ["host_id"], ("window_start", "reach"), ("start", "stop"), bucket_seconds=p.slice_seconds
    )


def window_experiments(rows: DataFrame, experiments: DataFrame, as_of: Column, p: Params) -> DataFrame:
    """Add the sorted ids of all experiments whose merged influence a row overlaps."""
    rows = checkpointed(rows)
    pairs = _touched(rows, influence_intervals(experiments, as_of, p), p)
    ids = pairs.groupBy(*ROW).agg(
        F.array_sort(F.flatten(F.collect_list("experiment_ids"))).alias("experiment_ids"),
        F.min("island").alias("first_island"),
        F.max("island").alias("last_island"),
    )
    none = F.array().cast("array<string>")
    return rows.join(ids, ROW, "left").withColumn("experiment_ids", F.coalesce("experiment_ids", none))


def experiment_components(tagged: DataFrame, p: Params) -> DataFrame:
    """Groups of merged spans connected by rows that touch several of them.

    The spans of a host are disjoint and ordered, and a row covers a stretch of time, so the spans
    it touches are neighbours.  Connected groups are therefore runs of linked neighbours: one
    ordered pass, no graph iteration.
    """
    used = tagged.filter(F.size("experiment_ids") > 0)
    touched = used.select(
        "host_id",
        F.explode(F.sequence("first_island", "last_island")).alias("island"),
        "first_island",
        "last_island",
        "experiment_ids",
    )
    spans = touched.groupBy("host_id", "island").agg(
        F.max(F.col("island") > F.col("first_island")).alias("linked_back"),
        F.min(F.element_at("experiment_ids", 1)).alias("smallest"),
    )
    # Spans are numbered consecutively per host; the number itself is the order.
    ordered = spans.withColumn("at", F.timestamp_seconds(F.col("island")))
    numbered = running(
        ordered,
        ["host_id"],
        "at",
        ["island"],
        {"component": Scan("sum", F.when(F.col("linked_back"), 0).otherwise(1))},
        slice_seconds=100_000,
    )
    return numbered.select("host_id", "island", "component", "smallest")


def group_ids(tagged: DataFrame, p: Params) -> DataFrame:
    """Name the group of each row: its experiment component, or host and day when untouched.

    The root of a component is the smallest id its rows mention.
    """
    tagged = checkpointed(tagged)
    spans = experiment_components(tagged, p)
    roots = spans.groupBy("host_id", "component").agg(F.min("smallest").alias("root"))
    by_island = spans.join(roots, ["host_id", "component"]).select(
        "host_id", F.col("island").alias("first_island"), "root"
    )
    day = F.date_format("window_end", "yyyy-MM-dd")
    name = F.when(F.col("root").isNotNull(), F.concat(F.lit("experiment:"), "root")).otherwise(
        F.concat(F.lit("healthy:"), "host_id", F.lit(":"), day)
    )
    return (
        tagged.join(by_island, ["host_id", "first_island"], "left")
        .withColumn("group_id", name)
        .drop("first_island", "last_island", "root")
    )


def grouped_split(grouped: DataFrame) -> DataFrame:
    """Latest fifth of the groups (at least one, if there are two) becomes the test part."""
    grouped = checkpointed(grouped)
    groups = grouped.groupBy("group_id").agg(F.min("window_end").alias("first_end"))
    ranked = global_rank(groups, [F.col("first_end").asc(), F.col("group_id").asc()])
    n = ranked.count()
    held_out = max(1, n // 5) if n >= 2 else 0
    part = F.when(F.col("rank") > n - held_out, "test").otherwise("train")
    return grouped.join(ranked.select("group_id", part.alias("split")), "group_id")


def purge_overlap(split: DataFrame, p: Params) -> DataFrame:
    """Mark train rows whose input and future overlap those of a test row of their host.

    Test spans are merged first; of the merged spans only the last one starting before a row's
    end can reach it, so one ordered lookup decides.
    """
    reach = checkpointed(split).withColumn("reach", plus("window_end", p.horizon))
    spans = reach.filter("split = 'test'").select("host_id", F.col("window_start").alias("start"), F.col("reach").alias("stop"))
    merged = merge_intervals(spans, ["host_id"], "start", "stop", slice_seconds=p.slice_seconds)
    found = asof(reach, merged, ["host_id"], "reach", "start", ["stop"], name="test_span", slice_seconds=p.slice_seconds)
    hit = F.coalesce(F.col("test_span.stop") >= F.col("window_start"), F.lit(False))
    part = F.when((F.col("split") == "train") & hit, "purged").otherwise(F.col("split"))
    return found.withColumn("split", part).drop("reach", "test_span")


def plan_valid(train_end: datetime, test_start: datetime, declared: datetime) -> bool:
    return train_end < test_start and declared < test_start


def chronological_split(
    rows: DataFrame, train_end: datetime, test_start: datetime, declared: datetime, p: Params
) -> DataFrame:
    """Whole input and future inside one declared period; everything across a border is purged."""
    if not plan_valid(train_end, test_start, declared):
        raise ValueError("boundaries must be declared before the held-out period")
    reach = plus("window_end", p.horizon + p.confirm_span)
    lower, upper = F.lit(train_end), F.lit(test_start)
    part = (
        F.when(reach < lower, "train")
        .when((F.col("window_start") > lower) & (reach < upper), "validation")
        .when(F.col("window_start") > upper, "test")
        .otherwise("purged")
    )
    return rows.withColumn("split", part)


def split_experiments(rows: DataFrame, experiments: DataFrame, as_of: Column, p: Params) -> DataFrame:
    """(experiment, split) pairs a dataset touches; few rows per experiment."""
    reach = rows.filter("split <> 'purged'").select(
        *ROW, "split", plus("window_end", p.horizon + p.confirm_span).alias("reach")
    )
    spans = experiments.select(
        "host_id", "experiment_id", F.col("started_at").alias("start"), F.coalesce("ended_at", as_of).alias("stop")
    )
    return (
        overlap_join(
            reach, spans, ["host_id"], ("window_start", "reach"), ("start", "stop"), bucket_seconds=p.slice_seconds
        )
        .select("experiment_id", "split")
        .distinct()
    )


def experiment_leakage(pairs: DataFrame) -> DataFrame:
    """Experiments that occur in more than one part."""
    return (
        pairs.groupBy("experiment_id")
        .agg(F.array_sort(F.collect_set("split")).alias("splits"))
        .filter(F.size("splits") > 1)
        .select("experiment_id", F.array_join("splits", ",").alias("splits"))
    )


def interval_leakage(rows: DataFrame, p: Params) -> DataFrame:
    """Parts whose intervals overlap on a host.  Rows are merged to spans per part before comparing."""
    spans = rows.select(
        "host_id", "split", F.col("window_start").alias("start"), plus("window_end", p.horizon + p.confirm_span).alias("stop")
    )
    spans = checkpointed(spans)
    merged = checkpointed(merge_intervals(spans, ["host_id", "split"], "start", "stop", slice_seconds=p.slice_seconds))
    a = merged.select("host_id", F.col("split").alias("split_a"), F.col("start").alias("a1"), F.col("stop").alias("a2"))
    b = merged.select("host_id", F.col("split").alias("split_b"), F.col("start").alias("b1"), F.col("stop").alias("b2"))
    return (
        overlap_join(
            a,
            b,
            ["host_id"],
            ("a1", "a2"),
            ("b1", "b2"),
            bucket_seconds=p.slice_seconds,
            extra=F.col("split_a") < F.col("split_b"),
        )
        .select("host_id", "split_a", "split_b")
        .distinct()
    )


def split_status(rows: DataFrame, parts: list[str]) -> DataFrame:
    present = [F.max(F.col("split") == part) for part in parts]
    every = present[0]
    for c in present[1:]:
        every = every & c
    return rows.agg(
        F.when(F.coalesce(every, F.lit(False)), "available").otherwise("awaiting_evidence").alias("status"),
        *[F.sum(F.when(F.col("split") == part, 1).otherwise(0)).alias(part) for part in parts],
    )


def _violations(name: str, frame: DataFrame) -> DataFrame:
    return frame.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def dataset_checks(rows: DataFrame, p: Params, width: int | None = None) -> DataFrame:
    """Violation counts of the rules a training set must keep; all zero when it is sound."""
    rows = checkpointed(rows)
    duplicated = rows.groupBy("host_id", "window_end").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bad_label = rows.filter(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)))
    bad_split = rows.filter(~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False)))
    bad_horizon = rows.filter(F.col("horizon_seconds") != p.horizon)
    one_sided = rows.groupBy("split").agg(F.countDistinct("label").alias("n")).filter("n < 2")
    frames = [
        _violations("unique_windows", duplicated),
        _violations("labels", bad_label),
        _violations("splits", bad_split),
        _violations("horizon", bad_horizon),
        _violations("both_classes", one_sided),
    ]
    if width is not None:
        frames += _vector_checks(rows, width)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _vector_checks(rows: DataFrame, width: int) -> list[DataFrame]:
    endless = F.exists("feature_values", lambda v: v.isNotNull() & (F.isnan(v) | (F.abs(v) == float("inf"))))
    return [_violations("width", rows.filter(F.size("feature_values") != width)), _violations("finite", rows.filter(endless))]


def healthy_checks(healthy: DataFrame, rows: DataFrame, p: Params, minimum: int = 5, width: int | None = None) -> DataFrame:
    """The same for the anomaly model's training inputs: train only, never positive, clear of later parts, judged by
    the current objective."""
    healthy, rows = checkpointed(healthy), checkpointed(rows)
    short = healthy.agg((F.count(F.lit(1)) < minimum).cast("bigint").alias("violations")).select(
        F.lit("enough_rows").alias("check"), "violations"
    )
    duplicated = healthy.groupBy("host_id", "window_end").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    first_held_out = rows.filter("split <> 'train'").groupBy("host_id").agg(F.min("window_start").alias("held_start"))
    # The rule compares with every held-out window of the host; the earliest start decides.
    overlap = healthy.join(first_held_out, "host_id").filter(
        plus("window_end", p.horizon + p.confirm_span) >= F.col("held_start")
    )
    out = (
        short.unionByName(_violations("unique_windows", duplicated))
        .unionByName(_violations("train_only", healthy.filter("split <> 'train'")))
        .unionByName(_violations("not_positive", healthy.filter("label = 1")))
        .unionByName(_violations("clear_of_held_out", overlap))
    )
    if "input_criterion" in healthy.columns:
        other = ~F.coalesce(F.col("input_criterion") == p.latency_slo, F.lit(False))
        out = out.unionByName(_violations("criterion", healthy.filter(other)))
    for part in _vector_checks(healthy, width) if width is not None else []:
        out = out.unionByName(part)
    return out


def missing_report(long: DataFrame) -> DataFrame:
    """Missing count and fraction per feature."""
    missing = F.sum(F.when(F.col("value").isNull(), 1).otherwise(0))
    return long.groupBy("feature").agg(
        missing.alias("missing"), F.count(F.lit(1)).alias("rows"), (missing / F.count(F.lit(1))).alias("fraction")
    )


def dataset_report(rows: DataFrame) -> DataFrame:
    """Size, hosts and time span per part and label."""
    return rows.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("host_id").alias("hosts"),
        F.min("window_end").alias("first_end"),
        F.max("window_end").alias("last_end"),
    )


def bucket_digests(rows: DataFrame, at: str) -> DataFrame:
    """(host_id, day, rows, lanes): a digest of the rows of each host and day that does not depend on their order.

    Hashes of rows are summed in lanes, so tasks add up their own rows first and a busy host is many small groups."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    hashed = rows.select("host_id", F.to_date(at).alias("day"), F.sha2(text, 256).alias("h"))
    lane = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return hashed.groupBy("host_id", "day").agg(F.count(F.lit(1)).alias("rows"), F.array(*[lane(i) for i in range(4)]).alias("lanes"))


def differing_buckets(stored: DataFrame, derived: DataFrame, at: str) -> DataFrame:
    """(host_id, day) whose digests differ or that only one side has."""
    a, b = (bucket_digests(f, at).select("host_id", "day", F.struct("rows", "lanes").alias(n)) for f, n in ((stored, "a"), (derived, "b")))
    both = a.withColumn("day", F.coalesce("day", F.lit("0001-01-01").cast("date"))).join(
        b.withColumn("day", F.coalesce("day", F.lit("0001-01-01").cast("date"))), ["host_id", "day"], "full"
    )
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("host_id", "day")


def evidence_recheck(stored: DataFrame, derived: DataFrame, at: str = "window_end") -> DataFrame:
    """Rows that only one of the two holds, with the side they are missing from.

    Digests of each host and day are compared first; only the rows of buckets that differ are shuffled and
    compared one by one, so a sound table costs two scans and as many rows as it has buckets."""
    names = sorted(stored.columns)
    a, b = stored.select(*names), checkpointed(derived.select(*names))
    suspect = checkpointed(differing_buckets(a, b, at))
    day = F.coalesce(F.to_date(at), F.lit("0001-01-01").cast("date"))
    opened = lambda f: f.withColumn("day", day).join(suspect, ["host_id", "day"], "left_semi").select(*names)
    return (
        opened(a).exceptAll(opened(b)).withColumn("missing_from", F.lit("recomputed"))
        .unionByName(opened(b).exceptAll(opened(a)).withColumn("missing_from", F.lit("stored")))
    )
