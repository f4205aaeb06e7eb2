"""Queries over splits and evaluation measures."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from augury.functions.clock import r6
from augury.functions.cut import checkpointed
from augury.operators import evaluation as ev
from augury.operators import features, splits
from augury.plans import common, oracle, oracle_events  # noqa: F401
from augury.plans.catalog import query
from augury.plans.oracle import EXCL, H, SPAN
from augury.plans.oracle import r6 as o6
from augury.plans.oracle import ts
from augury.settings import SPARSE
from augury.sources import domain, tables

TRAIN_END, TEST_START, DECLARED = (datetime(2024, 1, d, tzinfo=UTC) for d in (13, 22, 1))

# ---- splits --------------------------------------------------------------------------------------

oracle.cte("v_influence", f"""
SELECT host_id, experiment_id, epoch_us(started_at) - {H * 10**6} AS a,
  coalesce(epoch_us(ended_at), now_us) + {EXCL * 10**6} AS b FROM v_experiments, v_now
""")
oracle.cte("v_influence_marked", """
SELECT *, sum(opens) OVER (PARTITION BY host_id ORDER BY a, experiment_id) AS island FROM (
  SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY host_id ORDER BY a, experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS opens FROM v_influence)
""")
oracle.cte("v_merged", """
SELECT host_id, island, min(a) AS a, max(b) AS b, list_sort(list(experiment_id)) AS ids FROM v_influence_marked GROUP BY host_id, island
""")
oracle.cte("v_rows", """
SELECT l.*, f.experiment_id, f.failure_type, f.onset_us FROM v_dataset l LEFT JOIN v_failures f ON f.event_id = l.failure_event_id
WHERE l.label IS NOT NULL
""")
# Splits and measures take every labelled window, those with little history included.
oracle.cte("v_labelled_rows", """
SELECT l.*, f.experiment_id, f.failure_type, f.onset_us FROM v_labels l LEFT JOIN v_failures f ON f.event_id = l.failure_event_id
WHERE l.label IS NOT NULL
""")
oracle.cte("v_touch", f"""
SELECT r.host_id, r.end_us, m.island, m.ids FROM v_labelled_rows r JOIN v_merged m ON m.host_id = r.host_id
  AND r.start_us <= m.b AND r.end_us + {H * 10**6} >= m.a
""")
oracle.cte("v_row_ids", """
SELECT r.host_id, r.end_us, list_sort(flatten(list(t.ids))) AS ids FROM v_labelled_rows r JOIN v_touch t USING (host_id, end_us) GROUP BY r.host_id, r.end_us
""")
# Connected experiments: spread the smallest reachable id over shared rows, step by step.
oracle.cte("v_edges", """
SELECT DISTINCT x.e AS a, y.e AS b FROM (SELECT host_id, end_us, unnest(ids) AS e FROM v_row_ids) x
JOIN (SELECT host_id, end_us, unnest(ids) AS e FROM v_row_ids) y USING (host_id, end_us)
""")
oracle.cte("v_reach", """(a, b) AS SELECT a, b FROM v_edges UNION SELECT r.a, e.b FROM v_reach r JOIN v_edges e ON e.a = r.b""")
oracle.cte("v_roots", "SELECT a AS experiment_id, min(b) AS root FROM v_reach GROUP BY a")
oracle.cte("v_grouped", """
SELECT r.host_id, r.start_us, r.end_us, r.label, i.ids,
  CASE WHEN i.ids IS NULL THEN 'healthy:' || r.host_id || ':' || strftime(make_timestamp(r.end_us), '%Y-%m-%d')
       ELSE 'experiment:' || o.root END AS group_id
FROM v_labelled_rows r LEFT JOIN v_row_ids i USING (host_id, end_us) LEFT JOIN v_roots o ON o.experiment_id = i.ids[1]
""")
oracle.cte("v_group_split", """
SELECT group_id, CASE WHEN n >= 2 AND rn > n - greatest(1, n // 5) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT group_id, row_number() OVER (ORDER BY min(end_us), group_id) AS rn, count(*) OVER () AS n FROM v_grouped GROUP BY group_id)
""")
oracle.cte("v_split", "SELECT g.*, s.split FROM v_grouped g JOIN v_group_split s USING (group_id)")
oracle.cte("v_purged", f"""
SELECT * REPLACE (CASE WHEN split = 'train' AND EXISTS (SELECT 1 FROM v_split t WHERE t.split = 'test' AND t.host_id = s.host_id
    AND s.start_us <= t.end_us + {H * 10**6} AND s.end_us + {H * 10**6} >= t.start_us) THEN 'purged' ELSE split END AS split)
FROM v_split s
""")
_LOW, _HIGH = (int(d.timestamp()) * 10**6 for d in (TRAIN_END, TEST_START))
_REACH = (H + SPAN) * 10**6
_CHRONO = f"""CASE WHEN end_us + {_REACH} < {_LOW} THEN 'train' WHEN start_us > {_LOW} AND end_us + {_REACH} < {_HIGH} THEN 'validation'
  WHEN start_us > {_HIGH} THEN 'test' ELSE 'purged' END AS split"""
oracle.cte("v_chrono", f"SELECT *, {_CHRONO} FROM v_rows")
oracle.cte("v_labelled_chrono", f"SELECT *, {_CHRONO} FROM v_labelled_rows")


def rows(spark, sf_dir):
    """Every labelled window."""
    return common.labelled(spark, sf_dir).filter(F.col("label").isNotNull())


def dataset_rows(spark, sf_dir):
    """Labelled windows a dataset takes."""
    return common.dataset(spark, sf_dir).filter(F.col("label").isNotNull())


def chronological(windows):
    return splits.chronological_split(windows, TRAIN_END, TEST_START, DECLARED, SPARSE)


def _tagged(spark, sf_dir):
    return splits.window_experiments(
        rows(spark, sf_dir), domain.experiments(spark, sf_dir), domain.as_of(spark, sf_dir), SPARSE
    )


def _chrono(spark, sf_dir):
    return chronological(rows(spark, sf_dir))


@query("influence_intervals", f"""
SELECT host_id, {ts('a')} AS "start", {ts('b')} AS stop, array_to_string(ids, ',') AS experiment_ids FROM v_merged
""")
def influence_intervals(spark, sf_dir):
    merged = splits.influence_intervals(domain.experiments(spark, sf_dir), domain.as_of(spark, sf_dir), SPARSE)
    return merged.select("host_id", "start", "stop", F.array_join("experiment_ids", ",").alias("experiment_ids"))


@query("window_experiments", f"""
SELECT host_id, {ts('r.end_us')} AS window_end, coalesce(array_to_string(ids, ','), '') AS experiment_ids
FROM v_labelled_rows r LEFT JOIN v_row_ids USING (host_id, end_us)
""")
def window_experiments(spark, sf_dir):
    return _tagged(spark, sf_dir).select(
        "host_id", "window_end", F.array_join("experiment_ids", ",").alias("experiment_ids")
    )


@query("experiment_components", "SELECT root, count(*) AS experiments FROM v_roots GROUP BY root")
def experiment_components(spark, sf_dir):
    tagged = splits.group_ids(_tagged(spark, sf_dir), SPARSE).filter(F.size("experiment_ids") > 0)
    members = tagged.select(F.substring("group_id", 12, 64).alias("root"), F.explode("experiment_ids").alias("e")).distinct()
    return members.groupBy("root").agg(F.count(F.lit(1)).alias("experiments"))


@query("group_ids", f"SELECT host_id, {ts('end_us')} AS window_end, group_id FROM v_grouped")
def group_ids(spark, sf_dir):
    return splits.group_ids(_tagged(spark, sf_dir), SPARSE).select("host_id", "window_end", "group_id")


def _split(spark, sf_dir):
    return splits.grouped_split(splits.group_ids(_tagged(spark, sf_dir), SPARSE))


@query("grouped_split", f"SELECT host_id, {ts('end_us')} AS window_end, split FROM v_split")
def grouped_split(spark, sf_dir):
    return _split(spark, sf_dir).select("host_id", "window_end", "split")


@query("purge_overlap", f"SELECT host_id, {ts('end_us')} AS window_end, split FROM v_purged")
def purge_overlap(spark, sf_dir):
    return splits.purge_overlap(_split(spark, sf_dir), SPARSE).select("host_id", "window_end", "split")


@query("chronological_split", f"SELECT host_id, {ts('end_us')} AS window_end, split FROM v_labelled_chrono")
def chronological_split(spark, sf_dir):
    return _chrono(spark, sf_dir).select("host_id", "window_end", "split")


@query("experiment_leakage", f"""
SELECT experiment_id, string_agg(split, ',' ORDER BY split) AS splits FROM (
  SELECT DISTINCT x.experiment_id, CASE WHEN hour({ts('r.end_us')}) < 8 THEN 'test' WHEN hour({ts('r.end_us')}) < 16 THEN 'train' ELSE 'validation' END AS split
  FROM v_labelled_rows r CROSS JOIN v_now JOIN v_experiments x ON x.host_id = r.host_id AND r.start_us <= coalesce(epoch_us(x.ended_at), now_us)
    AND r.end_us + {_REACH} >= epoch_us(x.started_at))
GROUP BY experiment_id HAVING count(*) > 1
""")
def experiment_leakage(spark, sf_dir):
    pairs = splits.split_experiments(
        _naive(rows(spark, sf_dir)), domain.experiments(spark, sf_dir), domain.as_of(spark, sf_dir), SPARSE
    )
    return splits.experiment_leakage(pairs)


def _naive(windows):
    """A careless split by hour of day, which leaks."""
    hour = F.hour("window_end")
    return windows.withColumn("split", F.when(hour < 8, "test").when(hour < 16, "train").otherwise("validation"))


oracle.cte("v_naive", f"""
SELECT *, CASE WHEN hour({ts('end_us')}) < 8 THEN 'test' WHEN hour({ts('end_us')}) < 16 THEN 'train' ELSE 'validation' END AS split FROM v_rows
""")


@query("interval_leakage", f"""
SELECT DISTINCT a.host_id, a.split AS split_a, b.split AS split_b FROM v_naive a JOIN v_naive b ON a.host_id = b.host_id AND a.split < b.split
  AND a.start_us <= b.end_us + {_REACH} AND b.start_us <= a.end_us + {_REACH}
""")
def interval_leakage(spark, sf_dir):
    return splits.interval_leakage(_naive(dataset_rows(spark, sf_dir)), SPARSE)


@query("plan_valid", f"""
SELECT split, count(*) AS "rows" FROM v_labelled_chrono WHERE TIMESTAMP '2024-01-13' < TIMESTAMP '2024-01-22' GROUP BY split
""")
def plan_valid(spark, sf_dir):
    if splits.plan_valid(TEST_START, TRAIN_END, DECLARED):
        raise ValueError("reversed boundaries must be refused")
    return _chrono(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("split_status", """
SELECT CASE WHEN train > 0 AND validation > 0 AND test > 0 THEN 'available' ELSE 'awaiting_evidence' END AS status, train, validation, test
FROM (SELECT count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation,
  count(*) FILTER (WHERE split = 'test') AS test FROM v_labelled_chrono)
""")
def split_status(spark, sf_dir):
    return splits.split_status(_chrono(spark, sf_dir), ["train", "validation", "test"])


WIDTH = len(features.Contract.of(SPARSE).names)


def _with_vectors(spark, sf_dir, rows):
    """Rows with their stored vectors, of which some are too short (hour 4) or hold an infinite value (hour 6)."""
    rows = checkpointed(rows)
    windows = features.feature_windows(domain.samples(spark, sf_dir), SPARSE, domain.as_of(spark, sf_dir), rows)
    hour, values = F.hour("window_end"), F.col("feature_values")
    endless = F.transform(values, lambda v, i: F.when(i == 5, F.lit(float("inf"))).otherwise(v))
    stored = F.when(hour == 4, F.slice(values, 1, WIDTH - 1)).when(hour == 6, endless).otherwise(values)
    return rows.join(windows.select("host_id", "window_end", stored.alias("feature_values")), ["host_id", "window_end"])


@query("dataset_checks", """
WITH d AS (SELECT *, 21600 AS h FROM v_chrono UNION ALL SELECT *, 21601 FROM v_chrono WHERE hour(make_timestamp(end_us)) = 3)
SELECT 'unique_windows' AS "check", count(*) AS violations FROM (SELECT 1 FROM d GROUP BY host_id, end_us HAVING count(*) > 1)
UNION ALL SELECT 'labels', count(*) FROM d WHERE label NOT IN (0, 1)
UNION ALL SELECT 'splits', count(*) FROM d WHERE split = 'purged'
UNION ALL SELECT 'horizon', count(*) FROM d WHERE h <> 21600
UNION ALL SELECT 'both_classes', count(*) FROM (SELECT 1 FROM d GROUP BY split HAVING count(DISTINCT label) < 2)
UNION ALL SELECT 'width', count(*) FROM d WHERE hour(make_timestamp(end_us)) = 4
UNION ALL SELECT 'finite', count(*) FROM d WHERE hour(make_timestamp(end_us)) = 6
""".replace("WITH d AS (SELECT", "SELECT * FROM (WITH d AS (SELECT") + ")")
def dataset_checks(spark, sf_dir):
    good = chronological(dataset_rows(spark, sf_dir)).withColumn("horizon_seconds", F.lit(SPARSE.horizon))
    spoiled = good.filter(F.hour("window_end") == 3).withColumn("horizon_seconds", F.lit(SPARSE.horizon + 1))
    return splits.dataset_checks(_with_vectors(spark, sf_dir, good.unionByName(spoiled)), SPARSE, width=WIDTH)


oracle.cte("v_healthy_rows", f"SELECT *, {_CHRONO} FROM v_healthy_part")


@query("healthy_checks", f"""
SELECT 'enough_rows' AS "check", CAST(CASE WHEN count(*) < 5 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM v_healthy_rows
UNION ALL SELECT 'unique_windows', count(*) FROM (SELECT 1 FROM v_healthy_rows GROUP BY host_id, end_us HAVING count(*) > 1)
UNION ALL SELECT 'train_only', count(*) FROM v_healthy_rows WHERE split <> 'train'
UNION ALL SELECT 'not_positive', count(*) FROM v_healthy_rows WHERE label = 1
UNION ALL SELECT 'clear_of_held_out', count(*) FROM v_healthy_rows h WHERE EXISTS (SELECT 1 FROM v_chrono o
  WHERE o.host_id = h.host_id AND o.split <> 'train' AND h.end_us + {_REACH} >= o.start_us)
UNION ALL SELECT 'criterion', count(*) FROM v_healthy_rows WHERE hour(make_timestamp(end_us)) = 3
UNION ALL SELECT 'width', count(*) FROM v_healthy_rows WHERE hour(make_timestamp(end_us)) = 4
UNION ALL SELECT 'finite', count(*) FROM v_healthy_rows WHERE hour(make_timestamp(end_us)) = 6
""")
def healthy_checks(spark, sf_dir):
    """Rows of hour 3 were judged by another objective, vectors of hours 4 and 6 are damaged; the checks must count these."""
    every = checkpointed(chronological(common.dataset(spark, sf_dir)))
    healthy = common.healthy_part(spark, sf_dir, every)
    healthy = healthy.withColumn("input_criterion", F.when(F.hour("window_end") == 3, 1.0).otherwise(F.col("input_criterion")))
    return splits.healthy_checks(_with_vectors(spark, sf_dir, healthy), every.filter("label IS NOT NULL"), SPARSE, width=WIDTH)


@query("dataset_report", f"""
SELECT split, CAST(label AS INTEGER) AS label, count(*) AS "rows", count(DISTINCT host_id) AS hosts, {ts('min(end_us)')} AS first_end, {ts('max(end_us)')} AS last_end
FROM v_labelled_chrono GROUP BY split, label
""")
def dataset_report(spark, sf_dir):
    return splits.dataset_report(_chrono(spark, sf_dir))


oracle.cte("v_names", "SELECT unnest([" + ", ".join(f"'{n}'" for n in features.Contract.of(SPARSE).names) + "]) AS feature")


@query("missing_report", f"""
SELECT n.feature, w.total - coalesce(f.present, 0) AS missing, w.total AS "rows", {o6('(w.total - coalesce(f.present, 0)) / w.total')} AS fraction
FROM v_names n CROSS JOIN (SELECT count(*) AS total FROM v_cross) w
LEFT JOIN (SELECT feature, count(*) AS present FROM v_features WHERE value IS NOT NULL GROUP BY feature) f USING (feature)
""")
def missing_report(spark, sf_dir):
    windows = features.feature_windows(domain.samples(spark, sf_dir), SPARSE, domain.as_of(spark, sf_dir))
    return splits.missing_report(features.long_features(windows)).withColumn("fraction", r6("fraction"))


@query("evidence_recheck", f"""
SELECT 'labels' AS part, host_id, {ts('end_us')} AS window_end, side AS missing_from
FROM v_labels CROSS JOIN (SELECT unnest(['recomputed', 'stored']) AS side)
WHERE hour({ts('end_us')}) = 5 OR (hour({ts('end_us')}) = 7 AND side = 'stored')
UNION ALL
SELECT 'vectors', host_id, {ts('end_us')}, side FROM v_coverage CROSS JOIN (SELECT unnest(['recomputed', 'stored']) AS side)
WHERE hour({ts('end_us')}) = 7 AND (end_us // 86400000000) % 3 = 0
""")
def evidence_recheck(spark, sf_dir):
    """Stored tables in which some labels were turned, some rows lost and some vectors damaged; the check must find exactly
    these.  Labels are derived again from probes and events, vectors from samples."""
    columns = ["host_id", "window_end", "label", "label_reason", "failure_event_id"]
    recomputed = common.labelled(spark, sf_dir).select(*columns)
    hour = F.hour("window_end")
    turned = F.when(hour == 5, 1 - F.coalesce("label", F.lit(2))).otherwise(F.col("label")).cast("int")
    path = tables.scratch_path(spark, "labels")
    recomputed.filter(hour != 7).withColumn("label", turned).write.parquet(path)
    stored = spark.read.parquet(path)
    found = splits.evidence_recheck(stored, recomputed).select(F.lit("labels").alias("part"), "host_id", "window_end", "missing_from")
    # Sums of doubles may differ in the last digits from run to run.  Both sides are rounded alike, in doubles alone.
    rounded = F.transform("feature_values", lambda v: F.rint(v * 1e6) / 1e6)
    windows = features.feature_windows(domain.samples(spark, sf_dir), SPARSE, domain.as_of(spark, sf_dir))
    vectors = windows.select("host_id", "window_end", "schema_hash", rounded.alias("feature_values"))
    day = (F.unix_micros("window_end") / (86400 * 10**6)).cast("bigint")
    spoiled = (hour == 7) & (day % 3 == 0)
    moved = F.transform("feature_values", lambda v, i: F.when(i == 0, v + 1).otherwise(v))
    kept = tables.scratch_path(spark, "vectors")
    vectors.withColumn("feature_values", F.when(spoiled, moved).otherwise(F.col("feature_values"))).write.parquet(kept)
    again = splits.evidence_recheck(spark.read.parquet(kept), vectors).select(
        F.lit("vectors").alias("part"), "host_id", "window_end", "missing_from"
    )
    return found.unionByName(again)


# ---- evaluation ----------------------------------------------------------------------------------

# Every measure is taken for each split on its own, purged rows left out.  The cutoff is the one with the best
# F1 on the validation split; test rows never take part in choosing it.
oracle.cte("v_evaluated", """
SELECT c.host_id, c.end_us, c.label, c.split, c.failure_event_id, c.failure_type, c.onset_us, p.probability, p.anomaly_score
FROM v_labelled_chrono c JOIN v_predictions p ON p.host_id = c.host_id AND p.end_us = c.end_us WHERE c.split <> 'purged'
""")
oracle.cte("v_cutoff", """
SELECT t AS cutoff, coalesce(2.0 * count(*) FILTER (WHERE probability >= t AND label = 1)
    / nullif(count(*) FILTER (WHERE probability >= t) + count(*) FILTER (WHERE label = 1), 0), 0.0) AS f1
FROM (SELECT * FROM v_evaluated WHERE split = 'validation')
CROSS JOIN (SELECT DISTINCT probability AS t FROM v_evaluated WHERE split = 'validation' UNION SELECT unnest([0.0, 0.5, 1.0]))
GROUP BY t ORDER BY f1 DESC, t DESC LIMIT 1
""")
oracle.cte("v_scored", "SELECT j.*, cutoff FROM v_evaluated j CROSS JOIN v_cutoff")

SPLIT = ["split"]


def judged(spark, sf_dir):
    """Labelled windows of a split with their scores."""
    scores = domain.predictions(spark, sf_dir).select("host_id", "window_end", "probability", "anomaly_score")
    return _chrono(spark, sf_dir).filter("split <> 'purged'").join(scores, ["host_id", "window_end"])


def scored(spark, sf_dir):
    """The same with the cutoff chosen on validation: one row against all."""
    rows = checkpointed(judged(spark, sf_dir))
    chosen = ev.select_threshold(rows.filter("split = 'validation'")).select(F.col("threshold").alias("cutoff"))
    return rows.join(F.broadcast(chosen))


_PR = """
SELECT {keys} tn, fp, fn, tp, {precision} AS precision, {recall} AS recall, {f1} AS f1 FROM (
SELECT {keys} count(*) FILTER (WHERE label = 0 AND probability < cutoff) AS tn, count(*) FILTER (WHERE label = 0 AND probability >= cutoff) AS fp,
  count(*) FILTER (WHERE label = 1 AND probability < cutoff) AS fn, count(*) FILTER (WHERE label = 1 AND probability >= cutoff) AS tp
FROM v_scored GROUP BY ALL)
"""
_PRECISION = o6("coalesce(tp / nullif(tp + fp, 0), 0.0)")
_RECALL = o6("coalesce(tp / nullif(tp + fn, 0), 0.0)")
_F1 = o6("coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0)")


@query("confusion", _PR.format(keys="split,", precision=_PRECISION, recall=_RECALL, f1=_F1))
def confusion(spark, sf_dir):
    out = ev.confusion(scored(spark, sf_dir), F.col("cutoff"), SPLIT)
    return out.select("split", "tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


oracle.cte("v_curve", """
SELECT split, probability, n, pos, sum(n) OVER w AS seen, sum(pos) OVER w AS hits FROM (
  SELECT split, probability, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM v_evaluated GROUP BY split, probability)
WINDOW w AS (PARTITION BY split ORDER BY probability DESC)
""")


@query("average_precision", f"SELECT split, {o6('sum(pos * hits / seen) / sum(pos)')} AS average_precision FROM v_curve GROUP BY split")
def average_precision(spark, sf_dir):
    return ev.ranking(judged(spark, sf_dir), SPLIT).select("split", r6("average_precision").alias("average_precision"))


@query("roc_auc", f"""
SELECT split, {o6('(sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0))')} AS roc_auc
FROM (SELECT split, label, rank() OVER (PARTITION BY split ORDER BY probability) + (count(*) OVER (PARTITION BY split, probability) - 1) / 2.0 AS r FROM v_evaluated)
GROUP BY split
""")
def roc_auc(spark, sf_dir):
    return ev.ranking(judged(spark, sf_dir), SPLIT).select("split", r6("roc_auc").alias("roc_auc"))


@query("select_threshold", f"SELECT cutoff AS threshold, {o6('f1')} AS f1 FROM v_cutoff")
def select_threshold(spark, sf_dir):
    return ev.select_threshold(judged(spark, sf_dir).filter("split = 'validation'")).withColumn("f1", r6("f1"))


oracle.cte("v_bins", """
SELECT split, CAST(least(floor(probability * 10), 9) AS INTEGER) AS bin, count(*) AS "rows", avg(probability) AS mean_probability, avg(label) AS observed_rate
FROM v_evaluated GROUP BY 1, 2
""")


@query("reliability_bins", f"""SELECT split, bin, "rows", {o6('mean_probability')} AS mean_probability, {o6('observed_rate')} AS observed_rate FROM v_bins""")
def reliability_bins(spark, sf_dir):
    out = ev.reliability_bins(judged(spark, sf_dir), SPLIT)
    return out.select("split", "bin", "rows", r6("mean_probability").alias("mean_probability"), r6("observed_rate").alias("observed_rate"))


@query("brier", f"SELECT split, {o6('avg((probability - label) * (probability - label))')} AS brier FROM v_evaluated GROUP BY split")
def brier(spark, sf_dir):
    return ev.calibration(judged(spark, sf_dir), SPLIT).select("split", r6("brier").alias("brier"))


@query("ece", f"""SELECT split, {o6('sum("rows" * abs(mean_probability - observed_rate)) / sum("rows")')} AS ece FROM v_bins GROUP BY split""")
def ece(spark, sf_dir):
    return ev.calibration(judged(spark, sf_dir), SPLIT).select("split", r6("ece").alias("ece"))


@query("baselines", f"""
SELECT split, {o6('r')} AS always_warn_precision, {o6('2 * r / (1 + r)')} AS always_warn_f1, {o6('r')} AS random_average_precision
FROM (SELECT split, avg(label) AS r FROM v_evaluated GROUP BY split)
""")
def baselines(spark, sf_dir):
    out = ev.baselines(judged(spark, sf_dir), SPLIT)
    return out.select("split", *[r6(c).alias(c) for c in out.columns if c != "split"])


@query("exposure", f"""
SELECT split, CAST(n AS DOUBLE) AS host_hours, fp AS false_warnings, {o6('fp / n')} AS false_per_host_hour FROM (
SELECT split, count(*) FILTER (WHERE label = 0) AS n, count(*) FILTER (WHERE label = 0 AND probability >= cutoff) AS fp FROM v_scored GROUP BY split)
""")
def exposure(spark, sf_dir):
    return ev.exposure(scored(spark, sf_dir), F.col("cutoff"), SPARSE, SPLIT).withColumn("false_per_host_hour", r6("false_per_host_hour"))


oracle.cte("v_warned", "SELECT split, host_id, end_us, label FROM v_scored WHERE probability >= cutoff")
oracle.cte("v_epochs", f"""(split, host_id, at_us) AS
SELECT split, host_id, min(end_us) FROM v_warned GROUP BY split, host_id
UNION ALL
SELECT e.split, e.host_id, (SELECT min(w.end_us) FROM v_warned w WHERE w.split = e.split AND w.host_id = e.host_id AND w.end_us >= e.at_us + {SPARSE.epoch_cooldown * 10**6})
FROM v_epochs e WHERE EXISTS (SELECT 1 FROM v_warned w WHERE w.split = e.split AND w.host_id = e.host_id AND w.end_us >= e.at_us + {SPARSE.epoch_cooldown * 10**6})
""")


@query("alert_epochs", f"""
SELECT e.split, e.host_id, {ts('e.at_us')} AS epoch_at, CAST(w.label AS INTEGER) AS label
FROM v_epochs e JOIN v_warned w ON w.split = e.split AND w.host_id = e.host_id AND w.end_us = e.at_us
""")
def alert_epochs(spark, sf_dir):
    return ev.alert_epochs(scored(spark, sf_dir), F.col("cutoff"), SPARSE, SPLIT)


@query("false_alert_rates", f"""
SELECT split, coalesce(n, 0) AS false_epochs, {o6('coalesce(n, 0) / h')} AS per_host_hour, {o6('coalesce(n, 0) / h * 24')} AS per_host_day FROM
(SELECT split, count(*) FILTER (WHERE label = 0) AS h FROM v_evaluated GROUP BY split) LEFT JOIN
(SELECT e.split, count(*) AS n FROM v_epochs e JOIN v_warned w ON w.split = e.split AND w.host_id = e.host_id AND w.end_us = e.at_us
  WHERE w.label = 0 GROUP BY e.split) USING (split)
""")
def false_alert_rates(spark, sf_dir):
    out = ev.false_alert_rates(scored(spark, sf_dir), F.col("cutoff"), SPARSE, SPLIT)
    return out.select("split", "false_epochs", r6("per_host_hour").alias("per_host_hour"), r6("per_host_day").alias("per_host_day"))


oracle.cte("v_leads", f"""
SELECT split, failure_event_id, failure_type, min(end_us) FILTER (WHERE probability >= cutoff AND onset_us - end_us >= {SPARSE.min_lead * 10**6}) AS first_us,
  max(onset_us) AS onset_us, count(*) AS eligible_windows FROM v_scored WHERE label = 1 GROUP BY ALL
""")


@query("lead_time", f"""
SELECT split, failure_event_id, failure_type, {ts('first_us')} AS earliest_warning, (onset_us - first_us) / 1000000.0 AS lead_seconds, eligible_windows FROM v_leads
""")
def lead_time(spark, sf_dir):
    return ev.lead_times(scored(spark, sf_dir), F.col("cutoff"), SPARSE, SPLIT)


@query("mean_lead", f"""
SELECT split, {o6('avg((onset_us - first_us) / 1000000.0)')} AS mean_lead_seconds, count(first_us) AS warned, count(*) AS failures FROM v_leads GROUP BY split
""")
def mean_lead(spark, sf_dir):
    return ev.mean_lead(ev.lead_times(scored(spark, sf_dir), F.col("cutoff"), SPARSE, SPLIT), SPLIT).withColumn(
        "mean_lead_seconds", r6("mean_lead_seconds")
    )


oracle.cte("v_typed", """
SELECT s.split, t.kind AS failure_type, s.probability, s.cutoff, CASE WHEN s.label = 1 THEN 1 ELSE 0 END AS y
FROM v_scored s JOIN (SELECT DISTINCT split, failure_type AS kind FROM v_scored WHERE label = 1) t
ON s.split = t.split AND (s.label = 0 OR s.failure_type = t.kind)
""")
oracle.cte("v_typed_curve", """
SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS hits FROM (
  SELECT split, failure_type, probability, count(*) AS n, sum(y) AS pos FROM v_typed GROUP BY split, failure_type, probability)
WINDOW w AS (PARTITION BY split, failure_type ORDER BY probability DESC)
""")


@query("per_failure_type", f"""
SELECT split, failure_type, tn, fp, fn, tp, {_PRECISION} AS precision, {_RECALL} AS recall, {_F1} AS f1,
  {o6('ap')} AS average_precision, {o6('auc')} AS roc_auc FROM
(SELECT split, failure_type, count(*) FILTER (WHERE y = 0 AND probability < cutoff) AS tn, count(*) FILTER (WHERE y = 0 AND probability >= cutoff) AS fp,
  count(*) FILTER (WHERE y = 1 AND probability < cutoff) AS fn, count(*) FILTER (WHERE y = 1 AND probability >= cutoff) AS tp FROM v_typed GROUP BY split, failure_type)
JOIN (SELECT split, failure_type, sum(pos * hits / seen) / sum(pos) AS ap,
  sum((n - pos) * (hits - pos / 2.0)) / (sum(pos) * sum(n - pos)) AS auc FROM v_typed_curve GROUP BY split, failure_type) USING (split, failure_type)
""")
def per_failure_type(spark, sf_dir):
    out = ev.per_failure_type(scored(spark, sf_dir), F.col("cutoff"), SPLIT)
    measures = ("precision", "recall", "f1", "average_precision", "roc_auc")
    return out.select("split", "failure_type", "tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in measures])


@query("anomaly_summary", f"""
SELECT split, {o6('avg(anomaly_score)')} AS mean, min(anomaly_score) AS low, max(anomaly_score) AS high FROM v_evaluated GROUP BY split
""")
def anomaly_summary(spark, sf_dir):
    return ev.anomaly_summary(judged(spark, sf_dir), SPLIT).withColumn("mean", r6("mean"))


@query("calibration_trigger", f"""
SELECT {o6('brier')} AS brier, {o6('ece')} AS ece, {o6('constant_brier')} AS constant_brier, ece > 0.1 OR brier > constant_brier AS recalibrate FROM
(SELECT avg((probability - label) * (probability - label)) AS brier, avg((label - r) * (label - r)) AS constant_brier
 FROM v_scored, (SELECT avg(label) AS r FROM v_scored WHERE split = 'train') WHERE split = 'validation'),
(SELECT sum(abs(p - y)) / sum(n) AS ece FROM (SELECT least(floor(probability * 10), 9) AS bin, count(*) AS n, sum(probability) AS p, sum(label) AS y
  FROM v_scored WHERE split = 'validation' GROUP BY 1))
""")
def calibration_trigger(spark, sf_dir):
    every = checkpointed(scored(spark, sf_dir))
    prevalence = every.filter("split = 'train'").agg(F.avg(F.col("label").cast("double")).alias("prevalence"))
    out = ev.calibration_trigger(every.filter("split = 'validation'"), prevalence)
    return out.select(*[r6(c).alias(c) for c in ("brier", "ece", "constant_brier")], "recalibrate")


@query("class_weight", f"""
SELECT {o6('count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1)')} AS positive_weight FROM v_labelled_chrono WHERE split = 'train'
""")
def class_weight(spark, sf_dir):
    train = _chrono(spark, sf_dir).filter("split = 'train'")
    n = [F.sum(F.when(F.col("label") == v, 1).otherwise(0)) for v in (0, 1)]
    return train.agg(r6(F.try_divide(n[0], n[1])).alias("positive_weight"))
