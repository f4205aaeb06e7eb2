"""Quality of failure probabilities against labels.

Input rows carry host_id, window_end, label (0/1), probability, and for positives failure_event_id,
failure_type and failure_onset.  Ranking measures first collapse to one row per distinct
probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.functions.chain import greedy_chain
from augury.functions.clock import MICROS, micros, seconds_between
from augury.functions.cut import checkpointed
from augury.functions.ranked import running_totals
from augury.settings import Params

# Measures take ``by``: columns (a split, say) whose values are evaluated on their own.  A threshold is a
# number or a column of the scored rows.
Threshold = float | Column


def ratio(a: Column, b: Column) -> Column:
    """Quotient, zero where nothing was counted."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _scores_from_counts(frame: DataFrame) -> DataFrame:
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))
    return frame.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", f1)


def _cells(positive: Column, warned: Column) -> list[Column]:
    def n(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0))

    return [
        n(~positive & ~warned).alias("tn"),
        n(~positive & warned).alias("fp"),
        n(positive & ~warned).alias("fn"),
        n(positive & warned).alias("tp"),
    ]


def confusion(scored: DataFrame, threshold: Threshold, by: list[str] | None = None) -> DataFrame:
    cells = _cells(F.col("label") == 1, F.col("probability") >= threshold)
    return _scores_from_counts(scored.groupBy(*(by or [])).agg(*cells))


def _by_probability(scored: DataFrame, groups: list[str]) -> DataFrame:
    return scored.groupBy(*groups, "probability").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos")
    )


def ranking(scored: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Average precision (step integral) and ROC-AUC (ties count half) in one pass."""
    groups = groups or []
    curve = running_totals(_by_probability(scored, groups), "probability", {"seen": "n", "hits": "pos"}, groups=groups)
    return curve_measures(curve, groups)


def curve_measures(curve: DataFrame, groups: list[str]) -> DataFrame:
    negatives = F.col("n") - F.col("pos")
    total_pos, total_neg = F.sum("pos"), F.sum(negatives)
    step = F.sum(F.col("pos") * F.col("hits") / F.col("seen"))
    wins = F.sum(negatives * (F.col("hits") - F.col("pos") / 2.0))
    return curve.groupBy(*groups).agg(
        F.try_divide(step, total_pos).alias("average_precision"),
        F.try_divide(wins, total_pos * total_neg).alias("roc_auc"),
    )


def select_threshold(scored: DataFrame) -> DataFrame:
    """Cutoff with the best F1 among 0, 0.5, 1 and all probabilities; the larger one on ties."""
    spark = scored.sparkSession
    fixed = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "probability double").select(
        "probability", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos")
    )
    candidates = _by_probability(scored, []).unionByName(fixed).groupBy("probability").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos")
    )
    curve = running_totals(candidates, "probability", {"seen": "n", "hits": "pos"})
    best_possible = curve.agg(F.sum("pos").alias("positives"))
    f1 = ratio(2.0 * F.col("hits"), F.col("seen") + F.col("positives"))
    # One row joins one row of totals.
    return (
        curve.join(F.broadcast(best_possible))
        .select(F.col("probability").alias("threshold"), f1.alias("f1"))
        .orderBy(F.col("f1").desc(), F.col("threshold").desc())
        .limit(1)
    )


def reliability_bins(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    index = F.least(F.floor(F.col("probability") * 10), F.lit(9)).cast("int")
    return scored.groupBy(*(by or []), index.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("probability").alias("mean_probability"),
        F.avg(F.col("label").cast("double")).alias("observed_rate"),
    )


def calibration(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Brier score and expected calibration error over ten bins; both follow from bin sums."""
    error = F.pow(F.col("probability") - F.col("label"), F.lit(2.0))
    index = F.least(F.floor(F.col("probability") * 10), F.lit(9)).cast("int")
    bins = scored.groupBy(*(by or []), index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("probability").alias("p"),
        F.sum("label").alias("y"),
        F.sum(error).alias("e"),
    )
    return bins.groupBy(*(by or [])).agg(
        F.try_divide(F.sum("e"), F.sum("n")).alias("brier"),
        F.try_divide(F.sum(F.abs(F.col("p") - F.col("y"))), F.sum("n")).alias("ece"),
    )


def baselines(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What always warning and random ranking would reach."""
    rate = F.avg(F.col("label").cast("double"))
    return scored.groupBy(*(by or [])).agg(rate.alias("prevalence")).select(
        *(by or []),
        F.col("prevalence").alias("always_warn_precision"),
        ratio(2.0 * F.col("prevalence"), F.col("prevalence") + 1.0).alias("always_warn_f1"),
        F.col("prevalence").alias("random_average_precision"),
    )


def exposure(scored: DataFrame, threshold: Threshold, p: Params, by: list[str] | None = None) -> DataFrame:
    """False warnings per scored hour without failure; a row stands for one tick of a host."""
    negative = F.col("label") == 0
    hours = F.sum(F.when(negative, p.tick / 3600.0).otherwise(0.0))
    false = F.sum(F.when(negative & (F.col("probability") >= threshold), 1).otherwise(0))
    return scored.groupBy(*(by or [])).agg(hours.alias("host_hours"), false.alias("false_warnings")).select(
        *(by or []), "host_hours", "false_warnings", F.try_divide("false_warnings", "host_hours").alias("false_per_host_hour")
    )


def alert_epochs(scored: DataFrame, threshold: Threshold, p: Params, by: list[str] | None = None) -> DataFrame:
    """Warnings that would start a new alert under a per-host cooldown, with their label.

    A warning starts an epoch when the last epoch of its host is at least one cooldown ago.
    """
    by = by or []
    warned = checkpointed(
        scored.filter(F.col("probability") >= threshold).select(
            *by,
            "host_id",
            F.concat_ws("|", *by, "host_id").alias("chain"),
            micros("window_end").alias("at"),
            (micros("window_end") + F.lit(p.epoch_cooldown * MICROS)).alias("resume"),
            "label",
        )
    )
    chosen = greedy_chain(
        warned, "chain", "at", "resume", reach_seconds=p.epoch_cooldown, slice_seconds=p.slice_seconds
    )
    return chosen.join(warned, ["chain", "at"]).select(
        *by, "host_id", F.timestamp_micros("at").alias("epoch_at"), "label"
    )


def false_alert_rates(scored: DataFrame, threshold: Threshold, p: Params, by: list[str] | None = None) -> DataFrame:
    by = by or []
    extra = [] if isinstance(threshold, float) else [threshold.alias("__threshold")]
    scored = checkpointed(scored.select(*by, "host_id", "window_end", "label", "probability", *extra))
    if extra:
        threshold = F.col("__threshold")
    hours = exposure(scored, threshold, p, by).select(*by, "host_hours")
    epochs = alert_epochs(scored, threshold, p, by).filter("label = 0")
    false = epochs.groupBy(*by).agg(F.count(F.lit(1)).alias("false_epochs"))
    both = hours.join(false, by, "left") if by else hours.join(F.broadcast(false))
    both = both.withColumn("false_epochs", F.coalesce("false_epochs", F.lit(0)))
    rate = F.try_divide("false_epochs", "host_hours")
    return both.select(*by, "false_epochs", rate.alias("per_host_hour"), (rate * 24).alias("per_host_day"))


def lead_times(scored: DataFrame, threshold: Threshold, p: Params, by: list[str] | None = None) -> DataFrame:
    """Per failure: earliest warned window at least ``min_lead`` seconds ahead."""
    lead = seconds_between("failure_onset", "window_end")
    useful = (F.col("probability") >= threshold) & (lead >= p.min_lead)
    return (
        scored.filter("label = 1")
        .groupBy(*(by or []), "failure_event_id", "failure_type")
        .agg(
            F.min(F.when(useful, F.col("window_end"))).alias("earliest_warning"),
            F.max(F.when(useful, lead)).alias("lead_seconds"),
            F.count(F.lit(1)).alias("eligible_windows"),
        )
    )


def mean_lead(leads: DataFrame, by: list[str] | None = None) -> DataFrame:
    return leads.groupBy(*(by or [])).agg(
        F.avg("lead_seconds").alias("mean_lead_seconds"), F.count("lead_seconds").alias("warned"), F.count(F.lit(1)).alias("failures")
    )


def per_failure_type(scored: DataFrame, threshold: Threshold, by: list[str] | None = None) -> DataFrame:
    """Each failure type that occurs against all negatives.

    Rows collapse to (probability, type) counts before the negatives are shared by the types; the types
    present are one short list (for each value of ``by``).
    """
    by = by or []
    label, kind = F.col("label") == 1, F.col("failure_type")
    warned = (F.col("probability") >= threshold).alias("warned")
    counted = scored.groupBy(*by, F.when(label, kind).alias("kind"), "probability", warned).agg(F.count(F.lit(1)).alias("c"))
    kinds = scored.filter(label).groupBy(*by).agg(F.collect_set("failure_type").alias("kinds"))
    counted = counted.join(kinds, by) if by else counted.join(F.broadcast(kinds))
    spread = counted.select(
        *by,
        F.explode(F.when(F.col("kind").isNull(), F.col("kinds")).otherwise(F.array("kind"))).alias("failure_type"),
        "probability",
        "warned",
        F.when(F.col("kind").isNull(), 0).otherwise(F.col("c")).alias("pos"),
        "c",
    )
    groups = [*by, "failure_type"]
    grouped = spread.groupBy(*groups, "probability").agg(
        F.sum("c").alias("n"), F.sum("pos").alias("pos"), F.max("warned").alias("warned")
    )
    curve = running_totals(grouped, "probability", {"seen": "n", "hits": "pos"}, groups=groups)
    warned, negatives = F.col("warned"), F.col("n") - F.col("pos")
    cells = curve.groupBy(*groups).agg(
        F.sum(F.when(~warned, negatives).otherwise(0)).alias("tn"),
        F.sum(F.when(warned, negatives).otherwise(0)).alias("fp"),
        F.sum(F.when(~warned, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(warned, F.col("pos")).otherwise(0)).alias("tp"),
    )
    return _scores_from_counts(cells).join(curve_measures(curve, groups), groups)


def anomaly_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(by or [])).agg(
        F.avg("anomaly_score").alias("mean"), F.min("anomaly_score").alias("low"), F.max("anomaly_score").alias("high")
    )


def calibration_trigger(validation: DataFrame, train_prevalence: DataFrame) -> DataFrame:
    """Whether probabilities need recalibration: ECE above 0.1 or Brier worse than a constant guess."""
    base = validation.join(F.broadcast(train_prevalence)).agg(
        F.avg(F.pow(F.col("label") - F.col("prevalence"), F.lit(2.0))).alias("constant_brier")
    )
    return calibration(validation).join(F.broadcast(base)).select(
        "brier",
        "ece",
        "constant_brier",
        ((F.col("ece") > 0.1) | (F.col("brier") > F.col("constant_brier"))).alias("recalibrate"),
    )
