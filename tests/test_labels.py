import pytest

from augury.operators import clean, labels, probes, splits
from augury.settings import LIVE
from tests.helpers import at, events, lit, probes as make_probes, windows

P = LIVE.but(confirm_count=1)
FULL = [("h", t, True) for t in range(0, 3000, 2)]


def label(spark, end, ev=(), pr=FULL, as_of=3000, p=P, known=True):
    rows = windows(spark, [("h", end - 900, end)])
    out = labels.label_windows(rows, events(spark, list(ev)), make_probes(spark, pr, known), lit(as_of), p).first()
    return out["label"], out["label_reason"], out["failure_event_id"]


def one(onset, recovered=None, confirmed=None, host="h", name="e"):
    return (name, host, onset, confirmed if confirmed is not None else onset + 6, recovered)


def test_horizon_edges(spark):
    assert label(spark, 0, [one(600, 620)])[0] == 1
    assert label(spark, 0, [one(601, 621)])[0] == 0
    assert label(spark, 600, [one(600)])[1] == "active_failure_or_recovery"


@pytest.mark.parametrize("end", [600, 610, 620, 1000, 1520])
def test_recovery_exclusion(spark, end):
    assert label(spark, end, [one(600, 620)])[1] == "active_failure_or_recovery"


def test_after_exclusion_is_negative(spark):
    assert label(spark, 1522, [one(600, 620)])[:2] == (0, "observed_healthy_horizon")


def test_unknown_confirmation_and_censoring(spark):
    breach = [(h, t, t != 600) for h, t, _ in FULL]
    value, reason, _ = label(spark, 0, [one(600, confirmed=606)], breach, as_of=603)
    assert (value, reason) == (None, "unconfirmed_degradation")
    assert label(spark, 2500)[1] == "right_censored"


def test_nearest_event_and_other_host(spark):
    assert label(spark, 100, [one(650, name="late"), one(600, name="near")])[2] == "near"
    assert label(spark, 100, [one(600, host="other")])[0] == 0


def test_coverage_gap_criteria(spark):
    assert label(spark, 100, pr=[("x", 0, True)])[1] == "incomplete_observation_coverage"
    gap = [r for r in FULL if not 200 < r[1] < 230]
    assert label(spark, 100, pr=gap)[1] == "observation_gap"
    assert label(spark, 100, known=False)[1] == "unknown_or_changed_criteria"


def test_sustained_mode(spark):
    p = LIVE.but(horizon=10)
    at_4_16 = [("h", t, t not in (4, 16)) for t in range(0, 60, 2)]
    at_4_6_8 = [("h", t, t not in (4, 6, 8)) for t in range(0, 60, 2)]
    assert label(spark, 0, pr=at_4_16, as_of=60, p=p)[:2] == (0, "observed_no_sustained_failure_horizon")
    assert label(spark, 0, pr=at_4_6_8, as_of=60, p=p)[1] == "unconfirmed_degradation"
    assert label(spark, 0, pr=at_4_16, as_of=11, p=p)[1] == "right_censored_confirmation"


def test_future_rows_change_nothing(spark):
    base = label(spark, 100, [one(600, 620)], as_of=1000)
    later = FULL + [("h", 5000, False)]
    assert label(spark, 100, [one(600, 620), one(900, confirmed=2000, name="x")], later, as_of=1000) == base


def test_probe_classes(spark):
    rows = [(1, 200, 0.1), (2, 200, 0.6), (3, 503, 0.01), (4, None, 3.0), (5, 404, 0.01)]
    f = spark.createDataFrame(rows, "probe_id int, status_code int, latency_seconds double")
    got = [r["outcome"] for r in clean.with_outcome(f, 0.5).orderBy("probe_id").collect()]
    assert got == ["healthy", "latency_slo_breach", "http_error_slo_breach", "service_unavailable", "unexpected_response"]


def detector_input(spark, flags, step=2, start=0):
    rows = [("h", i, at(start + step * i), b, "http_error_slo_breach" if b else "healthy", 0.1, 503 if b else 200) for i, b in enumerate(flags)]
    return spark.createDataFrame(
        rows,
        "host_id string, probe_id bigint, observed_at timestamp, breached boolean, outcome string, latency_seconds double, status_code int",
    )


@pytest.mark.parametrize("slice_seconds", [60, 86400])
def test_detector(spark, slice_seconds):
    p = LIVE.but(slice_seconds=slice_seconds)
    # recovery first does not count; breaches while open do not either
    flags = [False] * 4 + [True] * 5 + [False, False, True, False, False, False, False] + [True] * 3
    got = [r for r in probes.failure_events(detector_input(spark, flags), p).orderBy("observed_at").collect()]
    second = lambda t: (t.minute * 60 + t.second) if t else None
    assert [(r["event_id"], second(r["observed_at"]), second(r["confirmed_at"]), second(r["recovered_at"])) for r in got] == [
        ("f4", 8, 12, 24),
        ("f16", 32, 36, None),
    ]
    assert probes.failure_events(detector_input(spark, [True] * 2), p).count() == 0
    assert probes.failure_events(detector_input(spark, [True] * 3, step=8), p).count() == 0


def test_chronological_split(spark):
    ends = [10, 20, 30, 46, 60, 86]
    rows = windows(spark, [("h", m * 60 - 900, m * 60) for m in ends])
    p = LIVE.but(horizon=600, confirm_span=1)
    out = splits.chronological_split(rows, at(30 * 60).replace(tzinfo=None), at(70 * 60).replace(tzinfo=None), at(0).replace(tzinfo=None), p)
    got = {r["window_end"].minute + 60 * r["window_end"].hour: r["split"] for r in out.collect()}
    assert got == {10: "train", 20: "purged", 30: "purged", 46: "validation", 60: "purged", 86: "test"}
    with pytest.raises(ValueError):
        splits.chronological_split(rows, at(70 * 60), at(30 * 60), at(0), p)


def grouped(spark, ends, spans, p):
    rows = windows(spark, [("h", e - 900, e) for e in ends])
    ex = spark.createDataFrame([(f"x{i}", "h", at(a), at(b)) for i, (a, b) in enumerate(spans)], "experiment_id string, host_id string, started_at timestamp, ended_at timestamp")
    named = splits.group_ids(splits.window_experiments(rows, ex, lit(99999), p), p)
    return splits.purge_overlap(splits.grouped_split(named), p).collect()


def test_grouped_split(spark):
    p = LIVE.but(recovery_exclusion=60)
    merged = grouped(spark, [1900, 2800, 3700], [(2000, 2010), (3800, 3810)], p)
    assert {r["group_id"] for r in merged} == {"experiment:x0"} and {r["split"] for r in merged} == {"train"}
    apart = grouped(spark, [1800, 1900, 9800, 9900], [(2000, 2010), (10000, 10010)], p)
    assert sorted((r["window_end"].timestamp(), r["split"]) for r in apart) == [(1800, "train"), (1900, "train"), (9800, "test"), (9900, "test")]
    days = grouped(spark, [86390, 86410], [(500000, 500010)], p)
    assert sorted((r["window_end"].timestamp(), r["split"]) for r in days) == [(86390, "purged"), (86410, "test")]


def test_leakage_is_found(spark):
    pairs = spark.createDataFrame([("x", "train"), ("x", "test"), ("y", "train")], "experiment_id string, split string")
    assert [r["experiment_id"] for r in splits.experiment_leakage(pairs).collect()] == ["x"]


def test_recheck_opens_only_buckets_that_differ(spark):
    rows = [("hot", at(3600 * i), i % 2) for i in range(400)] + [("b", at(3600 * i), None) for i in range(50)] + [("b", None, 1)]
    stored = spark.createDataFrame(rows, "host_id string, window_end timestamp, label int")
    assert splits.differing_buckets(stored, stored.repartition(5), "window_end").count() == 0
    assert splits.evidence_recheck(stored, stored.repartition(5)).count() == 0
    turned = [(h, t, 1 - v if (h, t) == ("hot", at(3600 * 30)) else v) for h, t, v in rows if (h, t) != ("b", at(0))] + [("c", at(0), 1)] + rows[10:11]
    derived = spark.createDataFrame(turned, stored.schema)
    days = {(r["host_id"], str(r["day"])) for r in splits.differing_buckets(stored, derived, "window_end").collect()}
    assert days == {("hot", "1970-01-02"), ("hot", "1970-01-01"), ("b", "1970-01-01"), ("c", "1970-01-01")}
    got = sorted((r["host_id"], r["label"], r["missing_from"]) for r in splits.evidence_recheck(stored, derived).fillna(-1).collect())
    assert got == [("b", -1, "recomputed"), ("c", 1, "stored"), ("hot", 0, "recomputed"), ("hot", 0, "stored"), ("hot", 1, "stored")]
