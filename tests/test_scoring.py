import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import clean, console, evaluation as ev, incidents as inc, model, rates
from augury.operators.features import Contract
from augury.settings import LIVE
from augury.sources import tables
from tests.helpers import at, events, lit

SCORED = "host_id string, window_end timestamp, label int, probability double, failure_event_id string, failure_type string, failure_onset timestamp"


def scored(spark, rows):
    return spark.createDataFrame(
        [("h", at(60 * i), y, p, "e" if y else None, "latency_slo_breach" if y else None, at(600) if y else None) for i, (y, p) in enumerate(rows)],
        SCORED,
    )


def test_metrics(spark):
    f = scored(spark, [(0, 0.9), (0, 0.1), (1, 0.8), (1, 0.2)])
    c = ev.confusion(f, 0.5).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (1, 1, 1, 1) and c["f1"] == 0.5
    r = ev.false_alert_rates(f, 0.5, LIVE).first()
    assert r["false_epochs"] == 1 and r["per_host_hour"] == pytest.approx(30)
    lead = ev.lead_times(f, 0.5, LIVE).first()
    assert lead["lead_seconds"] == 480 and lead["eligible_windows"] == 2
    m = ev.ranking(f).first()
    assert m["roc_auc"] == pytest.approx(0.5)
    assert m["average_precision"] == pytest.approx((1 / 2 + 2 / 3) / 2)


def test_threshold_and_bins(spark):
    best = ev.select_threshold(scored(spark, [(0, 0.1), (0, 0.2), (1, 0.7), (1, 0.8)])).first()
    assert (best["threshold"], best["f1"]) == (0.7, 1.0)
    f = scored(spark, [(0, 0.0), (1, 1.0), (0, 0.3)])
    assert sum(r["rows"] for r in ev.reliability_bins(f).collect()) == 3
    assert ev.calibration(f).first()["brier"] == pytest.approx(0.03)


def test_cooldown_epochs(spark):
    f = scored(spark, [(0, 0.9)] * 12)
    starts = sorted(r["epoch_at"].minute for r in ev.alert_epochs(f, 0.5, LIVE).collect())
    assert starts == [0, 5, 10]


def test_normaliser(spark):
    long = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", None), ("b", None)], "feature string, value double")
    fitted = model.fit_normalizer(long)
    state = model.Normalizer.collect(fitted, ["a", "b"])
    assert state == model.Normalizer(["a", "b"], [3.0, 0.0], [3.0, 0.0], [1.0, 1.0])
    row = spark.createDataFrame([([100.0, None],)], "feature_values array<double>").select(state.column().alias("z")).first()
    assert row["z"] == [97.0, 0.0]


def test_vectors_are_scaled_in_batches(spark):
    """Missing and endless values become the median, a missing vector stays missing; no lambda runs for each value."""
    state = model.Normalizer(["a", "b"], [3.0, 0.5], [3.0, 0.0], [2.0, 1.0])
    rows = [(0, [5.0, None]), (1, None), (2, [float("inf"), -2.0]), (3, [float("nan"), 1e300])]
    f = spark.createDataFrame(rows, "i int, feature_values array<double>").coalesce(1).select("i", state.column().alias("z"))
    assert "zip_with" not in f._jdf.queryExecution().toString()
    assert {r["i"]: r["z"] for r in f.collect()} == {0: [1.0, 0.5], 1: None, 2: [0.0, -2.0], 3: [0.0, float("inf")]}


def test_probability_is_clipped(spark):
    f = spark.createDataFrame([(-1e9,), (0.0,), (1e9,)], "logit double")
    got = [r[0] for r in f.select(model.probability(F.col("logit"))).collect()]
    assert got[1] == 0.5 and all(0 <= g <= 1 for g in got)


def test_forest_and_attribution(spark):
    rng = np.random.default_rng(0)
    rows = [(f"h{i}", at(i), rng.normal(size=4).tolist()) for i in range(300)] + [("odd", at(0), [9.0, 9.0, -9.0, 9.0])]
    f = spark.createDataFrame(rows, "host_id string, window_end timestamp, normalized array<float>")
    forest = model.isolation_forest(f.filter("host_id <> 'odd'"), ["host_id", "window_end"], trees=50)
    assert forest.select("tree").distinct().count() == 50
    scores = {r["host_id"]: r["anomaly_score"] for r in model.anomaly_scores(f, forest, 300).collect()}
    assert scores["odd"] == max(scores.values()) and scores["odd"] > 0.1
    w = np.array([1.0, -2.0, 0.5, 0.0])
    high = f.withColumn("probability", F.lit(None).cast("double"))
    reference = np.array([r[2] for r in rows[:20]])
    wanted = model.Calibration(1.1, -0.3)
    z = F.aggregate(F.zip_with("normalized", F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    high = high.withColumn("probability", model.probability(z + 0.2, 1.1, -0.3))
    out = model.attribution(high.limit(10), ["host_id"], w, 0.2, wanted, reference)
    assert model.additivity(out).count() == 0
    assert all(abs(r["contributions"][3]) < 1e-12 for r in out.collect())


PRED = "prediction_id string, host_id string, model_id string, window_end timestamp, predicted_at timestamp, probability double, anomaly_score double, horizon_seconds int"


def predictions(spark, rows):
    return spark.createDataFrame([(f"p{t}", "h", "m", at(t), at(t + 2), p, 0.0, 600) for t, p in rows], PRED)


@pytest.mark.parametrize("slice_seconds", [600, 86400])
def test_incident_life_cycle(spark, slice_seconds):
    p = LIVE.but(slice_seconds=slice_seconds)
    scores = [0.9, 0.9, 0.1, 0.9, 0.1, 0.1, 0.1]
    opened = inc.open_incidents(predictions(spark, [(60 * i, s) for i, s in enumerate(scores)]), 0.5, p).collect()
    assert [(r["incident_id"], r["closed_as"]) for r in opened] == [("i-p0", "risk_cleared")]
    assert opened[0]["closed_at"].minute == 6
    crossings = inc.crossing(predictions(spark, [(60 * i, s) for i, s in enumerate(scores)]), 0.5, p).filter("crossing").count()
    assert crossings == 2
    lasting = inc.open_incidents(predictions(spark, [(60 * i, 0.9) for i in range(30)]), 0.5, p).orderBy("predicted_at").collect()
    # valid for 600 s plus 15 s grace after the opening window
    assert [r["incident_id"] for r in lasting] == ["i-p0", "i-p660", "i-p1320"]
    assert {r["closed_as"] for r in lasting} == {"forecast_expired_unconfirmed"}
    assert inc.enqueue_alerts(inc.open_incidents(predictions(spark, [(0, 0.9)]), 0.5, p), p).count() == 2


def failures(spark, rows):
    """rows: (id, onset, confirmed, recovered or None)"""
    return events(spark, [(i, "h", o, c, r) for i, o, c, r in rows])


def test_a_matched_failure_keeps_the_incident_open(spark):
    """High, three low ones, high again, while one failure lasts: one incident, not two."""
    scores = predictions(spark, [(60 * i, s) for i, s in enumerate([0.9, 0.1, 0.1, 0.1, 0.9])])
    lasting = failures(spark, [("f", 30, 60, None)])
    opened = inc.open_incidents(scores, 0.5, LIVE, lasting)
    assert [(r["incident_id"], r["open_until"]) for r in opened.collect()] == [("i-p0", None)]
    own = inc.attach_incidents(scores.filter("probability > 0.5"), opened, LIVE, until="closed_at").filter("incident_id IS NOT NULL")
    matched = inc.match_failures(opened, own, lasting, LIVE)
    assert inc.matches_of(opened).collect() == matched.collect()  # known since the opening
    status = inc.incident_status(opened, matched, lit(900)).collect()
    assert [(r["status"], r["resolved_at"]) for r in status] == [("observed", None)]
    over = inc.open_incidents(scores, 0.5, LIVE, failures(spark, [("f", 30, 60, 200)])).orderBy("predicted_at").collect()
    assert [r["incident_id"] for r in over] == ["i-p0", "i-p240"]


def test_a_closed_incident_is_matched_no_more(spark):
    scores = predictions(spark, [(60 * i, s) for i, s in enumerate([0.9, 0.1, 0.1, 0.1])])
    later = failures(spark, [("f", 400, 430, 500)])
    opened = inc.open_incidents(scores, 0.5, LIVE, later)
    assert [(r["closed_as"], r["open_until"]) for r in opened.collect()] == [("risk_cleared", opened.first()["closed_at"])]
    own = inc.attach_incidents(scores.filter("probability > 0.5"), opened, LIVE, until="closed_at").filter("incident_id IS NOT NULL")
    assert inc.match_failures(opened, own, later, LIVE).count() == 0


def test_two_models_at_one_instant_and_a_late_score(spark):
    rows = [("p1", "h", "m", at(0), at(2), 0.9, 0.0, 600), ("p2", "h", "n", at(0), at(2), 0.9, 0.0, 600), ("p3", "h", "m", at(0), at(900), 0.9, 0.0, 600)]
    opened = inc.open_incidents(spark.createDataFrame(rows, PRED), 0.5, LIVE, failures(spark, [])).collect()
    assert [r["incident_id"] for r in opened] == ["i-p1"]


def test_alert_timing(spark):
    rows = [(1, None, 600, 660), (2, 600, 600, 660), (3, 480, 600, 660), (4, 480, 600, 540)]
    f = spark.createDataFrame(
        [(i, at(d) if d is not None else None, at(o), at(v)) for i, d, o, v in rows],
        "i int, delivered_at timestamp, onset timestamp, valid_until timestamp",
    )
    got = [r[0] for r in f.orderBy("i").select(inc.alert_timing()).collect()]
    assert got == ["not_delivered", "after_degradation", "before_degradation", "outside_forecast_horizon"]


def test_delivery_fold(spark):
    alerts = spark.createDataFrame([(a, at(0)) for a in "abcde"], "alert_id string, next_attempt_at timestamp")
    log = [("a", 1, 200), ("b", 1, 503), ("b", 2, 429), ("b", 3, 500), ("c", 1, None), ("c", 2, 200), ("d", 1, 503)]
    attempts = spark.createDataFrame([(a, at(t), c) for a, t, c in log], "alert_id string, attempted_at timestamp, status_code int")
    got = {r["alert_id"]: r for r in inc.delivery_outcomes(alerts, attempts).collect()}
    assert {k: (r["status"], r["attempt_count"]) for k, r in got.items()} == {
        "a": ("delivered", 1), "b": ("failed", 3), "c": ("unknown", 1), "d": ("retry", 1), "e": ("pending", 0),
    }
    assert got["d"]["next_attempt_at"].second == 31


@pytest.mark.parametrize("age,horizon,p,ok", [(2, 600, 0.999, True), (2, 600, 0.99, False), (121, 600, 0.999, False), (60, 30, 0.999, False), (-10, 600, 0.999, False)])
def test_proposal_gate(spark, age, horizon, p, ok):
    now = 10_000
    f = spark.createDataFrame([(at(now - age), at(now - age), p, horizon, 0.5)], "window_end timestamp, predicted_at timestamp, probability double, horizon_seconds int, threshold double")
    assert f.select(inc.proposal_eligible("threshold", lit(now), LIVE)).first()[0] is ok


def test_host_status(spark):
    rows = [(1, None, None, False), (2, 91, False, False), (3, -1, False, False), (4, 0, False, False), (5, 1, True, False), (6, 1, False, True)]
    f = spark.createDataFrame([(i, at(1000 - a) if a is not None else None, b, x) for i, a, b, x in rows], "i int, observed_at timestamp, breached boolean, active_failure boolean")
    got = [r[0] for r in f.orderBy("i").select(console.host_status(lit(1000), LIVE)).collect()]
    assert got == ["unknown", "unknown", "unknown", "healthy", "degraded", "degraded"]


def test_counter_rates(spark):
    rows = [(0, 0, 100), (1, 2, 500), (2, 2, 600), (3, 4, 100)]
    f = spark.createDataFrame([("h", "c", at(t), i, v) for i, t, v in rows], "host_id string, counter string, ts timestamp, event_id bigint, value bigint")
    got = [r["rate"] for r in rates.counter_rate(f, LIVE).orderBy("event_id").collect()]
    assert got == [None, 200.0, None, None]


def test_bucket_quantile(spark):
    f = spark.createDataFrame([("a", 0.1, 50.0), ("a", 0.5, 90.0), ("a", 1.0, 100.0), ("a", float("inf"), 100.0), ("b", 0.1, 0.0), ("b", float("inf"), 0.0), ("c", 0.1, 1.0), ("c", float("inf"), 100.0)], "k string, le double, rate double")
    got = {r["k"]: r["quantile"] for r in rates.bucket_quantile(f, ["k"], 0.95).collect()}
    assert got == {"a": pytest.approx(0.75), "b": None, "c": 0.1}


def test_matrix_rejects_bad_documents(spark):
    good = '{"status":"success","data":{"resultType":"matrix","result":[{"metric":{"host_id":"a"},"values":[[1.5,"2"],[2,"NaN"]]}]}}'
    bad = ['{"status":"error"}', "nonsense", good.replace("matrix", "vector")]
    f = spark.createDataFrame([(d,) for d in [good, *bad]], "document string")
    rows = tables.matrix_flatten(f).collect()
    assert [(r["labels"]["host_id"], r["ts"].microsecond) for r in rows] == [("a", 500000), ("a", 0)]
    assert tables.matrix_rejected(f).count() == 3


def test_append_is_idempotent_and_registry_refuses(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 2)], "k string, v int")
    added = tables.append_once(old, new, ["k"], ["v"])
    assert [tuple(r) for r in added.collect()] == [("b", 2)]
    assert tables.append_once(old.unionByName(added), new, ["k"], ["v"]).count() == 0
    registry = spark.createDataFrame([("v1", 0.5)], "version string, threshold double")
    changed = spark.createDataFrame([("v1", 0.6)], "version string, threshold double")
    with pytest.raises(Exception, match="differs from its registration"):
        tables.registry_append(registry, changed, ["threshold"]).collect()


def test_dataset_digest_ignores_row_order(spark, tmp_path):
    f = spark.createDataFrame([("a", at(1), 1.5), ("b", at(2), None)], "k string, t timestamp, v double")
    a = tables.write_dataset(f, f.limit(0), "id", str(tmp_path))
    b = tables.write_dataset(f.orderBy(F.desc("k")), f.limit(0), "id", str(tmp_path))
    assert a == b
    back = tables.read_dataset(spark, a, "samples", f.schema)
    assert back.exceptAll(f).count() == 0 and back.count() == 2
    with pytest.raises(ValueError):
        tables.recent(f, "t", "k", 101)


@pytest.mark.parametrize("size", [1.0, 40.0, 4000.0])
def test_background_paths_equal_paths_walked_row_by_row(size):
    """Contributions, also far outside the range of exponentials, against whole paths computed for one row."""
    rng = np.random.default_rng(7)
    n, scaling = 12, model.Calibration(1.3, -0.4)
    w, ref, x = rng.normal(size=n) * size, rng.normal(size=(9, n)), rng.normal(size=n)
    first = rng.permutation(n)
    start, orders, want = ref @ w + 0.2, [first, first[::-1]], np.zeros(n)
    for order in orders:
        path = np.concatenate([start[:, None], start[:, None] + np.cumsum(((x - ref) * w)[:, order], axis=1)], axis=1)
        z = np.clip(path * scaling.slope + scaling.intercept, -50, 50)
        want[order] += np.diff((1.0 / (1.0 + np.exp(-z))).mean(axis=0)) / 2
    found = model.BackgroundPaths(w, start, ref, orders, scaling)
    assert np.allclose(found.contributions(x), want, rtol=1e-9, atol=1e-12)
    assert np.isclose(found.base + sum(found.contributions(x)), (1 / (1 + np.exp(-np.clip((x @ w + 0.2) * 1.3 - 0.4, -50, 50)))))


@pytest.mark.parametrize(
    "keys, values, bad",
    [(["a", "b"], [1.0, None], False), (["b", "a"], [None, 1.0], False), (["b", "a"], [1.0, None], True), (["a", "b"], [1.0, 2.0], True)],
)
def test_contract_compares_map_and_vector_in_any_order(spark, keys, values, bad):
    class Two:
        names, version, digest = ["a", "b"], "v", "d"

    row = spark.range(1).select(
        F.lit("v").alias("schema_version"), F.lit("d").alias("schema_hash"), F.array(F.lit("a"), F.lit("b")).alias("feature_names"),
        F.array(F.lit(1.0), F.lit(None).cast("double")).alias("feature_values"),
        F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.lit(v).cast("double") for v in values])).alias("features"),
    )
    assert row.select(clean.contract_violation(Two)).first()[0] is bad


def test_changes_are_read_off_their_places(spark):
    """Known differences and trends by name, without a map of all features for each window."""
    names = Contract.of(LIVE).names
    values = [None] * len(names)
    for name, v in (("memory_usage_percent.delta", -2.0), ("cpu_usage_percent.linear_trend", 0.5), ("cpu_usage_percent.mean", 7.0)):
        values[names.index(name)] = v
    window = spark.createDataFrame([("h", at(0), values), ("g", at(0), values)], "host_id string, window_end timestamp, feature_values array<double>")
    opened = spark.createDataFrame([("i", "h", at(0))], "incident_id string, host_id string, window_end timestamp")
    found = inc.feature_changes(opened, window).collect()
    assert [(r["incident_id"], [tuple(c) for c in r["changes"]]) for r in found] == [
        ("i", [("cpu_usage_percent.linear_trend", 0.5), ("memory_usage_percent.delta", -2.0)])
    ]
