"""Queries over models keep the windows they learn from, not every window."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import features, model
from augury.plans import queries_model as qm
from augury.settings import LIVE
from tests.helpers import at, samples

START = datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One healthy host with a CPU sample every hour of twenty days, of which the first ten or so are for training."""
    rows = [(i, START + timedelta(hours=i, seconds=7), 3, "click", 50.0 + i % 7, '{"k": 40}') for i in range(480)]
    path = str(tmp_path_factory.mktemp("healthy"))
    frame = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    frame.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def test_the_forest_writes_the_vectors_it_learns_from(spark, folder, monkeypatch):
    written = []

    def noted(frame):
        out = kept(frame)
        written.append((out.columns, out.count()))
        return out

    kept = qm.checkpointed
    monkeypatch.setattr(qm, "checkpointed", noted)
    assert qm.isolation_forest(spark, folder).select("tree").distinct().count() == model.TREES
    wide = [(c, n) for c, n in written if {"feature_values", "normalized"} & set(c)]
    assert wide and all("feature_names" not in c and 200 < n < 300 for c, n in wide)


def test_every_window_gets_its_anomaly_and_its_split(spark, folder):
    found = qm.anomaly_score(spark, folder)
    assert found.columns == ["host_id", "window_end", "label", "split", "anomaly_score"]
    rows = found.collect()
    assert len(rows) == len({r["window_end"] for r in rows}) > 470 and all(np.isfinite(r["anomaly_score"]) for r in rows)
    assert {r["split"] for r in rows} == {None, "train", "validation", "purged"}


def test_vectors_come_with_the_columns_of_the_windows_asked_for(spark):
    given = samples(spark, [(h, m, 30 * i + 1, i * k) for k, (h, m) in enumerate([("a", features.METRICS[0]), ("a", features.METRICS[4]), ("b", features.METRICS[0])], 1) for i in range(90)])
    asked = spark.createDataFrame(
        [("a", at(600), 1, "x"), ("a", at(600), None, "y"), ("b", at(1200), 0, None), ("b", at(1201), 1, "off"), ("c", at(600), 1, "none"), (None, at(600), 1, "n")],
        "host_id string, window_end timestamp, label int, split string",
    )
    found = features.window_vectors(given, LIVE, None, asked)
    assert sorted(((r["host_id"], r["label"], r["split"]) for r in found.collect()), key=repr) == [("a", 1, "x"), ("a", None, "y"), ("b", 0, None)]
    whole = features.feature_windows(given, LIVE)
    want = {(r["host_id"], r["window_end"]): r["feature_values"] for r in whole.collect()}
    assert all(r["feature_values"] == want[r["host_id"], r["window_end"]] for r in found.collect())
    assert features.window_vectors(given, LIVE).count() == len(want)
    assert features.feature_windows(given, LIVE, None, asked).count() == 2


def test_medians_shuffle_the_middle_alone(spark):
    """Ties, two middle values in different ranges, and few rows of the whole go to the sorted part."""
    rng = np.random.default_rng(3)
    data = {0: rng.normal(size=4001), 1: np.repeat([1.0, 2.0], 500), 2: np.concatenate([-rng.random(1000), 5 + rng.random(1000)]), 3: [0.0, -0.0, 7.0]}
    rows = [(int(k), float(v)) for k, vs in data.items() for v in vs]
    long = spark.createDataFrame(rows, "feature int, value double").repartition(6)
    found = model.exact_medians(long, "feature", "value")
    assert {r["feature"]: r["median"] for r in found.collect()} == {k: pytest.approx(float(np.median(v))) for k, v in data.items()}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("percentile_approx") == 0  # the limits are written once, so every pass cuts at the same ones


def test_window_keys_are_those_of_whole_vectors(spark):
    """Which windows there are follows from the CPU series alone, also with odd samples."""
    cpu, other = features.METRICS[0], features.METRICS[4]
    odd = [("h", cpu, 100, 1.0), ("h", cpu, 100, 2.0), ("h", cpu, 700, float("nan")), ("h", other, 300, 1.0), ("g", other, 50, 1.0), ("h", cpu, 1500, 3.0), ("h", cpu, 1500, 3.0), ("k", cpu, 61, 4.0)]
    given = samples(spark, odd)
    for as_of in (None, F.timestamp_micros(F.lit(1_560_000_000))):
        keys = features.window_keys(given, LIVE, as_of).select("host_id", "window_start", "window_end")
        whole = features.feature_windows(given, LIVE, as_of).select("host_id", "window_start", "window_end")
        assert keys.exceptAll(whole).count() == whole.exceptAll(keys).count() == 0 and keys.count() > 1
