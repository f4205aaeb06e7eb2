"""Splits and measures take every labelled window, whatever its CPU history."""

from datetime import datetime, timedelta

import duckdb
import pytest

from augury.plans.catalog import load

QUERIES, ORACLES = load()
START = datetime(2024, 1, 5)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One host with a healthy probe every hour of three days and a single CPU sample: no window spans four fifths of a day."""
    rows = [
        (i, START + timedelta(hours=i, seconds=7), 3, "click" if i == 20 else "view", 50.0, '{"k": 40}') for i in range(1, 72)
    ]
    path = str(tmp_path_factory.mktemp("short"))
    frame = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    frame.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name, rows", [("chronological_split", 12), ("group_ids", 12), ("plan_valid", 1)])
def test_windows_with_little_history_are_split(spark, folder, name, rows):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    found = QUERIES[name](spark, folder)
    want = con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0]
    assert found.count() == want == rows


WHOLE = (
    "experiment_components group_ids grouped_split purge_overlap experiment_leakage plan_valid split_status dataset_report confusion "
    "average_precision roc_auc select_threshold reliability_bins brier ece baselines exposure alert_epochs false_alert_rates lead_time "
    "mean_lead per_failure_type anomaly_summary calibration_trigger class_weight fit_normalizer"
).split()


@pytest.mark.parametrize("name", WHOLE)
def test_the_sql_takes_every_labelled_window(name):
    assert "v_labels" in ORACLES[name] and "v_dataset" not in ORACLES[name]


def test_a_report_counts_windows_with_little_history(spark, folder):
    assert sum(r["rows"] for r in QUERIES["dataset_report"](spark, folder).collect()) == 12
