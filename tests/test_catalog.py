"""Registered queries against their SQL on the smallest data set."""

import os
from pathlib import Path

import duckdb
import pytest

from augury.plans.catalog import load

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
# A cross-section; the driver runs all of them on a larger set.
CHOSEN = [
    "feature_stats", "quality", "clean_samples", "training_eligible", "request_rate", "latency_p95", "failure_events",
    "labelled_windows", "group_ids", "average_precision", "alert_epochs", "open_incidents", "incident_status",
    "hosts_view", "experiment_view", "features_stream", "failure_events_stream", "incidents_stream",
    "alert_history", "registry_log", "receipts_log",
]


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return None if v != v else v + 0.0
        if hasattr(v, "isoformat"):
            return v.replace(tzinfo=None).isoformat()
        return v

    return sorted(([value(v) for v in r] for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test data not present")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, con, name):
    frame = QUERIES[name](spark, DIR)
    columns = sorted(frame.columns)
    result = con.execute(ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    want = plain([[r[i] for i in order] for r in result.fetchall()])
    assert plain([list(r) for r in frame.select(*columns).collect()]) == want


def test_every_query_has_sql_or_a_reason():
    without = set(QUERIES) - set(ORACLES)
    assert without == {
        "train_classifier", "model_selection", "platt",
        "isolation_forest", "anomaly_score", "score_windows_batch", "attribution",
    }
