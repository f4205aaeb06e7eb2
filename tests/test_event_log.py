"""Logs with manifests: what is visible, replays, stored alerts."""

import pytest
from pyspark.sql import functions as F

from augury.operators import incidents as inc
from augury.settings import LIVE
from augury.sources.event_log import REGISTRY, EventLog, append_stream, register_model, registered
from tests.helpers import at

ROWS = "k bigint, v string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROWS)


def seen(log):
    return sorted((r["k"], r["v"]) for r in log.read().collect())


def test_only_commits_are_visible(spark, tmp_path):
    log = EventLog(spark, str(tmp_path), ROWS)
    assert seen(log) == [] and log.read().columns == ["k", "v", "commit"]
    assert log.commit(rows(spark, (1, "a"), (1, "a")), "one")
    assert not log.commit(rows(spark, (9, "other")), "one")
    log.stage(rows(spark, (7, "half written")))
    assert log.commit(rows(spark).limit(0), "empty") and log.commit(rows(spark, (None, None)).withColumn("x", F.lit(1)), "nulls")
    assert [(r["k"], r["v"], r["commit"]) for r in log.read().orderBy("commit", "k").collect()] == [(None, None, "nulls"), (1, "a", "one"), (1, "a", "one")]
    # two writers of one id: every reader sees the same one
    for v in "xy":
        log.publish("race", log.stage(rows(spark, (5, v))))
    assert len([r for r in log.read().collect() if r["k"] == 5]) == 1


def test_compaction_shows_the_same_rows_and_remembers_ids(spark, tmp_path):
    log = EventLog(spark, str(tmp_path), ROWS)
    for i in range(4):
        log.commit(rows(spark, (i, "v")), f"c{i}")
    before = seen(log)
    log.compact(1)
    assert seen(log) == before and len(log.live()) == 1
    assert not log.commit(rows(spark, (2, "again")), "c2") and log.commit(rows(spark, (4, "v")), "c4")
    log.compact()
    assert seen(log) == [*before, (4, "v")] and len(log.live()) == 1


def test_a_stream_started_again_loses_and_doubles_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    log = EventLog(spark, str(tmp_path / "log"), ROWS)
    stream = lambda n: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", n).parquet(source)
    for i in range(4):
        rows(spark, (i, "v")).coalesce(1).write.mode("append").parquet(source)
    append_stream(stream(1), log, str(tmp_path / "a")).awaitTermination()
    assert seen(log) == [(i, "v") for i in range(4)]
    rows(spark, (4, "v")).coalesce(1).write.mode("append").parquet(source)
    append_stream(stream(1), log, str(tmp_path / "a")).awaitTermination()
    assert seen(log) == [(i, "v") for i in range(5)]
    append_stream(stream(3), log, str(tmp_path / "b")).awaitTermination()  # its checkpoint was lost, other borders
    assert sorted(set(seen(log))) == [(i, "v") for i in range(5)]


def test_a_model_comes_with_its_evaluation(spark, tmp_path):
    log = EventLog(spark, str(tmp_path), REGISTRY)
    model = lambda t: spark.createDataFrame([("m", t)], "model_id string, threshold double")
    run = spark.createDataFrame([("test", 0.9), ("validation", None)], "part string, auc double")
    assert register_model(log, "v1", model(0.5), run) and not register_model(log, "v1", model(0.5), run)
    with pytest.raises(ValueError, match="v1"):
        register_model(log, "v1", model(0.6), run)
    assert [tuple(r) for r in registered(log, "model", "model_id string, threshold double").collect()] == [("v1", "m", 0.5)]
    assert sorted(tuple(r)[1:] for r in registered(log, "evaluation", "part string, auc double").collect()) == [("test", 0.9), ("validation", None)]


def _incidents(spark, *seconds, host="h"):
    made = [(f"i{s}", host, f"p{s}", at(s), at(s), at(s + 600)) for s in seconds]
    return spark.createDataFrame(made, "incident_id string, host_id string, prediction_id string, predicted_at timestamp, window_end timestamp, valid_until timestamp")


def test_cooldown_from_stored_alerts(spark):
    stored = spark.createDataFrame([("x", "h", "slack", at(900)), ("w", "h", "generic", at(100)), ("y", "other", "generic", at(990))], "alert_id string, host_id string, channel string, created_at timestamp")
    queued = inc.queue_alerts(_incidents(spark, 1000, 1100, 5000), stored, LIVE)
    due = {r["alert_id"]: r["next_attempt_at"].replace(tzinfo=None) for r in queued.collect()}
    want = {"i1000/generic": 1000, "i1000/slack": 1200, "i1100/generic": 1300, "i1100/slack": 1300, "i5000/generic": 5000, "i5000/slack": 5000}
    assert due == {k: at(v).replace(tzinfo=None) for k, v in want.items()}
    # what is stored is queued no more; four channels push a channel's alert out of the three that count
    again = inc.queue_alerts(_incidents(spark, 1000), queued.select("alert_id", "host_id", "channel", "created_at"), LIVE)
    assert again.count() == 0
    many = inc.queue_alerts(_incidents(spark, 1000, 1100), stored.limit(0), LIVE, channels=("a", "b", "c", "d")).filter("incident_id = 'i1100'")
    held = {r["channel"]: r["next_attempt_at"].replace(tzinfo=None) for r in many.collect()}
    assert held == {c: at(1100 if c == "a" else 1300).replace(tzinfo=None) for c in "abcd"}


def test_interrupted_deliveries(spark):
    changes = [
        ("a", 1, "sending", at(10), None), ("a", 1, "answered", at(11), 503), ("a", 2, "sending", at(40), None),  # interrupted
        ("b", 1, "sending", at(10), None), ("b", 1, "answered", at(12), 200), ("c", 1, "sending", at(200), None),  # underway
        ("d", 1, "answered", at(12), 200),  # never begun
    ]
    log = spark.createDataFrame(changes, "alert_id string, number int, change string, at timestamp, status_code int")
    known, underway = inc.delivery_attempts(log, F.lit(at(100)))
    assert [r["alert_id"] for r in underway.collect()] == ["c"]
    alerts = spark.createDataFrame([(x, at(0)) for x in "abcd"], "alert_id string, next_attempt_at timestamp")
    got = {r["alert_id"]: (r["status"], r["attempt_count"]) for r in inc.delivery_outcomes(alerts, known).collect()}
    assert got == {"a": ("unknown", 2), "b": ("delivered", 1), "c": ("pending", 0), "d": ("pending", 0)}
