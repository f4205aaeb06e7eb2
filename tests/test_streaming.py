"""Streams against hand-made rows."""

import random
from datetime import timezone

from pyspark.sql import functions as F

from augury.operators import features, probes
from augury.settings import LIVE, SPARSE
from augury.streaming import pipelines as st
from tests.helpers import at, samples

CPU = "cpu_usage_percent"


def test_contradicting_samples_are_left_out_of_the_stream(spark, tmp_path):
    rows = [("h", CPU, 10, 1.0), ("h", CPU, 10, 2.0), ("h", CPU, 20, 3.0), ("h", CPU, 20, 3.0), ("h", CPU, 9000, 0.0)]
    given = samples(spark, rows)
    given.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(given.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    frame = st.feature_stats_stream(stream, LIVE, 60)
    st.run_once(frame, str(tmp_path / "rows"), str(tmp_path / "progress"))
    got = spark.read.schema(frame.schema).parquet(str(tmp_path / "rows")).orderBy("window_end").collect()
    assert len(got) == 15  # every window of 900 s that ends on a minute and holds second 20
    assert {(r["latest"], r["mean"], r["min"], r["max"]) for r in got} == {(3.0, 3.0, 3.0, 3.0)}


def _fed(spark, tmp_path, name, given, parts, make):
    """Rows of a stream fed file by file; parts: conditions, one for each file in order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    folder = tmp_path / name
    for i, part in enumerate(parts):
        given.where(part).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        frame = make(stream)
        st.run_once(frame, str(folder / "rows"), str(folder / "progress"))
    return sorted(map(tuple, spark.read.schema(frame.schema).parquet(str(folder / "rows")).collect()), key=repr)


def _probe_rows(spark):
    rng = random.Random(3)
    rows, state = [], False
    for i in range(600):
        state = state != (rng.random() < 0.15)
        # Two probes of one instant now and then.
        rows.append((f"h{i % 3}", i, at(10 * (i // 6) + i % 6), state, "down" if state else "ok"))
    rows.append(("h0", 9999, at(100_000), False, "ok"))
    return spark.createDataFrame(rows, "host_id string, probe_id bigint, observed_at timestamp, breached boolean, outcome string")


def test_late_probes_give_the_rows_of_ordered_ones(spark, tmp_path):
    given = _probe_rows(spark)
    p = LIVE.but(confirm_span=60, slice_seconds=100)
    make = lambda delay: lambda s: st.failure_events_stream(s, p, delay)
    end = F.col("probe_id") == 9999
    ordered = _fed(spark, tmp_path, "ordered", given, [F.lit(True)], make(2000))
    mixed = _fed(spark, tmp_path, "mixed", given, [(F.col("probe_id") % 3 == k) & ~end for k in (2, 0, 1)] + [end], make(2000))
    assert len(ordered) > 20 and mixed == ordered
    full = given.withColumn("latency_seconds", F.lit(0.1)).withColumn("status_code", F.lit(200))
    batch = {(r["host_id"], r["event_id"], r["observed_at"], r["confirmed_at"]) for r in probes.failure_events(full, p).collect()}
    assert {(r[0], r[1], r[4], r[5]) for r in ordered if r[2] == "failure"} == batch


def test_a_silent_host_lets_its_incident_expire(spark, tmp_path):
    rows = [("a", "p1", at(60), at(61), 0.9), ("b", "q1", at(60), at(62), 0.1), ("b", "q2", at(5000), at(5001), 0.1), ("a", "late", at(120), at(400), 0.95)]
    given = spark.createDataFrame(rows, "host_id string, prediction_id string, window_end timestamp, predicted_at timestamp, probability double")
    make = lambda s: st.incidents_stream(s, 0.5, LIVE, 30)
    want = [("a", "i-p1", "forecast_expired_unconfirmed", at(60 + LIVE.horizon + LIVE.expiry_grace), False), ("a", "i-p1", "opened", at(61), True)]
    got = _fed(spark, tmp_path, "silent", given, [F.col("host_id") == "a", F.col("host_id") == "b"], make)
    assert [(h, i, c, t.replace(tzinfo=timezone.utc), x) for h, i, c, t, x in got] == want


def test_late_scores_open_nothing_and_repeated_ones_change_nothing(spark, tmp_path):
    rows = [("a", "p1", at(60), at(60 + LIVE.max_age + 1), 0.9), ("a", "p2", at(120), at(200), 0.9), ("a", "p2", at(120), at(200), 0.9), ("z", "n", at(9000), at(9000), 0.1)]
    given = spark.createDataFrame(rows, "host_id string, prediction_id string, window_end timestamp, predicted_at timestamp, probability double")
    got = _fed(spark, tmp_path, "late", given, [F.lit(True)], lambda s: st.incidents_stream(s, 0.5, LIVE, 30))
    assert [(g[1], g[2]) for g in got] == [("i-p2", "forecast_expired_unconfirmed"), ("i-p2", "opened")]


def test_open_windows_hold_a_sample_once(spark, tmp_path):
    """Each of 48 hourly samples lies in 24 windows; state takes it once for each chunk, not for each window."""
    given = samples(spark, [("h", CPU, 3600 * i + 5, float(i)) for i in range(48)])
    given.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    stream = spark.readStream.schema(given.schema).parquet(str(tmp_path / "in"))
    frame = st.feature_stats_stream(stream, SPARSE, 60)
    query = frame.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    written = sum(op.numRowsUpdated for p in query.recentProgress for op in p.stateOperators)
    assert 48 <= written < 3 * 48


def test_windows_of_a_stream_in_parts_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"h{i % 2}", "m", rng.randrange(0, 30_000) + i / 1000, rng.gauss(5, 2)) for i in range(300)]
    rows += [(h, "m", t, v) for h, _, t, v in rows[::20] for v in (v, v + 1.0)] + rows[1:40:9] + [("h0", "m", 60_000, 1.0)]
    given = samples(spark, rows)
    t, keys = F.unix_seconds("ts"), ["host_id", "metric", "end_us", "count", "latest", "median", "ewma"]
    parts = [t < 12_000, t.between(12_000, 12_500), t.between(12_501, 25_000), t > 25_000]
    make = lambda s: st.feature_stats_stream(s, LIVE, 60).select(*keys)
    batch = features.feature_stats(given, LIVE).filter(F.col("end_us") <= (60_000 - 60) * 10**6 - 1).select(*keys)
    want = sorted(map(tuple, batch.collect()), key=repr)
    assert len(want) > 500 and _fed(spark, tmp_path, "parts", given, parts, make) == want


def test_metrics_of_a_host_share_one_state(spark, tmp_path):
    """Three metrics of one host and chunk wake up together: one timer, not three; their windows are those of the batch."""
    rows = [("h", m, 60 * i + 7, float(i * k)) for k, m in enumerate((CPU, "memory_usage_percent", "error_rate"), 1) for i in range(20)] + [("h", CPU, 9000, 1.0)]
    given = samples(spark, rows)
    frame = lambda stream: st.feature_stats_stream(stream, LIVE, 60).select("host_id", "metric", "end_us", "count", "mean")
    got = _fed(spark, tmp_path, "shared", given, [F.lit(True)], frame)
    batch = features.feature_stats(given, LIVE).filter(F.col("end_us") <= 8940 * 10**6 - 1).select("host_id", "metric", "end_us", "count", "mean")
    assert got == sorted(map(tuple, batch.collect()), key=repr) and len(got) == 3 * 34
    query = frame(spark.readStream.schema(given.schema).parquet(str(tmp_path / "shared" / "in"))).writeStream.format("memory").queryName("shared")
    query = query.option("checkpointLocation", str(tmp_path / "again")).trigger(availableNow=True).start()
    query.awaitTermination()
    timers = [op.customMetrics["numRegisteredTimers"] for p in query.recentProgress for op in p.stateOperators]
    chunks = len({-(-t // 60) * 60 // 3600 + d for _, _, t, _ in rows for d in (0, 1)})
    assert 0 < timers[0] <= chunks
