import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.functions import merged
from augury.operators import clean, features
from augury.settings import LIVE
from tests.helpers import lit, samples


def stats_at(spark, rows, end, **params):
    p = LIVE.but(tick=end, **params)
    out = features.feature_stats(samples(spark, rows), p, lit(end)).filter(F.col("window_end") == lit(end))
    return {(r["host_id"], r["metric"]): r for r in out.collect()}


def test_window_statistics(spark):
    rows = [("a", "cpu_usage_percent", t, v) for t, v in ((100, 10), (110, 30), (130, 70))]
    r = stats_at(spark, rows, 130)[("a", "cpu_usage_percent")]
    assert r["linear_trend"] == pytest.approx(2)
    assert r["rate_of_change"] == pytest.approx(2)
    assert (r["delta"], r["percentage_change"], r["median"]) == (60, 600, 30)
    assert r["mean"] == pytest.approx(110 / 3)
    assert r["std"] == pytest.approx(math.sqrt(5600 / 9))
    assert r["rolling_variance"] == pytest.approx(5600 / 9)


@pytest.mark.parametrize("half_life", [60, 1])
def test_ewma_and_rolling_variance(spark, half_life):
    rows = [("a", "m", t, v) for t, v in ((1, 0), (301, 100), (361, 200))]
    r = stats_at(spark, rows, 361, half_life=half_life)[("a", "m")]
    if half_life == 60:
        assert r["ewma"] == pytest.approx(148.4375)
    else:
        e = 0 + (1 - 2**-300) * 100
        assert r["ewma"] == pytest.approx(e + (1 - 2**-60) * (200 - e))
    assert r["rolling_variance"] == pytest.approx(2500)
    assert r["percentage_change"] is None


def _plain(rows, end, p):
    """Statistics of the samples (t, v) of one window, one by one."""
    rows = sorted((t, v) for t, v in rows if end - p.window < t <= end)
    e = rows[0][1]
    for (t0, _), (t1, v) in zip(rows, rows[1:]):
        e += (1 - 2 ** (-(t1 - t0) / p.half_life)) * (v - e)
    ts, vs = [t for t, _ in rows], [v for _, v in rows]
    tm, vm, n = sum(ts) / len(ts), sum(vs) / len(vs), len(vs)
    recent = [v for t, v in rows if t > end - p.variance_window]
    tt = sum((t - tm) ** 2 for t in ts)
    return {
        "count": n,
        "latest": vs[-1],
        "mean": vm,
        "median": (sorted(vs)[(n - 1) // 2] + sorted(vs)[n // 2]) / 2,
        "std": (sum((v - vm) ** 2 for v in vs) / n) ** 0.5,
        "min": min(vs),
        "max": max(vs),
        "delta": vs[-1] - vs[0] if n > 1 else None,
        "linear_trend": sum((t - tm) * (v - vm) for t, v in rows) / tt if n > 1 else None,
        "ewma": e,
        "rolling_variance": sum((v - sum(recent) / len(recent)) ** 2 for v in recent) / len(recent) if recent else None,
    }


@pytest.mark.parametrize("half_life", [7, 500, 501, 36_000])  # of 3,600 s: no ratio changes the algorithm
def test_merged_panes_are_the_plain_statistics(spark, half_life):
    rng = random.Random(half_life)
    p = LIVE.but(window=3600, tick=120, half_life=half_life, variance_window=480)
    rows = [("a", "m", t, rng.gauss(50, 20)) for t in sorted(rng.sample(range(1, 20_000), 300)) if not 6000 < t < 11_000]
    rows += [("b", "m", 500 * p.window + i * 0.25, 1e6 + i % 3) for i in range(200)]
    got = features.feature_stats(samples(spark, rows), p).collect()
    for host in "ab":
        own = [(t, v) for h, _, t, v in rows if h == host]
        ends = {e for t, _ in own for e in range(-(-int(t * 4) // 480) * 120, int(t) + p.window + 120, 120) if e - p.window < t <= e}
        mine = {r["end_us"] // 10**6: r for r in got if r["host_id"] == host}
        assert set(mine) == ends
        for end, r in mine.items():
            for name, value in _plain(own, end, p).items():
                assert r[name] == (value if value is None else pytest.approx(value, rel=1e-7, abs=1e-9)), (host, end, name)


def test_series_are_merged_in_bounded_parts(monkeypatch):
    """Many series at once, cut into parts of any size, give the statistics of each one alone."""
    rng = random.Random(2)
    p = LIVE.but(window=600, tick=60, variance_window=120)
    series = [sorted((rng.randrange(0, 5000 * 10**6), rng.gauss(0, 9)) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    counts, t, v = np.array([len(s) for s in series]), *(np.array([x[i] for s in series for x in s]) for i in range(2))
    first, last = np.zeros(40, dtype="int64"), np.full(40, 5400 * 10**6)
    number, whole = merged.window_statistics(counts, t, v, first, last, features.grid(p))
    monkeypatch.setattr(merged, "WINDOWS", 100)
    monkeypatch.setattr(merged, "VALUES", 7)
    again, parts = merged.window_statistics(counts, t, v, first, last, features.grid(p))
    assert (number == again).all() and all(np.array_equal(whole[n], parts[n], equal_nan=True) for n in whole)
    at = 0
    for s, n in zip(series, number):
        rows = [(us / 10**6, x) for us, x in s]
        for i in range(at, at + n):
            for name, value in _plain(rows, int(whole["end_us"][i]) / 10**6, p).items():
                if name in whole and value is not None:
                    assert whole[name][i] == pytest.approx(value, rel=1e-7, abs=1e-9), name
        at += n
    assert at == len(whole["count"]) > 1000


def test_ratios_beyond_the_range_of_doubles(spark):
    """Weights of old samples vanish; they never take the newest with them."""
    p = LIVE.but(window=86_400, tick=3600, half_life=1, variance_window=3600)
    got = features.feature_stats(samples(spark, [("a", "m", 10, 5.0), ("a", "m", 80_000, 7.0)]), p).collect()
    assert {(r["count"], r["ewma"]) for r in got} == {(1, 5.0), (2, 7.0), (1, 7.0)}


def test_left_open_window_ignores_the_future(spark):
    rows = [("a", "m", t, v) for t, v in ((40, 9999), (41, 2), (70, 4), (100, 6), (101, 1e12))]
    r = stats_at(spark, rows, 100, window=60)[("a", "m")]
    assert (r["count"], r["latest"]) == (3, 6)
    again = stats_at(spark, rows + [("a", "m", 500, -1e9)], 100, window=60)[("a", "m")]
    assert again.asDict() == r.asDict()


def test_copies_collapse_and_conflicts_are_reported(spark):
    rows = [("a", "m", t, v) for t, v in ((10, 2), (9, 1), (10, 2), (11, float("nan")), (12, 1), (12, 3))]
    frame = samples(spark, rows)
    got = sorted((r["ts"].second, r["value"]) for r in clean.clean_samples(frame).collect())
    assert got == [(9, 1.0), (10, 2.0)]
    assert clean.conflicting_samples(frame).count() == 1


def test_vector_contract_nulls_and_cross_signals(spark):
    names = [
        "cpu_usage_percent",
        "memory_usage_percent",
        "disk_read_bytes_per_second",
        "disk_write_bytes_per_second",
        "network_receive_bytes_per_second",
        "network_transmit_bytes_per_second",
        "error_rate",
        "latency_p95_seconds",
    ]
    rows = [("a", m, t, i + (t - 10)) for i, m in enumerate(names, 1) for t in (10, 20)]
    p = LIVE.but(tick=20)
    out = features.feature_windows(samples(spark, rows), p, lit(20)).filter(F.col("window_end") == lit(20)).first()
    f = out["features"]
    contract = features.Contract.of(p)
    assert len(out["feature_values"]) == 209 and out["feature_names"] == contract.names
    assert f["cpu_trend_times_latency_trend"] == pytest.approx(1.0)
    assert f["error_trend_times_latency"] == pytest.approx(1 * 18)
    assert f["disk_throughput_times_latency"] == pytest.approx((13 + 14) * 18)
    assert f["network_change_times_error_rate"] == pytest.approx(2 * 17)
    assert f["swap_usage_percent.mean"] is None
    assert out["quality"]["swap_usage_percent"]["count"] == 0
    assert out["quality"]["cpu_usage_percent"]["coverage_seconds"] == 10


def test_contract_is_stable():
    c = features.Contract()
    assert c.version == "v1-w900-e60-r300" and len(c.names) == len(set(c.names)) == 209
    assert c.digest == features.Contract().digest != features.Contract(window=901).digest


def test_stale_host_has_no_window(spark):
    rows = [("a", "cpu_usage_percent", 800, 1), ("b", "cpu_usage_percent", 999, 1), ("b", "process_count", 500, 1)]
    p = LIVE.but(tick=1000)
    out = features.feature_windows(samples(spark, rows), p, lit(1000)).collect()
    assert [r["host_id"] for r in out] == ["b"]
    assert out[0]["features"]["process_count.mean"] is None
    fresh = clean.fresh_hosts(samples(spark, rows), lit(1000), 90).collect()
    assert [r["host_id"] for r in fresh] == ["b"]


def _shuffles(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_vectors_come_out_of_one_shuffle(spark):
    rows = [("a", m, 10 * i, i) for i in range(1, 50) for m in ("cpu_usage_percent", "process_count")]
    assert _shuffles(features.feature_windows(samples(spark, rows), LIVE, lit(600))) == 1


def _facts(row):
    return {(m, k): v for m, q in row["quality"].items() for k, v in q.asDict().items()} | row["features"]


def test_vectors_hold_the_statistics_of_fresh_metrics(spark):
    """Vectors merged side by side are those put together from the statistics of each series."""
    rng = random.Random(5)
    metrics = ["cpu_usage_percent", "process_count", "error_rate", "latency_p95_seconds", "not_in_the_contract"]
    rows = [(h, m, rng.randrange(1, 20_000), rng.gauss(3, 9)) for h in ("a", "b", None) for m in metrics for _ in range(60)]
    rows += [("c", "error_rate", 500, 1.0)]
    p = LIVE.but(window=3600, tick=120, variance_window=480, freshness=300)
    frame = samples(spark, rows)
    want = features.feature_vectors(features.feature_stats(frame, p, lit(20_000)), p).collect()
    got = features.feature_windows(frame, p, lit(20_000)).collect()
    keyed = lambda found: {(r["host_id"], r["window_end"]): _facts(r) for r in found}
    assert keyed(got) == keyed(want) and len(got) == len(want) > 100
    assert {r["host_id"] for r in got} == {"a", "b", None}


def test_only_the_windows_asked_for_become_vectors(spark):
    rows = [("ab"[i % 2], "cpu_usage_percent", 15 * i, i % 7) for i in range(1, 4000)]
    frame = samples(spark, rows)
    every = features.feature_windows(frame, LIVE, lit(60_000)).select("host_id", "window_end", "feature_values")
    some = every.filter((F.col("host_id") == "a") & (F.minute("window_end") == 7)).select("host_id", "window_end")
    off = some.select("host_id", (F.col("window_end") + F.expr("INTERVAL 1 SECOND")).alias("window_end"))
    asked = features.feature_windows(frame, LIVE, lit(60_000), some.union(some).union(off)).select(*every.columns)
    want = every.join(some, ["host_id", "window_end"])
    assert asked.count() == want.count() > 10
    assert asked.exceptAll(want).count() == 0


def test_busy_host_is_spread_over_chunks(spark):
    rows = [("hot", "m", 15 * i, i % 7) for i in range(4000)] + [("cold", "m", 15, 1)]
    placed = features.sliding_windows(samples(spark, rows), LIVE, lit(60000))
    assert placed.filter("host_id = 'hot'").select("chunk").distinct().count() > 10
    counts = placed.filter("host_id = 'hot'").groupBy("end_us").count()
    assert counts.filter(F.col("end_us") == 30000 * 10**6).first()["count"] == 60


def test_invalid_durations():
    with pytest.raises(ValueError):
        LIVE.but(window=0)
