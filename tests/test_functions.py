import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.functions import cut
from augury.functions.chain import greedy_chain
from augury.functions.intervals import merge_intervals, overlap_join
from augury.functions.ordered import Scan, asof, running, with_previous
from augury.functions.ranked import global_rank, running_totals
from augury.operators.model import exact_medians
from tests.helpers import at


def timeline(n=400, seed=1):
    """Two thirds of the rows belong to one key."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "b"]), i, rng.randrange(0, 5000), rng.choice([None, rng.randrange(100)])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(k, i, at(t), v) for k, i, t, v in rows], "k string, id bigint, ts timestamp, v bigint")


@pytest.mark.parametrize("slice_seconds", [7, 100, 100000])
def test_running_equals_unsliced(spark, slice_seconds):
    rows = timeline()
    out = running(
        frame(spark, rows),
        ["k"],
        "ts",
        ["id"],
        {
            "s": Scan("sum", "v"),
            "m": Scan("max", "v", inclusive=False),
            "l": Scan("last", "v"),
            "n": Scan("last", "v", inclusive=False, descending=True),
        },
        slice_seconds=slice_seconds,
    )
    got = {r["id"]: (r["s"], r["m"], r["l"], r["n"]) for r in out.collect()}
    for key in ("hot", "b"):
        ordered = sorted([r for r in rows if r[0] == key], key=lambda r: (r[2], r[1]))
        values = [r[3] for r in ordered]
        for i, r in enumerate(ordered):
            upto = [v for v in values[: i + 1] if v is not None]
            before = [v for v in values[:i] if v is not None]
            after = [v for v in values[i + 1 :] if v is not None]
            assert got[r[1]] == (
                sum(upto) if upto else None,
                max(before) if before else None,
                upto[-1] if upto else None,
                after[0] if after else None,
            )


def test_previous_crosses_empty_slices(spark):
    rows = [("a", 0, 0, 1), ("a", 1, 5000, 2), ("a", 2, 5001, 3)]
    out = with_previous(frame(spark, rows), ["k"], "ts", ["id"], ["v"], slice_seconds=10).orderBy("id").collect()
    assert [r["prev"]["v"] if r["prev"] else None for r in out] == [None, 1, 2]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_asof_equals_search(spark, forward, inclusive):
    left, right = timeline(150, 2), timeline(150, 3)
    out = asof(
        frame(spark, left),
        frame(spark, right).select("k", F.col("ts").alias("rts"), F.col("id").alias("rid")),
        ["k"],
        "ts",
        "rts",
        ["rid"],
        forward=forward,
        inclusive=inclusive,
        tie="rid",
        slice_seconds=300,
    )
    for r in out.collect():
        key, t = r["k"], next(x[2] for x in left if x[1] == r["id"])
        if forward:
            near = [(x[2], x[1]) for x in right if x[0] == key and (x[2] > t or (inclusive and x[2] == t))]
            want = min(near)[1] if near else None
        else:
            near = [(x[2], x[1]) for x in right if x[0] == key and (x[2] < t or (inclusive and x[2] == t))]
            want = max(near)[1] if near else None
        assert (r["match"]["rid"] if r["match"] else None) == want


def test_overlap_join_equals_nested_loop(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.choice("aab"), i, s := rng.randrange(3000), s + rng.randrange(400)) for i in range(n)]
    a, b = make(80), make(80)
    fa = spark.createDataFrame([(k, i, at(s), at(e)) for k, i, s, e in a], "k string, ai int, a1 timestamp, a2 timestamp")
    fb = spark.createDataFrame([(k, i, at(s), at(e)) for k, i, s, e in b], "k string, bi int, b1 timestamp, b2 timestamp")
    got = [(r["ai"], r["bi"]) for r in overlap_join(fa, fb, ["k"], ("a1", "a2"), ("b1", "b2"), bucket_seconds=90).collect()]
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]}
    assert len(got) == len(set(got)) and set(got) == want
    points = fa.withColumn("a2", F.col("a1"))
    kept = overlap_join(points, fb, ["k"], ("a1", "a1"), ("b1", "b2"), bucket_seconds=90, how="left")
    assert kept.select("ai").distinct().count() == 80
    with pytest.raises(ValueError):
        overlap_join(fa, fb, ["k"], ("a1", "a2"), ("b1", "b2"), bucket_seconds=90, how="left")


def test_merge_intervals(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 5, 7), ("a", 21, 30), ("b", 1, 2)]
    f = spark.createDataFrame([(k, at(s), at(e)) for k, s, e in rows], "k string, s timestamp, e timestamp")
    got = sorted((r["k"], r["s"].second, r["e"].second) for r in merge_intervals(f, ["k"], "s", "e", slice_seconds=3).collect())
    assert got == [("a", 0, 20), ("a", 21, 30), ("b", 1, 2)]


@pytest.mark.parametrize("slice_seconds", [50, 1000])
def test_greedy_chain_equals_walk(spark, slice_seconds):
    rng = random.Random(5)
    rows = {(rng.choice(["hot", "hot", "b"]), rng.randrange(4000)): rng.randrange(1, 50) for _ in range(700)}
    f = spark.createDataFrame([(k, t * 10**6, (t + d) * 10**6) for (k, t), d in rows.items()], "k string, t bigint, r bigint")
    got = {(r["k"], r["t"] // 10**6) for r in greedy_chain(f, "k", "t", "r", reach_seconds=50, slice_seconds=slice_seconds).collect()}
    want = set()
    for key in ("hot", "b"):
        resume = -1
        for t in sorted(t for k, t in rows if k == key):
            if t >= resume:
                want.add((key, t))
                resume = t + rows[(key, t)]
    assert got == want


@pytest.mark.parametrize("slice_seconds", [20, 300])
def test_long_jumps_widen_no_slice(spark, slice_seconds):
    """One jump of half the time, some of several slices, one without end; all other rows reach 10 s."""
    rng = random.Random(9)
    rows = {(k, t): rng.randrange(1, 10) for k in ("hot", "b") for t in rng.sample(range(4000), 900)}
    for key in rng.sample(sorted(rows), 12):
        rows[key] = rng.randrange(100, 900)
    rows["hot", 1500], rows["b", 3000] = 1900, None
    never = 2**63 - 1
    f = spark.createDataFrame([(k, t * 10**6, never if d is None else (t + d) * 10**6) for (k, t), d in rows.items()], "k string, t bigint, r bigint")
    got = {(r["k"], r["t"] // 10**6) for r in greedy_chain(f, "k", "t", "r", reach_seconds=10, slice_seconds=slice_seconds).collect()}
    want = set()
    for key in ("hot", "b"):
        resume = -1
        for t in sorted(t for k, t in rows if k == key):
            if t >= resume:
                want.add((key, t))
                resume = 10**9 if rows[key, t] is None else t + rows[key, t]
    assert got == want


def test_many_short_chains_cost_one_call_per_batch(spark):
    """2,000 keys with one slice of six rows each: a walk for each slice, and no Python call for each."""
    rows = [(f"k{i}", 10**6 * (t + 7 * i), 10**6 * (t + 7 * i + 2 + i % 3)) for i in range(2000) for t in range(6)]
    f = spark.createDataFrame(rows, "k string, t bigint, r bigint")
    chain = greedy_chain(f, "k", "t", "r", reach_seconds=5, slice_seconds=10**6)
    assert "FlatMapGroupsInPandas" not in chain._jdf.queryExecution().toString()
    got = {(r["k"], r["t"] // 10**6) for r in chain.collect()}
    assert got == {(f"k{i}", t + 7 * i) for i in range(2000) for t in range(0, 6, 2 + i % 3)}


def test_running_totals_and_rank(spark):
    rng = random.Random(6)
    values = sorted({rng.choice([0.5, rng.random()]) for _ in range(300)}, reverse=True)
    f = spark.createDataFrame([(v, 2) for v in values], "p double, n int")
    got = {r["p"]: r["seen"] for r in running_totals(f, "p", {"seen": "n"}).collect()}
    assert got == {v: 2 * (i + 1) for i, v in enumerate(values)}
    ranks = {r["p"]: r["rank"] for r in global_rank(f.repartition(7), [F.col("p").desc()]).collect()}
    assert ranks == {v: i + 1 for i, v in enumerate(values)}


def test_exact_medians(spark):
    rng = random.Random(7)
    data = {f: [rng.choice([1.0, rng.gauss(0, 5)]) for _ in range(n)] for f, n in (("a", 501), ("b", 200), ("c", 1), ("d", 2))}
    rows = [(f, v) for f, vs in data.items() for v in vs] + [("a", None), ("a", float("nan"))]
    got = {r["feature"]: r["median"] for r in exact_medians(spark.createDataFrame(rows, "feature string, value double"), "feature", "value").collect()}
    assert got == {f: pytest.approx(float(np.median(vs))) for f, vs in data.items()}


def test_a_cluster_needs_a_shared_folder(tmp_path):
    def session(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))

    assert cut.shared_folder(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert cut.shared_folder(session("local[4]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            cut.shared_folder(session(master))
