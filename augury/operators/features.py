"""Sliding feature windows: twelve statistics per metric, cross signals, quality, vectors."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.functions import merged
from augury.functions.clock import MICROS, ceil_to, finite_or_null, floor_to, is_finite, micros
from augury.settings import Params

# Fixed values of the feature contract, in contract order.
HOST_METRICS = (
    "cpu_usage_percent",
    "memory_usage_percent",
    "memory_available_bytes",
    "swap_usage_percent",
    "disk_usage_percent",
    "disk_read_bytes_per_second",
    "disk_write_bytes_per_second",
    "network_receive_bytes_per_second",
    "network_transmit_bytes_per_second",
    "process_count",
    "uptime_seconds",
    "cpu_load_1m",
    "cpu_load_5m",
    "cpu_load_15m",
)
APP_METRICS = ("request_rate", "error_rate", "latency_p95_seconds")
STATS = (
    "latest",
    "mean",
    "median",
    "std",
    "min",
    "max",
    "delta",
    "percentage_change",
    "linear_trend",
    "ewma",
    "rolling_variance",
    "rate_of_change",
)
CROSS_SIGNALS = (
    "cpu_trend_times_latency_trend",
    "memory_trend_times_latency_trend",
    "error_trend_times_latency",
    "disk_throughput_times_latency",
    "network_change_times_error_rate",
)
# Fixed wording that enters the contract digest.
CONTRACT_TERMS = {
    "bounds": "(end-window,end]",
    "missing": None,
    "std": "population",
    "trend": "OLS per second",
    "rate": "endpoint delta per second",
    "percentage_change": "100*delta/abs(first); undefined at zero",
    "ewma": "time-aware half-life, seeded with first observation",
    "variance": "population of samples after end-rolling-window",
    "cross": "products of named statistics; disk throughput is not utilization",
}
METRICS = HOST_METRICS + APP_METRICS


@dataclass(frozen=True)
class Contract:
    """Ordered feature names, version string and digest of a window configuration."""

    window: int = 900
    half_life: int = 60
    variance_window: int = 300

    @classmethod
    def of(cls, params: Params) -> "Contract":
        return cls(params.window, params.half_life, params.variance_window)

    @property
    def names(self) -> list[str]:
        return [f"{m}.{s}" for m in METRICS for s in STATS] + list(CROSS_SIGNALS)

    @property
    def version(self) -> str:
        return f"v1-w{self.window}-e{self.half_life}-r{self.variance_window}"

    @property
    def digest(self) -> str:
        body = {"version": self.version, "names": self.names, **CONTRACT_TERMS}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def chunk_us(p: Params) -> int:
    """Length of a chunk, a stretch of window ends."""
    span = max(4 * p.window, p.tick)
    return (span - span % p.tick) * MICROS


def in_chunks(samples: DataFrame, p: Params, as_of: Column | None = None) -> DataFrame:
    """Samples once for each chunk that has windows they lie in, with the first and last end (us) of these."""
    length, step = chunk_us(p), p.tick * MICROS
    t = micros("ts")
    first_end = ceil_to(t, p.tick)
    last_end = ceil_to(t + F.lit(p.window * MICROS), p.tick) - F.lit(step)
    if as_of is not None:
        last_end = F.least(last_end, floor_to(micros(as_of), p.tick))
    spans = samples.withColumn("__first", first_end).withColumn("__last", last_end)
    spans = spans.filter(F.col("__first") <= F.col("__last"))
    chunks = F.sequence(floor_to(F.col("__first"), length // MICROS), floor_to(F.col("__last"), length // MICROS), F.lit(length))
    return (
        spans.withColumn("chunk", F.explode(chunks))
        .withColumn("__from", F.greatest("__first", "chunk"))
        .withColumn("__to", F.least(F.col("__last"), F.col("chunk") + F.lit(length - step)))
    )


def _chunked(samples: DataFrame, p: Params, as_of: Column | None) -> DataFrame:
    """Place samples with all windows they can belong to.

    A chunk is a stretch of window ends of one host; it receives its own samples plus those of
    one window length before it.  After this single shuffle every later step (duplicate removal,
    predecessor, window aggregates, vectors) is local to the chunk, and a busy host is spread
    over its chunks.
    """
    # An explicit count keeps AQE from coalescing ahead of the windows.
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_chunks(samples, p, as_of).repartition(parts, "host_id", "chunk")


def _clean(samples: DataFrame, p: Params, as_of: Column | None) -> DataFrame:
    """Samples in their chunks: non-finite ones dropped, equal copies collapsed, contradicting instants left out."""
    finite = samples.filter(is_finite("value") & F.col("ts").isNotNull()).select("host_id", "metric", "ts", "value")
    return (
        _chunked(finite, p, as_of)
        .groupBy("host_id", "chunk", "metric", "ts", "__from", "__to")
        .agg(F.min("value").alias("value"), F.max("value").alias("__high"))
        .filter(F.col("value") == F.col("__high"))
    )


def sliding_windows(samples: DataFrame, p: Params, as_of: Column | None = None) -> DataFrame:
    """One row per (sample, window): left-open windows ``(end - W, end]`` on the tick grid.

    Statistics do not need this expansion: they merge panes.
    """
    return _clean(samples, p, as_of).select(
        "host_id",
        "chunk",
        "metric",
        "ts",
        "value",
        F.explode(F.sequence("__from", "__to", F.lit(p.tick * MICROS))).alias("end_us"),
    )


# ---- panes: summaries of a short stretch of a series that merge in time order (functions/merged)


def pane_seconds(p: Params) -> int:
    """Longest stretch of which windows, ticks and the variance window are whole multiples."""
    return math.gcd(p.window, p.tick, p.variance_window)


def grid(p: Params) -> merged.Grid:
    return merged.Grid(*(s * MICROS for s in (p.window, p.tick, pane_seconds(p), p.variance_window, p.half_life)))


WINDOW = "array<struct<" + ", ".join(f"{name}: {kind}" for name, kind in merged.FIELDS) + ">>"


def windows_of(samples: str, first: str, last: str, p: Params) -> Column:
    """Base statistics of a series' windows with ends (us) first, first + tick, ... last; samples: its (t, v), any order.

    Whole batches of series are merged at once."""
    durations, names = grid(p), [name for name, _ in merged.FIELDS]

    @F.arrow_udf(WINDOW)
    def merge(series: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        held = series.flatten()
        t, v = (held.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        counts, ends = np.diff(series.offsets.to_numpy()).astype("int64"), [x.to_numpy(zero_copy_only=False) for x in (low, high)]
        number, found = merged.window_statistics(counts, t, v, *ends, durations)
        rows = pa.StructArray.from_arrays([pa.array(found[n]) for n in names], names=names)
        return pa.ListArray.from_arrays(pa.array(np.append([0], np.cumsum(number)), pa.int32()), rows)

    return merge(samples, first, last)


def flat_windows(series: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window of the column ``windows``."""
    flat = series.select(*keys, F.explode("windows").alias("w")).select(*keys, "w.*")
    times = [F.timestamp_micros(f"{name}_us").alias(f"{name}_ts") for name in ("first", "last")]
    return finish_statistics(flat.select("*", *times), [*keys, "end_us"]).withColumn("window_end", F.timestamp_micros("end_us"))


def finish_statistics(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Derived statistics; the change-based ones need two samples, non-finite results are null."""
    several = F.col("count") > 1
    delta = F.col("latest") - F.col("__first")
    coverage = (micros("last_ts") - micros("first_ts")) / F.lit(float(MICROS))
    values = {
        "delta": F.when(several, delta),
        "percentage_change": F.when(several, F.try_divide(F.lit(100.0) * delta, F.abs("__first"))),
        "linear_trend": F.when(several, F.col("__slope")),
        "rate_of_change": F.when(several, F.try_divide(delta, coverage)),
    }
    stats = [finite_or_null(values.get(s, F.col(s))).alias(s) for s in STATS]
    return grouped.select(*keys, "count", "first_ts", "last_ts", coverage.alias("coverage_seconds"), *stats)


def feature_stats(samples: DataFrame, p: Params, as_of: Column | None = None) -> DataFrame:
    """Twelve statistics per (host, metric, window), merged from panes.

    A chunk's series is a row with the samples of at most five windows; its windows are read off that row, so no sample is
    copied to the windows it lies in, and all after the one shuffle is local to the chunk.
    """
    keys = ["host_id", "chunk", "metric"]
    series = _clean(samples, p, as_of).groupBy(*keys).agg(
        F.collect_list(F.struct(micros("ts").alias("t"), F.col("value").alias("v"))).alias("samples"),
        F.min("__from").alias("__from"),
        F.max("__to").alias("__to"),
    )
    return flat_windows(series.select(*keys, windows_of("samples", "__from", "__to", p).alias("windows")), keys)


def _stat(metric: str, stat: str) -> Column:
    return F.try_element_at("__stats", F.lit(metric))["values"][STATS.index(stat)]


def _placed(metric: str, stat: str) -> Column:
    return F.col("values")[METRICS.index(metric) * len(STATS) + STATS.index(stat)]


def cross_signals(stat: Callable[[str, str], Column] = _stat) -> list[Column]:
    """Products of named statistics; a missing operand leaves the signal missing."""
    latency, errors = "latency_p95_seconds", "error_rate"
    cpu = stat("cpu_usage_percent", "linear_trend") * stat(latency, "linear_trend")
    memory = stat("memory_usage_percent", "linear_trend") * stat(latency, "linear_trend")
    error = stat(errors, "linear_trend") * stat(latency, "latest")
    disk = (
        stat("disk_read_bytes_per_second", "latest") + stat("disk_write_bytes_per_second", "latest")
    ) * stat(latency, "latest")
    network = (
        stat("network_receive_bytes_per_second", "rate_of_change")
        + stat("network_transmit_bytes_per_second", "rate_of_change")
    ) * stat(errors, "latest")
    return [finite_or_null(c).alias(n) for n, c in zip(CROSS_SIGNALS, (cpu, memory, error, disk, network))]


def feature_vectors(stats: DataFrame, p: Params, *, require_fresh_cpu: bool = True) -> DataFrame:
    """One row per (host, window end): ordered vector, name map and quality.

    A metric that is not fresh at the window end counts as absent; a host without fresh CPU
    samples has no window at all.  At most seventeen rows meet in a group.
    """
    age = (F.col("end_us") - micros("last_ts")) / F.lit(float(MICROS))
    fresh = stats.withColumn("age_seconds", age).filter(F.col("metric").isin(*METRICS))
    if require_fresh_cpu:
        fresh = fresh.filter(F.col("age_seconds") <= p.freshness)
    body = F.struct(
        "count", "first_ts", "last_ts", "coverage_seconds", "age_seconds", F.array(*STATS).alias("values")
    )
    keys = ["host_id", "chunk", "end_us"] if "chunk" in stats.columns else ["host_id", "end_us"]
    wide = fresh.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", body))).alias("__stats")
    )
    if require_fresh_cpu:
        wide = wide.filter(F.map_contains_key("__stats", "cpu_usage_percent"))
    return finish_vectors(wide, p)


def finish_vectors(wide: DataFrame, p: Params) -> DataFrame:
    metrics = F.array(*[F.lit(m) for m in METRICS])
    absent = F.array_repeat(F.lit(None).cast("double"), len(STATS))
    ordered = [F.coalesce(F.try_element_at("__stats", F.lit(m))["values"], absent) for m in METRICS]

    def described(metric: Column) -> Column:
        row = F.try_element_at("__stats", metric)
        return F.struct(
            metric.alias("key"),
            F.struct(
                F.coalesce(row["count"], F.lit(0)).alias("count"),
                row["first_ts"].alias("first_ts"),
                row["last_ts"].alias("last_ts"),
                F.coalesce(row["coverage_seconds"], F.lit(0.0)).alias("coverage_seconds"),
                row["age_seconds"].alias("age_seconds"),
            ).alias("value"),
        )

    return _stored(wide, p, F.concat(*ordered, F.array(*cross_signals())), F.map_from_entries(F.transform(metrics, described)))


def _stored(wide: DataFrame, p: Params, values: Column, quality: Column) -> DataFrame:
    contract, end = Contract.of(p), F.col("end_us")
    return wide.select(
        "host_id",
        F.timestamp_micros(end - F.lit(p.window * MICROS)).alias("window_start"),
        F.timestamp_micros(end).alias("window_end"),
        F.lit(contract.version).alias("schema_version"),
        F.lit(contract.digest).alias("schema_hash"),
        F.array(*[F.lit(n) for n in contract.names]).alias("feature_names"),
        values.alias("feature_values"),
        quality.alias("quality"),
    ).withColumn("features", F.map_from_arrays("feature_names", "feature_values"))


def _described() -> Column:
    """Quality of each metric from the arrays of a merged window; an absent metric has no instants."""

    def of(i: int) -> Column:
        first, last = F.col("first_us")[i], F.col("last_us")[i]
        return F.struct(
            F.lit(METRICS[i]).alias("key"),
            F.struct(
                F.coalesce(F.col("counts")[i], F.lit(0)).alias("count"),
                F.timestamp_micros(first).alias("first_ts"),
                F.timestamp_micros(last).alias("last_ts"),
                F.coalesce((last - first) / F.lit(float(MICROS)), F.lit(0.0)).alias("coverage_seconds"),
                ((F.col("end_us") - last) / F.lit(float(MICROS))).alias("age_seconds"),
            ).alias("value"),
        )

    return F.map_from_entries(F.array(*[of(i) for i in range(len(METRICS))]))


def feature_windows(samples: DataFrame, p: Params, as_of: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    """Samples to stored feature windows in one shuffle; only: the (host_id, window_end) asked for, all when none is given."""
    wide = _wide(samples, p, as_of, None if only is None else only.select("host_id", "window_end"))
    return _stored(wide, p, _values(), _described())


def window_vectors(samples: DataFrame, p: Params, as_of: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    """(host_id, window_end, feature_values) alone: names and quality are not carried with each window.

    only: the windows asked for, each of whose rows comes back with its other columns if there is such a window.  They meet
    the samples, which are fewer and narrower than the vectors; the vectors are not shuffled."""
    rest = [] if only is None else [c for c in only.columns if c not in ("host_id", "window_end")]
    return _wide(samples, p, as_of, only).select("host_id", F.timestamp_micros("end_us").alias("window_end"), *rest, _values().alias("feature_values"))


def _values() -> Column:
    return F.concat("values", F.array(*cross_signals(_placed)))


def _wide(samples: DataFrame, p: Params, as_of: Column | None, only: DataFrame | None) -> DataFrame:
    """A row holds the samples of all metrics of a host's chunk.  Its windows come out with their statistics side by side, so
    statistics meet in a vector without another shuffle.
    """
    keys = ["host_id", "chunk"]
    known = samples.filter(F.col("metric").isin(*METRICS))
    place = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric")).cast("int") - 1
    rows = _clean(known, p, as_of).groupBy(*keys).agg(
        F.collect_list(F.struct(place.alias("m"), micros("ts").alias("t"), F.col("value").alias("v"))).alias("samples"),
        F.min("__from").alias("first"),
        F.max("__to").alias("last"),
    )
    rest = []
    if only is not None:
        rest = [f for f in only.schema if f.name not in ("host_id", "window_end")]
        chunk = floor_to(micros("window_end"), chunk_us(p) // MICROS).alias("chunk")
        one = F.struct(micros("window_end").alias("end"), *[F.col(f.name) for f in rest])
        gather = F.collect_list if rest else F.collect_set
        rows = rows.join(only.select("host_id", chunk, one.alias("one")).groupBy(*keys).agg(gather("one").alias("asked")), keys)
    host = samples.schema["host_id"].dataType.simpleString()
    schema = f"host_id {host}, end_us bigint, counts array<bigint>, first_us array<bigint>, last_us array<bigint>, `values` array<double>"
    return rows.mapInArrow(_vectors_of(p), ", ".join([schema, *[f"`{f.name}` {f.dataType.simpleString()}" for f in rest]]))


def _vectors_of(p: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    durations = grid(p)

    def lists(x: np.ndarray, missing: np.ndarray) -> pa.ListArray:
        offsets = np.arange(len(x) + 1, dtype="int32") * x[:1].size
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1), mask=missing.reshape(-1)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, held = batch.column("host_id"), batch.column("samples")
            m, t, v = (held.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
            counts = np.diff(held.offsets.to_numpy()).astype("int64")
            first, last = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("first", "last"))
            asked = batch.column("asked") if "asked" in batch.schema.names else None
            carried = [] if asked is None else [f.name for f in asked.type.value_type][1:]
            for some in merged.parts((last - first) // durations.tick + 1, merged.WINDOWS // len(METRICS)):
                own = slice(int(counts[: some.start].sum()), int(counts[: some.stop].sum()))
                w = merged.Wide(counts[some], m[own], t[own], v[own], first[some], last[some], durations, len(METRICS), STATS)
                w.forget(w.end[:, None] - w.last_us > p.freshness * MICROS)
                there, rest = w.count[:, METRICS.index("cpu_usage_percent")] > 0, []
                kept = np.flatnonzero(there)
                if asked is not None:
                    wanted = asked.slice(some.start, some.stop - some.start)
                    flat = wanted.flatten()
                    which, at = w.find(np.diff(wanted.offsets.to_numpy()), flat.field(0).to_numpy(zero_copy_only=False))
                    kept, which = at[there[at]], pa.array(which[there[at]])
                    rest = [flat.field(i).take(which) for i in range(1, flat.type.num_fields)]
                absent = w.count[kept] == 0
                columns = [lists(x[kept], absent) for x in (w.count, w.first_us, w.last_us)]
                values = w.values[kept]
                yield pa.RecordBatch.from_arrays(
                    [hosts.take(pa.array(w.row[kept] + some.start)), pa.array(w.end[kept]), *columns, lists(values, ~np.isfinite(values)), *rest],
                    names=["host_id", "end_us", "counts", "first_us", "last_us", "values", *carried],
                )

    return merge


def with_origin(windows: DataFrame, errors: DataFrame, service_map: DataFrame) -> DataFrame:
    """Complete the quality record: the metrics of the host whose query failed or was contradictory (comma-separated, by
    name), and the service the host runs (null: none)."""
    return (
        windows.join(errors.select("host_id", "query_errors"), "host_id", "left")
        .join(service_map.select("host_id", "service_job"), "host_id", "left")
        .withColumn("query_errors", F.coalesce("query_errors", F.lit("")))
    )


def long_features(windows: DataFrame) -> DataFrame:
    """Windows to (host, window end, position, name, value)."""
    return windows.select(
        "host_id",
        "window_end",
        F.posexplode(F.arrays_zip("feature_names", "feature_values")).alias("position", "f"),
    ).select(
        "host_id",
        "window_end",
        "position",
        F.col("f.feature_names").alias("feature"),
        F.col("f.feature_values").alias("value"),
    )


def window_keys(samples: DataFrame, p: Params, as_of: Column | None = None, least_coverage: float = 0.0) -> DataFrame:
    """Hosts and window ends that have a window at all, from the CPU series alone; with least_coverage, those whose
    CPU samples span at least that share of the window, as training asks for."""
    cpu = samples.filter(F.col("metric") == "cpu_usage_percent")
    t = micros("ts")
    spans = sliding_windows(cpu, p, as_of).groupBy("host_id", "chunk", "end_us").agg(F.max(t).alias("last_us"), F.min(t).alias("first_us"))
    end = F.col("end_us")
    long_enough = F.col("last_us") - F.col("first_us") >= F.lit(least_coverage * p.window * MICROS)
    return spans.filter((end - F.col("last_us") <= F.lit(p.freshness * MICROS)) & long_enough).select(
        "host_id",
        F.timestamp_micros(end - F.lit(p.window * MICROS)).alias("window_start"),
        F.timestamp_micros(end).alias("window_end"),
    )
