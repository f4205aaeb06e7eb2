"""Structured Streaming forms of the pipelines, with the semantics of the batch operators.

Late rows beyond the watermark are dropped; results are appended once and never revised.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import Struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from augury.functions.clock import is_finite, micros
from augury.operators.features import chunk_us, flat_windows, in_chunks, windows_of
from augury.settings import Params
from augury.streaming.in_order import InOrder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenWindows(StatefulProcessor):
    """Per (host, chunk of window ends): the samples of all metrics, each held once, until the watermark has passed the windows
    they lie in.  A wake-up hands over the ends passed since the one before (first to last) with the samples they need, one
    row for each metric.

    Spark converts state field by field, so a sample is one field: instant (us, 64 bits), value (double), metric."""

    number = Struct("<qd")

    def __init__(self, p: Params) -> None:
        self.window, self.tick, self.length = p.window * 1_000_000, p.tick * 1_000_000, chunk_us(p)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "sample binary")
        self.mark = handle.getValueState("mark", "done bigint, woken bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, held = None, []
        for part in rows:
            us = part["us"].to_numpy("int64")
            held += map(self._packed, part["metric"].tolist(), us.tolist(), part["value"].tolist())
            first = int(us.min()) if first is None else min(first, int(us.min()))
        if first is not None:
            self.samples.appendList(held)
            done, woken = self._marked()
            self._wake(done, woken, max(self._end(first), int(key[1]), self._after(done)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        start, stop = int(key[1]), int(key[1]) + self.length - self.tick
        done, _ = self._marked()
        last = min(passed - passed % self.tick, stop)
        held, rows, rest, next_us = self._held(), [], [], []
        for metric, (us, value) in held.items():
            t, v = self._plain(us, value)
            first = max(start, self._after(done), self._end(int(t[0]))) if len(t) else start
            need = (t > first - self.window) & (t <= last)
            if need.any():
                rows.append((key[0], metric, first, last, t[need], v[need]))
            later = us > last + self.tick - self.window
            if later.any():
                rest += map(self._packed, [metric] * len(us), us[later].tolist(), value[later].tolist())
                next_us.append(int(us[later].min()))
        if rows:
            yield pd.DataFrame(rows, columns=["host_id", "metric", "first", "last", "t", "v"])
        if last >= stop or not rest:
            self.samples.clear()
        elif 2 * len(rest) <= sum(len(us) for us, _ in held.values()):
            self.samples.put(rest)
        if last >= stop:
            self.mark.clear()
        elif rest:
            # The next end that has a sample in its window.
            self._wake(last, None, max(last + self.tick, self._end(min(next_us))))
        else:
            self.mark.update((last, None))

    def _marked(self) -> tuple[int | None, int | None]:
        """The last end handed over and the timer that is set; nothing yet when the state holds no mark."""
        return self.mark.get() or (None, None)

    def _end(self, us: int) -> int:
        """First window end that holds an instant."""
        return -(-us // self.tick) * self.tick

    def _after(self, done: int | None) -> int:
        return -(2**62) if done is None else int(done) + self.tick

    def _wake(self, done: int | None, woken: int | None, end: int) -> None:
        """One timer, which fires once the watermark is at the end or behind it: timers lie before the watermark."""
        at = end // 1000 - 1
        if woken is None or at < int(woken):
            if woken is not None:
                self.handle.deleteTimer(int(woken))
            self.handle.registerTimer(at)
            woken = at
        self.mark.update((done, int(woken)))

    def _packed(self, metric: str | None, us: int, value: float) -> tuple[bytes]:
        return (self.number.pack(us, value) + (b"\xff" if metric is None else metric.encode()),)

    def _held(self) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
        """Instants and values of each metric."""
        parts: dict[bytes, list[bytes]] = {}
        for (sample,) in self.samples.get():
            parts.setdefault(bytes(sample[16:]), []).append(sample[:16])
        found = {}
        for metric, own in parts.items():
            both = np.frombuffer(b"".join(own), [("us", "<i8"), ("value", "<f8")])
            found[None if metric == b"\xff" else metric.decode()] = both["us"], both["value"]
        return found

    def _plain(self, us: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples in order; copies count once, and instants that contradict each other are left out."""
        order = np.lexsort((value, us))
        us, value = us[order], value[order]
        at = np.flatnonzero(np.append(True, us[1:] != us[:-1]))
        same = value[at] == value[np.append(at[1:], len(us)) - 1]
        return us[at[same]], value[at[same]]

    def close(self) -> None:
        pass


def feature_stats_stream(samples: DataFrame, p: Params, delay_seconds: int) -> DataFrame:
    """Twelve statistics per (host, metric, window), emitted once when a window is complete.

    The clock lies one microsecond before a sample, so a window is complete once the watermark has reached its end.
    Copies of a sample count once; samples of one instant that contradict each other are left out, as in the batch.
    State holds a sample once for each chunk, not once for each window; the metrics of a host's chunk share one state and one
    timer, so calls to the state grow with the hosts' chunks.
    """
    finite = samples.filter(is_finite("value")).select(
        "host_id", "metric", "ts", "value", F.timestamp_micros(F.unix_micros("ts") - 1).alias("clock")
    )
    placed = in_chunks(finite.withWatermark("clock", f"{delay_seconds} seconds"), p)
    ready = (
        placed.select("host_id", "metric", "chunk", "clock", micros("ts").alias("us"), "value")
        .groupBy("host_id", "chunk")
        .transformWithStateInPandas(
            OpenWindows(p),
            outputStructType="host_id string, metric string, first bigint, last bigint, t array<bigint>, v array<double>",
            outputMode="append",
            timeMode="eventTime",
        )
    )
    keys = ["host_id", "metric"]
    series = ready.select(*keys, "first", "last", F.arrays_zip("t", "v").alias("samples"))
    return flat_windows(series.select(*keys, windows_of("samples", "first", "last", p).alias("windows")), keys)


class FailureDetector(InOrder):
    """Per host: last probes and whether a failure is open; emits confirmed changes."""

    fields = (("us", "bigint"), ("probe_id", "bigint"), ("breached", "boolean"), ("outcome", "string"))
    output = ("host_id", "event_id", "change", "failure_type", "first_us", "confirmed_us")

    def __init__(self, p: Params) -> None:
        super().__init__(p.slice_seconds)
        self.count, self.span = p.confirm_count, p.confirm_span * 1_000_000

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.recent_state = handle.getValueState("recent", "rows array<struct<us:bigint,probe:bigint,breached:boolean,outcome:string>>")
        self.open_state = handle.getValueState("open", "event string")

    def load(self) -> None:
        self.recent = [tuple(r) for r in self.recent_state.get()[0]] if self.recent_state.exists() else []
        self.current = self.open_state.get()[0] if self.open_state.exists() else None

    def save(self) -> None:
        self.recent_state.update((self.recent,))
        if self.current is None:
            self.open_state.clear()
        else:
            self.open_state.update((self.current,))

    def step(self, key: tuple, row: tuple) -> list[tuple]:
        self.recent = (self.recent + [row])[-self.count :]
        first = self.recent[0]
        if len(self.recent) < self.count or row[0] - first[0] > self.span:
            return []
        if self.current is None and all(r[2] for r in self.recent):
            self.current = f"f{first[1]}"
            return [(key[0], self.current, "failure", first[3], first[0], row[0])]
        if self.current is not None and not any(r[2] for r in self.recent):
            event, self.current = self.current, None
            return [(key[0], event, "recovery", None, first[0], row[0])]
        return []


def failure_events_stream(probes: DataFrame, p: Params, delay_seconds: int) -> DataFrame:
    """Failures and recoveries confirmed by probes behind the watermark; state survives restarts."""
    keyed = probes.withWatermark("observed_at", f"{delay_seconds} seconds").select(
        "host_id", "probe_id", "observed_at", F.unix_micros("observed_at").alias("us"), "breached", "outcome"
    )
    changes = keyed.groupBy("host_id").transformWithStateInPandas(
        FailureDetector(p),
        outputStructType="host_id string, event_id string, change string, failure_type string, first_us bigint, confirmed_us bigint",
        outputMode="append",
        timeMode="eventTime",
    )
    return changes.select(
        "host_id",
        "event_id",
        "change",
        "failure_type",
        F.timestamp_micros("first_us").alias("first_at"),
        F.timestamp_micros("confirmed_us").alias("confirmed_at"),
    )


class IncidentTracker(InOrder):
    """Per host: threshold crossings and at most one open incident, which ends by low scores or when its forecast
    has run out, also on a host that is scored no more."""

    fields = (("us", "bigint"), ("prediction_id", "string"), ("end_us", "bigint"), ("probability", "double"))
    output = ("host_id", "incident_id", "change", "at_us", "crossing")

    def __init__(self, threshold: float, p: Params) -> None:
        super().__init__(p.slice_seconds)
        self.threshold, self.p = threshold, p
        self.ahead, self.clear_span, self.max_age = ((s * 1_000_000) for s in (p.horizon + p.expiry_grace, p.clear_span, p.max_age))

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.lows_state = handle.getValueState("lows", "ends array<bigint>")
        self.incident_state = handle.getValueState("incident", "id string, expiry bigint")
        self.newest_state = handle.getValueState("newest", "us bigint, high boolean")

    def load(self) -> None:
        self.lows = list(self.lows_state.get()[0]) if self.lows_state.exists() else []
        self.incident = tuple(self.incident_state.get()) if self.incident_state.exists() else None
        self.newest = tuple(self.newest_state.get()) if self.newest_state.exists() else (None, False)

    def save(self) -> None:
        self.lows_state.update((self.lows,))
        if self.newest[0] is not None:
            self.newest_state.update(self.newest)
        if self.incident is None:
            self.incident_state.clear()
        else:
            self.incident_state.update(self.incident)

    def deadline(self) -> int | None:
        return None if self.incident is None else self.incident[1]

    def late(self, key: tuple) -> list[tuple]:
        (name, expiry), self.incident = self.incident, None
        return [(key[0], name, "forecast_expired_unconfirmed", expiry, False)]

    def step(self, key: tuple, row: tuple) -> list[tuple]:
        at, name, end, value = row
        out = self.late(key) if self.incident is not None and at > self.incident[1] else []
        newest, before_high = self.newest
        if newest is not None and end <= newest:  # a repeated or overtaken window changes nothing
            return out
        high = value >= self.threshold
        self.newest = (end, high)
        if high:
            self.lows = []
            if self.incident is None and at - end <= self.max_age:
                self.incident = (f"i-{name}", end + self.ahead)
                out.append((key[0], self.incident[0], "opened", at, not before_high))
            return out
        self.lows = (self.lows + [end])[-self.p.clear_count :]
        full = len(self.lows) == self.p.clear_count and self.lows[-1] - self.lows[0] <= self.clear_span
        if self.incident is not None and full:
            out.append((key[0], self.incident[0], "risk_cleared", at, False))
            self.incident = None
        return out


def incidents_stream(predictions: DataFrame, threshold: float, p: Params, delay_seconds: int) -> DataFrame:
    """Incident openings and closings per host behind the watermark, those of the batch replay."""
    keyed = predictions.withWatermark("predicted_at", f"{delay_seconds} seconds").select(
        "host_id",
        "prediction_id",
        "predicted_at",
        F.unix_micros("window_end").alias("end_us"),
        F.unix_micros("predicted_at").alias("us"),
        "probability",
    )
    changes = keyed.groupBy("host_id").transformWithStateInPandas(
        IncidentTracker(threshold, p),
        outputStructType="host_id string, incident_id string, change string, at_us bigint, crossing boolean",
        outputMode="append",
        timeMode="eventTime",
    )
    return changes.select("host_id", "incident_id", "change", F.timestamp_micros("at_us").alias("at_time"), "crossing")


def dedupe_stream(frame: DataFrame, keys: list[str], ts: str, delay_seconds: int) -> DataFrame:
    """First row per key within the watermark."""
    return frame.withWatermark(ts, f"{delay_seconds} seconds").dropDuplicatesWithinWatermark(keys)


def enrich_stream(frame: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Stream-static join; the dimension is read anew in every batch."""
    return frame.join(dimension, key, "left")


def daily_counts_stream(frame: DataFrame, ts: str, delay_seconds: int) -> DataFrame:
    """Tumbling day windows per host."""
    return (
        frame.withWatermark(ts, f"{delay_seconds} seconds")
        .groupBy("host_id", F.window(ts, "1 day").alias("span"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("host_id", F.col("span.start").alias("day"), "rows")
    )


def run_once(frame: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into files and stop."""
    query = (
        frame.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(frame: DataFrame, path: str, checkpoint: str, keys: list[str], interval: str | None = None) -> StreamingQuery:
    """Idempotent sink: every micro-batch owns a folder, so a replayed batch replaces itself.

    Readers see each key once through :func:`read_batches`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return trigger.start()


def read_batches(spark, path: str, keys: list[str]) -> DataFrame:
    """First written row per key over all batches."""
    stored = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in stored.columns if c not in keys]
    first = F.min_by(F.struct(*rest), "batch").alias("r")
    return stored.groupBy(*keys).agg(first).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest if c != "batch"])


