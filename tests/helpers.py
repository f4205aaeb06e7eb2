from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return EPOCH + timedelta(seconds=seconds)


def lit(seconds: float):
    return F.timestamp_micros(F.lit(int(seconds * 1_000_000)))


def samples(spark, rows):
    """rows: (host, metric, seconds, value)"""
    return spark.createDataFrame(
        [(h, m, at(t), float(v)) for h, m, t, v in rows], "host_id string, metric string, ts timestamp, value double"
    )


def probes(spark, rows, known=True):
    """rows: (host, seconds, healthy)"""
    return spark.createDataFrame(
        [(h, i, at(t), ok, known) for i, (h, t, ok) in enumerate(rows)],
        "host_id string, probe_id bigint, observed_at timestamp, healthy boolean, known_criteria boolean",
    )


EVENTS = (
    "event_id string, host_id string, experiment_id string, failure_type string, "
    "observed_at timestamp, confirmed_at timestamp, recovered_at timestamp"
)


def events(spark, rows):
    """rows: (id, host, onset, confirmed, recovered or None)"""
    return spark.createDataFrame(
        [(i, h, "x", "latency", at(o), at(c), at(r) if r is not None else None) for i, h, o, c, r in rows], EVENTS
    )


def windows(spark, rows):
    """rows: (host, start, end)"""
    return spark.createDataFrame(
        [(h, at(a), at(b)) for h, a, b in rows], "host_id string, window_start timestamp, window_end timestamp"
    )
