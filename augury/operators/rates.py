"""Counter rates, bucket quantiles and gauge queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions.clock import MICROS, ceil_to, micros, seconds_between
from augury.functions.ordered import Scan, halo_chunks, own_chunk, running, with_previous
from augury.settings import Params


def counter_rate(counters: DataFrame, p: Params) -> DataFrame:
    """Change per second since the previous read; none on the first read, a stuck clock or a reset."""
    seen = with_previous(
        counters, ["host_id", "counter"], "ts", ["event_id"], ["value"], slice_seconds=p.slice_seconds
    )
    elapsed = seconds_between("ts", "prev.ts")
    change = F.col("value") - F.col("prev.value")
    rate = F.when((elapsed > 0) & (change >= 0), change / elapsed)
    return seen.withColumn("rate", rate).drop("prev")


def increments(counters: DataFrame, keys: list[str], p: Params, within: int) -> DataFrame:
    """Growth of a cumulative counter since its previous read; after a reset the new value counts.

    Only reads at most ``within`` seconds apart are paired, which keeps the look back bounded.
    """
    chunk = max(p.slice_seconds, 4 * within)
    series = Window.partitionBy(*keys, "chunk").orderBy("ts", "event_id")
    seen = (
        halo_chunks(counters.select(*keys, "ts", "event_id", "value"), "ts", chunk, before=within)
        .withColumn("__previous", F.lag("value").over(series))
        .withColumn("prev_us", F.lag(micros("ts")).over(series))
    )
    previous = F.col("__previous")
    grown = F.when(F.col("value") >= previous, F.col("value") - previous).otherwise(F.col("value"))
    return seen.filter(own_chunk("ts", chunk) & previous.isNotNull()).withColumn("increment", grown).withColumnRenamed("__previous", "prev_value").drop("chunk")


def _grid(at: Column, window: int, step: int) -> Column:
    """Grid instants T with ``T - window < at <= T``."""
    first = ceil_to(at, step)
    last = ceil_to(at + F.lit(window * MICROS), step) - F.lit(step * MICROS)
    return F.explode(F.sequence(first, last, F.lit(step * MICROS)))


def windowed_rate(
    counters: DataFrame,
    keys: list[str],
    p: Params,
    *,
    window: int | None = None,
    mode: str = "simple",
    until: Column | None = None,
) -> DataFrame:
    """Per-second rate of each series over the last ``window`` seconds at every grid instant.

    ``simple`` divides the reset-corrected growth inside the window by the window length.
    ``extrapolated`` stretches it to the window borders: half an average interval when the
    border is far, never below a zero counter.  Fewer than two reads give no rate.
    """
    width = window or p.rate_window
    grown = increments(counters, keys, p, width)
    at = micros("ts")
    placed = grown.withColumn("grid_us", _grid(at, width, p.rate_step))
    if until is not None:
        placed = placed.filter(F.col("grid_us") <= micros(until))
    start = F.col("grid_us") - F.lit(width * MICROS)
    # Growth belongs to the window only when both of its reads do.
    inside = F.col("prev_us") > start
    grouped = placed.groupBy(*keys, "grid_us").agg(
        F.sum(F.when(inside, F.col("increment"))).alias("growth"),
        F.min(F.when(inside, F.col("prev_us"))).alias("first_us"),
        F.max(at).alias("last_us"),
        F.count(F.when(inside, 1)).alias("steps"),
        F.min_by("prev_value", F.when(inside, at)).alias("first_value"),
    )
    grouped = grouped.filter(F.col("growth").isNotNull())
    if mode == "simple":
        rate = F.col("growth") / F.lit(float(width))
    elif mode == "extrapolated":
        span = (F.col("last_us") - F.col("first_us")) / F.lit(float(MICROS))
        average = span / F.col("steps")
        to_start = (F.col("first_us") - (F.col("grid_us") - F.lit(width * MICROS))) / F.lit(float(MICROS))
        to_end = (F.col("grid_us") - F.col("last_us")) / F.lit(float(MICROS))
        half = average / 2.0
        to_start = F.when(to_start >= average * 1.1, half).otherwise(to_start)
        zero = F.when(F.col("growth") > 0, span * F.col("first_value") / F.col("growth"))
        to_start = F.when(zero < to_start, zero).otherwise(to_start)
        to_end = F.when(to_end >= average * 1.1, half).otherwise(to_end)
        rate = F.try_divide(F.col("growth") * (span + to_start + to_end), span) / F.lit(float(width))
    else:
        raise ValueError(mode)
    return grouped.select(*keys, F.timestamp_micros("grid_us").alias("at"), rate.alias("rate"))


def summed_rate(counters: DataFrame, counter: str, by: list[str], p: Params, **kwargs) -> DataFrame:
    """``sum by (...) (rate(counter[window]))``; absent series stay absent."""
    one = counters.filter(F.col("counter") == counter)
    per_series = windowed_rate(one, ["host_id"], p, **kwargs)
    return per_series.groupBy(*by, "at").agg(F.sum("rate").alias("rate"))


def bucket_quantile(rates: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile from per-bound rates by linear interpolation inside the bucket that holds it.

    The group is one histogram, i.e. a fixed handful of bounds.  The open bucket reports the
    highest finite bound; an idle histogram has no quantile.
    """
    bounds = F.array_sort(F.collect_list(F.struct("le", "rate")))
    grouped = rates.groupBy(*keys).agg(bounds.alias("b"))
    # Repair rounding: cumulative bounds never decrease.
    monotone = F.aggregate(
        "b",
        F.array().cast("array<struct<le:double,rate:double>>"),
        lambda acc, x: F.concat(
            acc,
            F.array(
                F.struct(
                    x["le"].alias("le"),
                    F.greatest(x["rate"], F.coalesce(F.try_element_at(acc, F.lit(-1))["rate"], F.lit(0.0))).alias("rate"),
                )
            ),
        ),
    )
    ready = grouped.select(*keys, monotone.alias("b")).withColumn("total", F.element_at("b", -1)["rate"])
    rank = F.col("total") * F.lit(q)
    index = F.size(F.filter("b", lambda x: x["rate"] < rank)) + 1
    hit = F.try_element_at("b", F.least(index, F.size("b")).cast("int"))
    low = F.when(index > 1, F.try_element_at("b", F.greatest(index - 1, F.lit(1)).cast("int")))
    low_bound, low_rate = F.coalesce(low["le"], F.lit(0.0)), F.coalesce(low["rate"], F.lit(0.0))
    inside = low_bound + (hit["le"] - low_bound) * F.try_divide(rank - low_rate, hit["rate"] - low_rate)
    open_bucket = hit["le"] == F.lit(float("inf"))
    value = F.when(F.col("total") > 0, F.when(open_bucket, low_bound).otherwise(inside))
    return ready.select(*keys, value.alias("quantile"))


def sample_age(samples: DataFrame, as_of: Column, *, positive_only: bool = True) -> DataFrame:
    """Seconds since the newest reading per series, optionally only where its value is above zero."""
    newest = samples.groupBy("host_id", "metric").agg(
        F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value")
    )
    if positive_only:
        newest = newest.filter(F.col("value") > 0)
    return newest.select("host_id", "metric", seconds_between(as_of, "ts").alias("age_seconds"))


def gauge_latest(samples: DataFrame) -> DataFrame:
    return samples.groupBy("host_id", "metric").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts")
    )


def target_up(probes: DataFrame, job_pattern: str) -> DataFrame:
    """Newest reachability per job whose name matches the anchored pattern."""
    job = F.concat(F.lit("job-"), F.col("host_id"))
    up = F.when(F.col("status_code").isNull(), 0).otherwise(1)
    return (
        probes.withColumn("job", job)
        .filter(F.col("job").rlike(f"^(?:{job_pattern})$"))
        .groupBy("job")
        .agg(F.max_by(up, F.struct("observed_at", "probe_id")).alias("up"))
    )


# Fixed method list; everything else is reported as OTHER.
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def http_rollup(requests: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """Request log to request, error and duration-bucket counts per (method, route, status)."""
    method = F.when(F.col("method").isin(*HTTP_METHODS), F.col("method")).otherwise("OTHER")
    kept = requests.filter(F.coalesce(F.col("route") != "/metrics", F.lit(True)))
    per_bound = [
        F.sum(F.when(F.col("duration_seconds") <= b, 1).otherwise(0)).alias(f"le_{i}") for i, b in enumerate(bounds)
    ]
    return (
        kept.select(
            method.alias("method"),
            F.coalesce("route", F.lit("unmatched")).alias("route"),
            "status_code",
            "duration_seconds",
        )
        .groupBy("method", "route", "status_code")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum(F.when(F.col("status_code") >= 400, 1).otherwise(0)).alias("errors"),
            F.sum("duration_seconds").alias("duration_sum"),
            *per_bound,
        )
    )


def inflight(requests: DataFrame, p: Params) -> DataFrame:
    """Concurrent requests per host after every start and end."""
    ended = F.timestamp_micros(
        micros("started_at") + F.round(F.col("duration_seconds") * MICROS).cast("bigint")
    )
    edges = requests.select(
        "host_id",
        "request_id",
        F.explode(
            F.array(
                F.struct(F.col("started_at").alias("ts"), F.lit(1).alias("change")),
                F.struct(ended.alias("ts"), F.lit(-1).alias("change")),
            )
        ).alias("e"),
    ).select("host_id", "request_id", "e.ts", "e.change")
    return running(
        edges, ["host_id"], "ts", ["change", "request_id"], {"inflight": Scan("sum", "change")}, slice_seconds=p.slice_seconds
    )


def changing_series(samples: DataFrame, end: Column, seconds: int) -> DataFrame:
    """Whether each series took more than one value in the last ``seconds``."""
    recent = samples.filter((micros("ts") >= micros(end) - F.lit(seconds * MICROS)) & (F.col("ts") <= end))
    return recent.groupBy("host_id", "metric").agg(
        (F.max("value") > F.min("value")).alias("changing"), F.count(F.lit(1)).alias("samples")
    )


def grid_last(samples: DataFrame, end: Column, *, lookback: int, step: int, hold: int | None = None) -> DataFrame:
    """Value of each series at every grid instant: its newest sample of the last ``hold`` seconds.

    A sample answers the hold / step instants after it, so the result needs no look back; ``hold`` is one
    step unless given."""
    start = micros(end) - F.lit(lookback * MICROS)
    # The grid is anchored at the start of the range.
    offset = micros("ts") - start
    first = F.greatest(ceil_to(offset, step), F.lit(0).cast("long"))
    last = F.least(offset + F.lit((hold or step) * MICROS - 1), F.lit(lookback * MICROS))
    recent = samples.filter(F.col("ts") <= end).withColumn("__first", first).withColumn("__last", last)
    recent = recent.filter(F.col("__first") <= F.col("__last"))
    grid = F.explode(F.sequence("__first", "__last", F.lit(step * MICROS)))
    return (
        recent.withColumn("grid_us", grid)
        .groupBy("host_id", "metric", "grid_us")
        .agg(F.max_by("value", "ts").alias("value"))
        .select("host_id", "metric", F.timestamp_micros(F.col("grid_us") + start).alias("at"), "value")
    )
