"""Joins on overlapping time intervals and interval merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.functions.clock import floor_to, micros
from augury.functions.ordered import Scan, running


def _bucketed(df: DataFrame, start: str, end: str, seconds: int, tag: str) -> DataFrame:
    first, last = floor_to(micros(start), seconds), floor_to(micros(end), seconds)
    step = F.lit(seconds * 1_000_000)
    return (
        df.filter(F.col(start) <= F.col(end))
        .withColumn(f"__first_{tag}", first)
        .withColumn("__bucket", F.explode(F.sequence(first, last, step)))
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    bucket_seconds: int,
    extra: Column | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join of rows of one key whose closed intervals overlap.

    Each interval is placed into every time bucket it touches; the equi-join runs on (key,
    bucket), so a hot key is spread over its buckets.  A pair is kept only in the first bucket
    both sides share, so nothing is emitted twice and no distinct is needed.  A point is the
    interval ``(c, c)``.  Column names of the two sides must differ except for the keys.  A left
    join is available when the left side are points, which live in exactly one bucket.
    """
    if how != "inner" and left_span[0] != left_span[1]:
        raise ValueError("only points can be kept without a partner")
    a = _bucketed(left, *left_span, bucket_seconds, "l")
    b = _bucketed(right, *right_span, bucket_seconds, "r")
    condition = (
        (F.col(left_span[0]) <= F.col(right_span[1]))
        & (F.col(right_span[0]) <= F.col(left_span[1]))
        & (F.col("__bucket") == F.greatest("__first_l", "__first_r"))
    )
    matched = b.withColumnsRenamed({k: f"__r_{k}" for k in [*keys, "__bucket"]})
    same = F.col("__bucket") == F.col("__r___bucket")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__r_{k}"))
    if extra is not None:
        condition = condition & extra
    joined = a.join(matched, same & condition, how)
    return joined.drop("__bucket", "__first_l", "__first_r", *[f"__r_{k}" for k in [*keys, "__bucket"]])


def label_islands(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    tie: list[str],
    *,
    name: str = "island",
    slice_seconds: int = 86400,
) -> DataFrame:
    """Number groups of overlapping (or touching) intervals per key."""
    reach = running(
        df, keys, start, tie, {"__reach": Scan("max", end, inclusive=False)}, slice_seconds=slice_seconds
    )
    opens = F.col("__reach").isNull() | (F.col(start) > F.col("__reach"))
    return running(
        reach,
        keys,
        start,
        tie,
        {name: Scan("sum", F.when(opens, 1).otherwise(0))},
        slice_seconds=slice_seconds,
    ).drop("__reach")


def merge_intervals(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    *,
    tie: list[str] | None = None,
    slice_seconds: int = 86400,
    aggregates: list[Column] | None = None,
) -> DataFrame:
    """Disjoint union of the intervals of each key."""
    numbered = label_islands(df, keys, start, end, tie or [end], slice_seconds=slice_seconds)
    return numbered.groupBy(*keys, "island").agg(
        F.min(start).alias(start), F.max(end).alias(end), *(aggregates or [])
    )
