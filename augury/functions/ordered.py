"""Per-key ordered scans that do not put a whole key into one task.

A plain ``Window.partitionBy(host)`` sends all rows of a host to one task, which fails as soon
as one host carries a large share of the data.  The helpers here cut every key into fixed time
slices, scan each slice on its own, and carry a constant-size summary per slice over the
(few) slices of a key.  Results are identical to the unsliced window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions.clock import MICROS, floor_to, micros

SLICE = "__slice"


def _sliced(df: DataFrame, ts: str, slice_seconds: int) -> DataFrame:
    return df.withColumn(SLICE, floor_to(micros(ts), slice_seconds))


def _direction(names: list[str], descending: bool) -> list[Column]:
    return [F.col(n).desc() if descending else F.col(n).asc() for n in names]


def halo_chunks(
    df: DataFrame, ts: str, chunk_seconds: int, *, before: int = 0, after: int = 0, name: str = "chunk"
) -> DataFrame:
    """Place every row in its own time chunk and in those whose surroundings it belongs to.

    A chunk sees all rows from ``before`` seconds ahead of it to ``after`` seconds behind it, so
    any question with a bounded look around is answered inside (key, chunk): one shuffle, no
    self-join, and a hot key is spread over its chunks.
    """
    t = micros(ts)
    first = floor_to(t - F.lit(after * MICROS), chunk_seconds)
    last = floor_to(t + F.lit(before * MICROS), chunk_seconds)
    return df.withColumn(name, F.explode(F.sequence(first, last, F.lit(chunk_seconds * MICROS))))


def own_chunk(ts: str, chunk_seconds: int, name: str = "chunk") -> Column:
    return floor_to(micros(ts), chunk_seconds) == F.col(name)


@dataclass(frozen=True)
class Scan:
    """One running value: ``sum``, ``max`` or ``last`` (latest non-null) in time order."""

    kind: str
    value: str | Column
    inclusive: bool = True
    descending: bool = False


def running(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: list[str],
    scans: dict[str, Scan],
    *,
    slice_seconds: int = 86400,
) -> DataFrame:
    """Add running values per key; both directions may be mixed in one pass."""
    order = list(dict.fromkeys([ts, *tie]))
    base = _sliced(df, ts, slice_seconds)
    for i, scan in enumerate(scans.values()):
        base = base.withColumn(f"__v{i}", F.col(scan.value) if isinstance(scan.value, str) else scan.value)
    scanned, totals, carries = base, [], []
    for i, scan in enumerate(scans.values()):
        v = F.col(f"__v{i}")
        local = (
            Window.partitionBy(*keys, SLICE)
            .orderBy(*_direction(order, scan.descending))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow if scan.inclusive else -1)
        )
        earlier = (
            Window.partitionBy(*keys)
            .orderBy(*_direction([SLICE], scan.descending))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        if scan.kind == "last":
            scanned = scanned.withColumn(f"__s{i}", F.last(v, ignorenulls=True).over(local))
            pick = F.min_by if scan.descending else F.max_by
            totals.append(pick(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"__t{i}"))
            carries.append(F.last(f"__t{i}", ignorenulls=True).over(earlier).alias(f"__c{i}"))
        elif scan.kind in ("sum", "max"):
            fn = F.sum if scan.kind == "sum" else F.max
            scanned = scanned.withColumn(f"__s{i}", fn(v).over(local))
            totals.append(fn(v).alias(f"__t{i}"))
            carries.append(fn(f"__t{i}").over(earlier).alias(f"__c{i}"))
        else:
            raise ValueError(f"unknown scan {scan.kind}")
    carry = base.groupBy(*keys, SLICE).agg(*totals).select(*keys, SLICE, *carries)
    out = scanned.join(carry, [*keys, SLICE], "left")
    for i, (name, scan) in enumerate(scans.items()):
        s, c = F.col(f"__s{i}"), F.col(f"__c{i}")
        merged = {"sum": F.coalesce(s + c, s, c), "max": F.greatest(s, c), "last": F.coalesce(s, c)}
        out = out.withColumn(name, merged[scan.kind])
    n = len(scans)
    return out.drop(SLICE, *[f"__{p}{i}" for p in "vsc" for i in range(n)])


def with_previous(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: list[str],
    fields: list[str],
    *,
    ahead: bool = False,
    name: str = "prev",
    slice_seconds: int = 86400,
) -> DataFrame:
    """Add a struct of the previous (or next) row of a key, however far away it is."""
    row = F.struct(*list(dict.fromkeys([ts, *tie, *fields])))
    scan = Scan("last", row, inclusive=False, descending=ahead)
    return running(df, keys, ts, tie, {name: scan}, slice_seconds=slice_seconds)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    fields: list[str],
    *,
    forward: bool = False,
    inclusive: bool = True,
    tie: str | None = None,
    name: str = "match",
    slice_seconds: int = 86400,
) -> DataFrame:
    """Add a struct ``name`` with the nearest right row at or before (after) each left row.

    Both sides are interleaved by time and the latest right row is carried forward: one sort,
    no range join.  ``tie`` names the right column that decides between equal times (largest
    wins backward, smallest wins forward).
    """
    payload = F.struct(F.col(right_ts).alias("at"), *[F.col(f) for f in fields])
    # An inclusive match wants right rows first in scan order at equal times.
    right_first = inclusive
    side_right = (1 if right_first else 0) if forward else (0 if right_first else 1)
    tie_type = right.schema[tie].dataType if tie else None
    rows_left = left.select(
        *keys,
        F.col(left_ts).alias("__at"),
        F.lit(1 - side_right).alias("__side"),
        (F.lit(None).cast(tie_type) if tie else F.lit(0)).alias("__tie"),
        F.struct(*left.columns).alias("__left"),
    )
    rows_right = right.select(
        *keys,
        F.col(right_ts).alias("__at"),
        F.lit(side_right).alias("__side"),
        (F.col(tie) if tie else F.lit(0)).alias("__tie"),
        payload.alias("__right"),
    )
    both = rows_left.unionByName(rows_right, allowMissingColumns=True)
    scanned = running(
        both,
        keys,
        "__at",
        ["__side", "__tie"],
        {"__match": Scan("last", "__right", descending=forward)},
        slice_seconds=slice_seconds,
    )
    return scanned.filter(F.col("__left").isNotNull()).select("__left.*", F.col("__match").alias(name))


def islands(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: list[str],
    starts: Column,
    *,
    name: str = "island",
    slice_seconds: int = 86400,
) -> DataFrame:
    """Number the runs of a key: a row where ``starts`` holds opens a new run."""
    return running(
        df,
        keys,
        ts,
        tie,
        {name: Scan("sum", F.when(starts, F.lit(1)).otherwise(F.lit(0)))},
        slice_seconds=slice_seconds,
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
