"""Exact time arithmetic on epoch microseconds, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    return F.unix_micros(col(ts))


def from_micros(us: str | Column) -> Column:
    return F.timestamp_micros(col(us))


def floor_to(us: Column, seconds: int) -> Column:
    """Largest multiple of ``seconds`` not after ``us``, in microseconds."""
    return us - F.pmod(us, F.lit(seconds * MICROS))


def ceil_to(us: Column, seconds: int) -> Column:
    return floor_to(us + F.lit(seconds * MICROS - 1), seconds)


def plus(ts: str | Column, seconds: int | Column) -> Column:
    """``ts`` moved by a number of seconds."""
    shift = seconds * MICROS if isinstance(seconds, Column) else F.lit(int(seconds * MICROS))
    return from_micros(micros(ts) + shift.cast("bigint"))


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS))


def is_finite(c: str | Column) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite_or_null(c: str | Column) -> Column:
    return F.when(is_finite(c), col(c))


def r6(c: str | Column, digits: int = 6) -> Column:
    return F.round(col(c), digits)

