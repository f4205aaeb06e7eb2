"""Greedy chains: select a row, skip to the first row at or after its ``resume`` time, repeat.

Cooldowns and one-open-incident rules are chains of this kind.  The walk is sequential within
a key, yet a key is never gathered in one task: every time slice reports where a walk entering
it would leave, the few possible entries of each slice are chained per key, and the slices are
then walked independently from their known entry.  A slice is one row with its times as an array; numpy
functions inside Spark's tasks step through whole batches of slices at a time.

Slices are as wide as the usual jump.  A rare longer jump does not widen them: its landing place is told to the slice it
falls into, as one more possible entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.functions.clock import MICROS, floor_to

NEVER = np.iinfo(np.int64).max


class _Rows:
    """Rows of a batch of groups, one group after the other and by time within each."""

    def __init__(self, lists: pa.Array, at: str, *others: str) -> None:
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64")
        held = lists.flatten()
        self.end = np.cumsum(count)
        self.start = self.end - count
        self.group = np.repeat(np.arange(len(count)), count)
        self.at, *self.others = (held.field(c).to_numpy(zero_copy_only=False) for c in (at, *others))
        self.times = np.unique(self.at)

    def first(self, group: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Row of each group at or after the wanted time; the group's end where there is none."""
        wide = len(self.times) + 1
        placed = self.group * wide + np.searchsorted(self.times, self.at)
        return np.searchsorted(placed, group * wide + np.searchsorted(self.times, wanted, side="left"), side="left")

    def following(self, resume: np.ndarray) -> np.ndarray:
        found = self.first(self.group, resume)
        if (found <= np.arange(len(found))).any():
            raise ValueError("a chain must move forward")
        return found

    def leave(self, resume: np.ndarray) -> np.ndarray:
        """Time at which a walk standing on a row wants to resume after leaving its group."""
        own, found = np.arange(len(resume)), self.following(resume)
        last = np.where(found < self.end[self.group], found, own)
        while not np.array_equal(further := last[last], last):
            last = further
        return resume[last]

    def walk(self, entry: np.ndarray, resume: np.ndarray) -> np.ndarray:
        """Whether a row is stepped on by the walk that enters its group on row ``entry``."""
        found, picked = self.following(resume), np.zeros(len(resume), dtype=bool)
        on, end = entry, self.end
        while len(on):
            inside = on < end
            on, end = on[inside], end[inside]
            picked[on] = True
            on = found[on]
        return picked

    def lists(self, picked: np.ndarray, values: pa.Array) -> pa.Array:
        number = np.bincount(self.group[picked], minlength=len(self.end))
        return pa.ListArray.from_arrays(pa.array(np.append([0], np.cumsum(number)), pa.int32()), values)


def _struct(**columns: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def greedy_chain(
    df: DataFrame,
    key: str,
    at: str,
    resume: str,
    *,
    reach_seconds: int,
    slice_seconds: int = 86400,
) -> DataFrame:
    """Return (key, at) of the selected rows; ``at`` and ``resume`` are epoch microseconds.

    ``reach_seconds`` is how far ``resume`` usually lies behind ``at``; rows that reach further are allowed, and cost one
    row each.  A row never resuming carries the largest long.  (key, at) must be unique.
    """
    width = max(slice_seconds, reach_seconds)
    reach = reach_seconds * MICROS
    rows = df.select(
        F.col(key).alias("key"), F.col(at).alias("at"), F.col(resume).alias("resume")
    ).withColumn("slice", floor_to(F.col("at"), width))

    @F.arrow_udf("array<struct<at: bigint, leave: bigint>>")
    def exits(steps: pa.Array, landings: pa.Array, slices: pa.Array) -> pa.Array:
        held = _Rows(steps, "at", "resume")
        leave = held.leave(held.others[0])
        # A walk enters on a row within reach of the slice start, on the next one, or where a long jump lands.
        near = held.at < slices.to_numpy(zero_copy_only=False)[held.group] + reach
        keep = near.copy()
        keep[1:] |= near[:-1]
        keep[held.start[held.start < held.end]] = True
        of = np.repeat(np.arange(len(landings)), pc.list_value_length(landings).to_numpy(zero_copy_only=False))
        landed = held.first(of, landings.flatten().to_numpy(zero_copy_only=False))
        keep[landed[landed < held.end[of]]] = True
        return held.lists(keep, _struct(at=held.at[keep], leave=leave[keep]))

    @F.arrow_udf("array<struct<slice: bigint, entry: bigint>>")
    def entries(steps: pa.Array) -> pa.Array:
        held = _Rows(steps, "at", "leave", "slice")
        picked = held.walk(held.start, held.others[0])
        return held.lists(picked, _struct(slice=held.others[1][picked], entry=held.at[picked]))

    @F.arrow_udf("array<bigint>")
    def walk(steps: pa.Array, entry: pa.Array) -> pa.Array:
        held = _Rows(steps, "at", "resume")
        first = held.first(np.arange(len(entry)), entry.to_numpy(zero_copy_only=False))
        picked = held.walk(first, held.others[0])
        return held.lists(picked, pa.array(held.at[picked], pa.int64()))

    far = (F.col("resume") - F.col("at") > F.lit(reach)) & (F.col("resume") < F.lit(NEVER))
    landings = rows.filter(far).select(
        "key", F.col("resume").alias("at"), "resume", floor_to(F.col("resume"), width).alias("slice"), F.lit(True).alias("landing")
    )
    told = rows.withColumn("landing", F.lit(False)).unionByName(landings.distinct())
    sliced = told.groupBy("key", "slice").agg(
        F.sort_array(F.collect_list(F.when(~F.col("landing"), F.struct("at", "resume")))).alias("steps"),
        F.collect_list(F.when(F.col("landing"), F.col("at"))).alias("landings"),
    ).filter(F.size("steps") > 0)
    exit_rows = sliced.select("key", "slice", F.explode(exits("steps", "landings", "slice")).alias("x"))
    entry_rows = (
        exit_rows.groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("x.at", "x.leave", "slice"))).alias("exits"))
        .select("key", F.explode(entries("exits")).alias("e"))
        .select("key", "e.slice", "e.entry")
    )
    selected = sliced.join(entry_rows, ["key", "slice"]).select("key", F.explode(walk("steps", "entry")).alias("at"))
    return selected.select(F.col("key").alias(key), F.col("at").alias(at))
