"""Keyed stream processing in event time, whatever the order in which rows arrive.

Rows wait in a map state, in slices of time, until the watermark has passed them; a timer at the earliest waiting row
(or at a deadline of the processor's own) wakes the key.  What lies behind the watermark is handed over in order
of time, then of id.  So a stream fed late, in any order or in any cut into batches gives the same rows, as long
as a row comes within the watermark's delay; later ones are dropped and counted by Spark
(numRowsDroppedByWatermark of the query's progress).  State holds the rows of one delay and of one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MILLI = 1000


class InOrder(StatefulProcessor):
    """Base of processors that need order.  ``fields``: (column, type) of a row, the first two being us, the
    instant in microseconds, and id, which orders rows of one instant and tells repeated ones apart."""

    fields: tuple[tuple[str, str], ...] = ()
    output: tuple[str, ...] = ()

    def __init__(self, slice_seconds: int) -> None:
        self.slice_us = slice_seconds * 1_000_000

    # ---- what a processor adds

    def setup(self, handle: StatefulProcessorHandle) -> None:
        """Declare state."""

    def load(self) -> None:
        """Read state once per wake-up."""

    def save(self) -> None:
        """Write it back."""

    def step(self, key: tuple, row: tuple) -> list[tuple]:
        """Output of the next row in order."""
        raise NotImplementedError

    def deadline(self) -> int | None:
        """Last instant (us) at which nothing happens without a row."""
        return None

    def late(self, key: tuple) -> list[tuple]:
        """Output once the watermark has passed the deadline."""
        return []

    # ---- order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = ", ".join(f"{name}:{kind}" for name, kind in self.fields)
        self.waiting = handle.getMapState("waiting", "slice bigint", f"rows array<struct<{row}>>")
        self.woken = handle.getValueState("woken", "at bigint")
        self.setup(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [name for name, _ in self.fields]
        first = None
        for part in rows:
            part = part[names].astype({names[0]: "int64"})
            for number, own in part.groupby(part[names[0]] // self.slice_us):
                at = (int(number),)
                held = list(self.waiting.getValue(at)[0]) if self.waiting.containsKey(at) else []
                new = [_plain(r) for r in own.itertuples(index=False)]
                self.waiting.updateValue(at, ([tuple(r) for r in held] + new,))
            earliest = int(part[names[0]].min())
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * MILLI
        self.woken.clear()
        self.load()
        out: list[tuple] = []
        left = None
        for number in sorted(int(k[0]) for k in self.waiting.keys()):
            if number * self.slice_us > passed:
                left = self._earliest(number, left)
                break
            held = [tuple(r) for r in self.waiting.getValue((number,))[0]]
            ready = {r[:2]: r for r in held if r[0] <= passed}
            rest = [r for r in held if r[0] > passed]
            for at in sorted(ready):
                out += self.step(key, ready[at])
            if rest:
                self.waiting.updateValue((number,), (rest,))
                left = min(r[0] for r in rest)
                break
            self.waiting.removeKey((number,))
        end = self.deadline()
        if end is not None and end < passed:
            out += self.late(key)
            end = self.deadline()
        self.save()
        if end is not None:
            self._wake(end + 1)
        if left is not None:
            self._wake(left)
        if out:
            yield pd.DataFrame(out, columns=list(self.output))

    def _earliest(self, number: int, left: int | None) -> int:
        return min(int(r[0]) for r in self.waiting.getValue((number,))[0])

    def _wake(self, us: int) -> None:
        """One timer for a key, at the earliest instant asked for."""
        at = -(-us // MILLI)
        if self.woken.exists():
            before = int(self.woken.get()[0])
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.woken.update((at,))

    def close(self) -> None:
        pass


def _plain(row) -> tuple:
    """Python values of a frame's row, which is what state takes."""
    return tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in row)
