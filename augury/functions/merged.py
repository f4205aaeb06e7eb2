"""Statistics of sliding windows over many series at once, merged from panes: numpy inside Spark's tasks.

A pane summarises the samples of a short stretch of a series (count, moments, cross moments, first and last, extremes and its
own half-life average); a window merges its panes in time order.  Counts and moments merge pairwise; the half-life average is an
affine map of the average before the pane.  The median alone reads the values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MICROS = 1_000_000
# Most windows, and most values of sorted windows, that are held at a time.
WINDOWS, VALUES = 1 << 16, 1 << 20

FIELDS = (
    ("end_us", "bigint"), ("count", "bigint"), ("first_us", "bigint"), ("last_us", "bigint"), ("__first", "double"), ("latest", "double"),
    ("mean", "double"), ("std", "double"), ("min", "double"), ("max", "double"), ("__slope", "double"), ("rolling_variance", "double"),
    ("ewma", "double"), ("median", "double"),
)


@dataclass(frozen=True)
class Grid:
    """Durations in microseconds; window, tick and variance window are whole multiples of the pane."""

    window: int
    tick: int
    pane: int
    variance_window: int
    half_life: int

    def decay(self, us: np.ndarray) -> np.ndarray:
        return np.exp2(-us / self.half_life)


class Panes:
    """Panes of series whose samples are given one series after the other."""

    def __init__(self, series: np.ndarray, t: np.ndarray, v: np.ndarray, grid: Grid) -> None:
        order = np.lexsort((t, series))
        t, self.v = t[order], v[order]
        number = -(-t // grid.pane)
        new = np.ones(len(t), dtype=bool)
        new[1:] = (series[1:] != series[:-1]) | (number[1:] != number[:-1])
        self.at = at = np.flatnonzero(new)
        self.n = n = np.diff(np.append(at, len(t)))
        self.series, self.number = series[at], number[at]
        self.end = self.number * grid.pane
        v, own = self.v, np.repeat(np.arange(len(at)), n)
        x = (t - self.end[own]) / MICROS
        self.m, self.tm = np.add.reduceat(v, at) / n, np.add.reduceat(x, at) / n
        dv, dx = v - self.m[own], x - self.tm[own]
        self.s, self.tt, self.tv = (np.add.reduceat(y, at) for y in (dv * dv, dx * dx, dx * dv))
        self.t1, self.tl = t[at], t[at + n - 1]
        self.v1, self.vl = v[at], v[at + n - 1]
        self.lo, self.hi = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
        self.e = self.v1.copy()
        for j in range(1, int(n.max())):
            longer = np.flatnonzero(n > j)
            i = at[longer] + j
            self.e[longer] = v[i] + grid.decay(t[i] - t[i - 1]) * (self.e[longer] - v[i])

    def of(self, series: np.ndarray, end: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
        """First pane of each window, and the one after its last."""
        least, wide = self.number.min(), grid.window // grid.pane
        reach = self.number.max() - least + 2 * wide + 2
        placed = self.series * reach + (self.number - least)
        # A window far from all samples must not reach into those of the next series.
        last = series * reach + np.clip(end // grid.pane - least, -1, reach - 1)
        return np.searchsorted(placed, last - wide, "right"), np.searchsorted(placed, last, "right")


def _merge(p: Panes, end: np.ndarray, low: np.ndarray, size: np.ndarray, grid: Grid) -> dict[str, np.ndarray]:
    """Windows with the most panes come first, so those that have a j-th pane are the first ones."""
    since = end - grid.variance_window
    n, m, s, tt, tv, e = (x[low] for x in (p.n, p.m, p.s, p.tt, p.tv, p.e))
    tm = p.tm[low] + (p.end[low] - end) / MICROS
    tl, lo, hi = p.tl[low], p.lo[low], p.hi[low]
    recent = p.end[low] > since
    rn, rm, rs = (np.where(recent, x, 0) for x in (n, m, s))
    for j in range(1, int(size[0])):
        k = int(np.searchsorted(-size, -j))
        q = low[:k] + j
        qn, qm, qs, qe = p.n[q], p.m[q], p.s[q], p.end[q]
        total = n[:k] + qn
        d, dt, share, both = qm - m[:k], p.tm[q] + (qe - end[:k]) / MICROS - tm[:k], qn / total, n[:k] * qn / total
        m[:k] += d * share
        s[:k] += qs + d * d * both
        tm[:k] += dt * share
        tt[:k] += p.tt[q] + dt * dt * both
        tv[:k] += p.tv[q] + d * dt * both
        e[:k] = p.e[q] + grid.decay(p.tl[q] - tl[:k]) * (e[:k] - p.v1[q])
        n[:k], tl[:k] = total, p.tl[q]
        np.minimum(lo[:k], p.lo[q], out=lo[:k])
        np.maximum(hi[:k], p.hi[q], out=hi[:k])
        recent = np.flatnonzero(qe > since[:k])
        rq, was = qn[recent], rn[recent]
        all_, rd = was + rq, qm[recent] - rm[recent]
        rm[recent] += rd * rq / all_
        rs[recent] += qs[recent] + rd * rd * (was * rq / all_)
        rn[recent] = all_
    after = low + size - 1
    return {
        "end_us": end, "count": n, "first_us": p.t1[low], "last_us": tl, "__first": p.v1[low], "latest": p.vl[after], "mean": m,
        "std": np.sqrt(s / n), "min": lo, "max": hi, "__slope": np.where(tt > 0, tv / tt, np.nan),
        "rolling_variance": np.where(rn > 0, rs / rn, np.nan), "ewma": e,
    }


def _medians(v: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Medians of the stretches of n values from first on; those of like length are sorted together."""
    order, out, done = np.argsort(-n, kind="stable"), np.empty(len(n)), 0
    while done < len(order):
        width = int(n[order[done]])
        some = order[done : done + max(1, VALUES // width)]
        column = np.arange(width)
        inside = column < n[some][:, None]
        values = np.where(inside, v[np.minimum(first[some][:, None] + column, len(v) - 1)], np.inf)
        values.sort(axis=1)
        row = np.arange(len(some))
        out[some] = (values[row, (n[some] - 1) // 2] + values[row, n[some] // 2]) / 2
        done += len(some)
    return out


def _windows(series: np.ndarray, t: np.ndarray, v: np.ndarray, ends: np.ndarray, of: np.ndarray, grid: Grid) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    p = Panes(series, t, v, grid)
    low, high = p.of(of, ends, grid)
    held = np.flatnonzero(high > low)  # between two samples further apart than a window lie windows without any
    held = held[np.argsort(low[held] - high[held], kind="stable")]
    if len(held) == 0:
        return of[held], {name: np.empty(0, dtype="int64" if kind == "bigint" else "float64") for name, kind in FIELDS}
    found = _merge(p, ends[held], low[held], (high - low)[held], grid)
    found["median"] = _medians(p.v, p.at[low[held]], found["count"])
    order = np.lexsort((found["end_us"], of[held]))
    return of[held][order], {name: found[name][order] for name, _ in FIELDS}


def window_statistics(counts: np.ndarray, t: np.ndarray, v: np.ndarray, first: np.ndarray, last: np.ndarray, grid: Grid) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Windows of each series that hold a sample, with ends first, first + tick, ... last; and their number for each series.

    counts: samples of each series; t, v: instants (us, none twice in a series) and values, one series after the other."""
    ticks = (last - first) // grid.tick + 1
    at, merged, number = np.concatenate([[0], np.cumsum(counts)]), [], np.zeros(len(counts), dtype="int64")
    with np.errstate(all="ignore"):
        for some in parts(ticks, WINDOWS):
            c, rows = ticks[some], np.arange(some.stop - some.start)
            of = np.repeat(rows, c)
            ends = first[some][of] + (np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c)) * grid.tick
            own = slice(at[some.start], at[some.stop])
            of, found = _windows(np.repeat(rows, counts[some]), t[own], v[own], ends, of, grid)
            number[some] = np.bincount(of, minlength=len(rows))
            merged.append(found)
    return number, {name: np.concatenate([x[name] for x in merged]) for name, _ in FIELDS}


def parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of rows whose sizes add up to most; a larger row is one on its own."""
    reached, start = np.concatenate([[0], np.cumsum(sizes)]), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(reached, reached[start] + most, "right")) - 1)
        yield slice(start, stop)
        start = stop


def derived(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Base statistics with those that rest on changes, which need two samples; undefined ones are not finite."""
    several = found["count"] > 1
    delta = found["latest"] - found["__first"]
    changes = {
        "delta": delta,
        "percentage_change": 100.0 * delta / np.abs(found["__first"]),
        "linear_trend": found["__slope"],
        "rate_of_change": delta / ((found["last_us"] - found["first_us"]) / MICROS),
    }
    return found | {name: np.where(several, x, np.nan) for name, x in changes.items()}


class Wide:
    """Windows of rows that hold samples of several kinds: arrays by window and kind, count 0 where a kind has no sample."""

    def __init__(
        self, counts: np.ndarray, kind: np.ndarray, t: np.ndarray, v: np.ndarray, first: np.ndarray, last: np.ndarray, grid: Grid, kinds: int, stats: tuple[str, ...]
    ) -> None:
        ticks = (last - first) // grid.tick + 1
        self.start, self.ticks, self.first, self.tick = np.cumsum(ticks) - ticks, ticks, first, grid.tick
        self.row = np.repeat(np.arange(len(ticks)), ticks)
        self.end = first[self.row] + (np.arange(len(self.row)) - self.start[self.row]) * grid.tick
        of = np.repeat(np.arange(len(counts)), counts) * kinds + kind
        order = np.argsort(of, kind="stable")
        series, n = np.unique(of, return_counts=True)
        owner = series // kinds
        number, found = window_statistics(n, t[order], v[order], first[owner], last[owner], grid)
        with np.errstate(all="ignore"):
            found = derived(found)
        owner = np.repeat(owner, number)
        at = self.start[owner] + (found["end_us"] - first[owner]) // grid.tick, np.repeat(series % kinds, number)
        shape = len(self.row), kinds
        self.count, self.first_us, self.last_us = (np.zeros(shape, dtype="int64") for _ in range(3))
        self.values = np.full((*shape, len(stats)), np.nan)
        self.count[at], self.first_us[at], self.last_us[at] = (found[name] for name in ("count", "first_us", "last_us"))
        for i, name in enumerate(stats):
            self.values[(*at, i)] = found[name]

    def forget(self, which: np.ndarray) -> None:
        self.count[which] = 0
        self.values[which] = np.nan

    def find(self, counts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given ends, counts of which belong to each row, are ends of their row's windows; and which windows."""
        row = np.repeat(np.arange(len(counts)), counts)
        place, off = np.divmod(ends - self.first[row], self.tick)
        which = np.flatnonzero((off == 0) & (place >= 0) & (place < self.ticks[row]))
        return which, self.start[row[which]] + place[which]
