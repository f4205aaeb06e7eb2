"""A small feed-forward classifier trained in epochs over distributed rows, with early stopping and restart.

An epoch is one pass: every partition computes its part of the gradient and of both losses, Spark adds the parts, and the
driver, which holds the parameters and nothing else, takes one AdamW step.  The validation loss of a step comes with the
pass after it, so an epoch costs one pass.  There is no dropout: a fit depends on rows and seed alone.  The state is written to a folder all machines share; a run that
finds one there goes on from it, and gives what an uninterrupted run gives.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schedule:
    """``epochs`` at most (up to 500); stop after ``patience`` epochs without a validation loss lower by ``least_gain``.
    ``keep_every``: epochs between two stored states."""

    hidden: tuple[int, ...] = (16, 8)
    epochs: int = 500
    patience: int = 30
    least_gain: float = 1e-5
    rate: float = 0.001
    decay: float = 0.01
    keep_every: int = 10
    seed: int = 1729

    def __post_init__(self) -> None:
        if not 1 <= self.epochs <= 500 or self.patience < 1:
            raise ValueError("epochs must lie in 1..500 and patience be positive")


@dataclass
class State:
    """Parameters in one vector, the optimiser's moments, and the best parameters so far."""

    sizes: tuple[int, ...]
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    epoch: int = 0
    best: np.ndarray | None = None
    best_epoch: int = 0
    best_loss: float = float("inf")
    history: list[tuple[int, float, float]] = field(default_factory=list)

    @classmethod
    def fresh(cls, width: int, schedule: Schedule) -> "State":
        sizes = (width, *schedule.hidden, 1)
        rng = np.random.default_rng(schedule.seed)
        parts = []
        for a, b in zip(sizes, sizes[1:]):
            limit = 1 / np.sqrt(max(a, 1))
            parts += [rng.uniform(-limit, limit, a * b), rng.uniform(-limit, limit, b)]
        w = np.concatenate(parts)
        return cls(sizes, w, np.zeros_like(w), np.zeros_like(w))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        best = self.weights[:0] if self.best is None else self.best
        np.savez(
            out, sizes=self.sizes, weights=self.weights, first=self.first, second=self.second, best=best,
            marks=[self.epoch, self.best_epoch], best_loss=self.best_loss, history=np.array(self.history, float).reshape(-1, 3),
        )
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> "State":
        z = np.load(io.BytesIO(data))
        history = [(int(e), float(a), float(b)) for e, a, b in z["history"]]
        best = z["best"] if len(z["best"]) else None
        epoch, best_epoch = (int(x) for x in z["marks"])
        return cls(tuple(int(x) for x in z["sizes"]), z["weights"], z["first"], z["second"], epoch, best, best_epoch, float(z["best_loss"]), history)


def layers(weights: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def logits(x: np.ndarray, weights: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Outputs, and what each layer saw."""
    seen = []
    stack = layers(weights, sizes)
    for k, (w, b) in enumerate(stack):
        seen.append(x)
        x = x @ w + b
        if k < len(stack) - 1:
            x = np.maximum(x, 0)
    return x[:, 0], seen


def losses(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log loss of each row."""
    return np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))


def gradient(x: np.ndarray, y: np.ndarray, row_weights: np.ndarray, weights: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, float]:
    """Sums over rows: gradient of the weighted log loss, and the loss."""
    z, seen = logits(x, weights, sizes)
    back = (row_weights * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y))[:, None]
    parts = []
    for (w, _), inputs in zip(reversed(layers(weights, sizes)), reversed(seen)):
        parts = [(inputs.T @ back).ravel(), back.sum(axis=0), *parts]
        back = (back @ w.T) * (inputs > 0)
    return np.concatenate(parts), float((row_weights * losses(z, y)).sum())


def one_pass(rows: DataFrame, state: State) -> tuple[np.ndarray, float, float]:
    """(mean gradient, mean train loss, mean validation loss) at the state's parameters."""
    weights, sizes = state.weights, state.sizes
    size = len(weights)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size + 4)  # gradient, train loss, train rows, validation loss, validation rows
        for batch in batches:
            x, y = np.array(batch["normalized"].tolist(), float).reshape(len(batch), sizes[0]), batch["label"].to_numpy(float)
            train = (batch["split"] == "train").to_numpy()
            if train.any():
                g, loss = gradient(x[train], y[train], batch["weight"].to_numpy(float)[train], weights, sizes)
                total[:size] += g
                total[size:-2] += loss, train.sum()
            if not train.all():
                z, _ = logits(x[~train], weights, sizes)
                total[-2:] += losses(z, y[~train]).sum(), (~train).sum()
        yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

    parts = rows.mapInPandas(partial, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = np.zeros(size + 4)
    for row in parts.collect():  # as many rows as there are parameters
        found[row["place"]] = row["value"]
    return found[:size] / max(found[-3], 1), float(found[size] / max(found[-3], 1)), float(found[-2] / max(found[-1], 1))


def step(state: State, g: np.ndarray, schedule: Schedule) -> None:
    """AdamW with the usual moments."""
    t = state.epoch + 1
    state.first = 0.9 * state.first + 0.1 * g
    state.second = 0.999 * state.second + 0.001 * g * g
    mean, spread = state.first / (1 - 0.9**t), np.sqrt(state.second / (1 - 0.999**t))
    state.weights = state.weights * (1 - schedule.rate * schedule.decay) - schedule.rate * mean / (spread + 1e-8)
    state.epoch = t


def store(spark: SparkSession, state: State, folder: str) -> None:
    frame = spark.createDataFrame([(state.epoch, bytearray(state.dumps()))], "epoch int, state binary")
    frame.coalesce(1).write.mode("append").parquet(folder)  # a write that does not end leaves nothing to be read


def restore(spark: SparkSession, folder: str) -> State | None:
    """The newest state in a folder."""
    try:
        newest = spark.read.parquet(folder).orderBy(F.desc("epoch")).limit(1).collect()
    except AnalysisException:
        return None
    return State.loads(bytes(newest[0]["state"])) if newest else None


def train(frame: DataFrame, schedule: Schedule = Schedule(), folder: str | None = None) -> State:
    """Fit on the train rows of frame (normalized, label, weight, split); the best parameters by validation loss are in
    ``best``, the losses of every epoch in ``history``.  With a folder, go on from the state it holds and store states there."""
    spark = frame.sparkSession
    rows = frame.filter("split IN ('train', 'validation')").select("normalized", "label", "weight", "split")
    state = restore(spark, folder) if folder else None
    if state is None:
        first = rows.select(F.size("normalized").alias("n")).first()
        state = State.fresh(first["n"] if first else 0, schedule)
    g, train_loss, _ = one_pass(rows, state)
    while state.epoch < schedule.epochs and state.epoch - state.best_epoch < schedule.patience:
        step(state, g, schedule)
        before = train_loss
        g, train_loss, validation_loss = one_pass(rows, state)
        state.history.append((state.epoch, before, validation_loss))
        if validation_loss < state.best_loss - schedule.least_gain:
            state.best, state.best_epoch, state.best_loss = state.weights.copy(), state.epoch, validation_loss
        if folder and state.epoch % schedule.keep_every == 0:
            store(spark, state, folder)
    if state.best is None:  # no validation loss at all
        state.best, state.best_epoch = state.weights, state.epoch
    return state
