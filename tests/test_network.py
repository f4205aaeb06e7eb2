import random

import numpy as np
import pytest

from augury.operators import network as N

KIND = "normalized array<double>, label double, weight double, split string"


def rows(n=240, seed=1, noise=0.3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(4)]
        label = float(x[0] * x[1] + rng.gauss(0, noise) > 0)
        out.append((x, label, 2.0 if label else 1.0, ("train", "train", "validation", "purged")[i % 4]))
    return out


def frame(spark, given):
    return spark.createDataFrame(given, KIND).repartition(5)


def alone(given, schedule):
    """The same training in one process."""
    part = lambda s: [np.array(v, float) for v in zip(*[(x, y, w) for x, y, w, k in given if k == s])]
    (x, y, w), (vx, vy, _) = part("train"), part("validation")
    state = N.State.fresh(4, schedule)
    while state.epoch < schedule.epochs and state.epoch - state.best_epoch < schedule.patience:
        g, loss = N.gradient(x, y, w, state.weights, state.sizes)
        N.step(state, g / len(x), schedule)
        held = float(N.losses(N.logits(vx, state.weights, state.sizes)[0], vy).mean())
        state.history.append((state.epoch, loss / len(x), held))
        if held < state.best_loss - schedule.least_gain:
            state.best, state.best_epoch, state.best_loss = state.weights.copy(), state.epoch, held
    return state


def test_gradient_is_the_slope():
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float), rng.uniform(1, 3, 30)
    state = N.State.fresh(4, N.Schedule(hidden=(5, 3)))
    g, _ = N.gradient(x, y, w, state.weights, state.sizes)
    for i in rng.choice(len(g), 20, replace=False):
        moved = [state.weights.copy() for _ in range(2)]
        moved[0][i] += 1e-6
        moved[1][i] -= 1e-6
        up, down = (N.gradient(x, y, w, m, state.sizes)[1] for m in moved)
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def test_distributed_epochs_equal_one_process(spark):
    given, schedule = rows(), N.Schedule(hidden=(5,), epochs=12, rate=0.05)
    got, want = N.train(frame(spark, given), schedule), alone(given, schedule)
    assert got.best_epoch == want.best_epoch and np.array(got.history) == pytest.approx(np.array(want.history))
    assert got.best == pytest.approx(want.best)


def test_patience_keeps_the_best_epoch(spark):
    given, schedule = rows(60, 3, 3.0), N.Schedule(hidden=(8,), patience=4, rate=0.2)
    state = N.train(frame(spark, given), schedule)
    held = [h for _, _, h in state.history]
    assert len(held) == state.best_epoch + 4 < 500 and state.best_loss == min(held)


def test_an_interrupted_run_goes_on(spark, tmp_path):
    given = frame(spark, rows())
    whole = N.train(given, N.Schedule(hidden=(5,), epochs=9, rate=0.05))
    folder = str(tmp_path / "states")
    N.train(given, N.Schedule(hidden=(5,), epochs=5, rate=0.05, keep_every=2), folder)  # stored at 2 and 4
    assert N.restore(spark, folder).epoch == 4
    rest = N.train(given, N.Schedule(hidden=(5,), epochs=9, rate=0.05, keep_every=2), folder)
    assert rest.best == pytest.approx(whole.best) and [h[0] for h in rest.history] == list(range(1, 10))


def test_empty_parts(spark):
    only = [r for r in rows(40) if r[3] == "train"]
    state = N.train(frame(spark, only), N.Schedule(hidden=(3,), epochs=3))
    assert state.epoch == 3 and state.best is not None
    assert N.train(frame(spark, only).limit(0), N.Schedule(hidden=(3,), epochs=2)).best is not None
    with pytest.raises(ValueError):
        N.Schedule(epochs=501)
