"""Layered window models: gradients, synchronous steps, rounds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import aggregation as A
from tidegate.operators import models


def data(n, seed, width=6):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 2))
    return (z @ rng.normal(size=(2, width)) + 0.05 * rng.normal(size=(n, width))).astype(np.float32).astype(float)


def windows(spark, x):
    return spark.createDataFrame([(i % 3, i, [float(v) for v in row]) for i, row in enumerate(x)], "client_id long, window_id long, x array<float>").repartition(4)


def test_gradient_is_the_losses():
    model, rng = models.Dense((6, 5, 3, 6)), np.random.default_rng(0)
    flat, x = model.start(1), data(20, 0)
    loss, g = model.gradient(flat, x)
    assert loss == pytest.approx(model.score(flat, x).sum()) and len(g) == len(flat) == model.size == 6 * 5 + 5 + 5 * 3 + 3 + 3 * 6 + 6
    for i in rng.choice(len(flat), 25, replace=False):
        e = np.zeros(len(flat))
        e[i] = 1e-6
        assert g[i] == pytest.approx((model.score(flat + e, x).sum() - model.score(flat - e, x).sum()) / 2e-6, rel=1e-4, abs=1e-6)


def test_steps_equal_those_of_one_machine(spark):
    x, model = data(90, 3), models.Dense((6, 4, 6))
    d = models.dealt(windows(spark, x), 2, seed=5)
    parts = {(r.client_id, tuple(round(v, 4) for v in r.x)): r.part for r in d.collect()}
    assert len(parts) == 90 and set(parts.values()) == {0, 1}
    start = model.start(2)
    changes, losses = models.local_train(d, model, start, [0, 1, 2], 2, 2, rate=0.01, seed=7)
    rng = np.random.default_rng(7)
    orders = [rng.permutation(2).tolist() for _ in range(2)]
    for c in range(3):
        own, adam, w, last = x[c::3], models.Adam(model.size, 0.01), start, []
        where = np.array([parts[c, tuple(round(float(np.float32(v)), 4) for v in row)] for row in own])
        for order in orders:
            last = []
            for p in order:
                loss, g = model.gradient(w, own[where == p])
                last.append(loss)
                w = adam.step(w, g / (where == p).sum())
        assert changes[c] == pytest.approx((w - start).tolist(), rel=1e-6, abs=1e-9) and losses[c] == pytest.approx(sum(last) / len(own))


def test_rounds_learn_and_resist(spark):
    x, model = data(150, 4), models.build("small_ae", 6)
    w = windows(spark, x)
    d = models.dealt(w, 2)
    flip = lambda u: A.scaling(A.sign_flip(u, F.col("client_id") == 1), F.col("client_id") == 1, 20.0)
    error = lambda p: models.score(w, model, p, ["window_id"]).agg(F.avg("score")).first()[0]
    first = error(model.start(0))
    plain, history = models.run_rounds(d, model, 4, epochs=2, parts=2, rate=0.02)
    assert error(plain) < 0.8 * first and np.mean([*history[-1].values()]) < np.mean([*history[0].values()])
    hit, _ = models.run_rounds(d, model, 4, attack=flip, epochs=2, parts=2, rate=0.02)
    held, _ = models.run_rounds(d, model, 4, "median", flip, epochs=2, parts=2, rate=0.02)
    assert error(held) < error(hit)


def test_registry(spark):
    assert models.build("window_ae", 20).size == 20 * 128 + 128 + 128 * 24 + 24 + 24 * 128 + 128 + 128 * 20 + 20
    with pytest.raises(KeyError, match="unknown model"):
        models.build("other", 3)
    # a client that has no window in a part keeps its parameters
    d = models.dealt(spark.createDataFrame([(4, 1, [1.0, 2.0])], "client_id long, window_id long, x array<float>"), 3)
    model = models.build("linear_ae", 2)
    changes, losses = models.local_train(d, model, model.start(0), [4, 5], 1, 3)
    assert (changes[5] == 0).all() and (changes[4] != 0).any() and set(losses) == {4}
