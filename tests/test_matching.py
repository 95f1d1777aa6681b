"""Optimised batches: the derivative against differences, the cosine rises, rows stay in the box, dealing does not matter."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import matching

WIDTH, NAMES = 4, ["x", "y"]
PARAMS = [0.1, -0.3, 0.2, 0.05, 0.4, 0.1, 0.02]


def frame(spark, n: int, clients: int = 2):
    rng = np.random.default_rng(5)
    rows = [(c, i + 1, float(a), float(b), int(i % 3)) for c in range(clients) for i, (a, b) in enumerate(zip(np.cumsum(rng.normal(size=n)), rng.normal(size=n), strict=True))]
    return spark.createDataFrame(rows, "client_id long, row_id long, x double, y double, status int")


def update(z: np.ndarray) -> np.ndarray:
    """The mean of 2 e f over all windows."""
    w = [z[s : s + WIDTH].ravel() for s in range(len(z) - WIDTH + 1)]
    f = np.array([[*v[: (WIDTH - 1) * 2], 1.0] for v in w])
    e = np.array([v[(WIDTH - 1) * 2] for v in w]) - f @ PARAMS
    return (2 * f * e[:, None]).mean(axis=0)


def cosine(z: np.ndarray, g: np.ndarray) -> float:
    u = update(z)
    return float(u @ g / np.linalg.norm(u) / np.linalg.norm(g))


def arrays(state) -> dict:
    out: dict = {}
    for r in state.orderBy("client_id", "row_id").collect():
        out.setdefault(r.client_id, []).append(r.z)
    return {c: np.array(v) for c, v in out.items()}


def test_updates_are_the_model_s(spark):
    state, _ = matching.standard(frame(spark, 30), ["client_id"], NAMES)
    z = arrays(state)
    for r in matching.updates(state, ["client_id"], 2, PARAMS, WIDTH).collect():
        assert np.allclose(r.u, update(z[r.client_id])) and r.n_windows == 27


@pytest.mark.parametrize("aimed", [True, False])
def test_a_step_follows_the_gradient(spark, aimed, monkeypatch):
    g = np.array([0.5, -1.0, 0.3, 0.2, -0.7, 1.0, 0.4])
    state, _ = matching.standard(frame(spark, 24), ["client_id"], NAMES)
    goal = (lambda z: cosine(z, g)) if aimed else (lambda z: float(np.mean([(v[WIDTH * 2 - 2] - np.array([*v[: WIDTH * 2 - 2], 1.0]) @ PARAMS) ** 2 for v in (z[s : s + WIDTH].ravel() for s in range(len(z) - WIDTH + 1))])))
    before, after = arrays(state), arrays(matching._stepped(state, ["client_id"], [True, True], PARAMS, WIDTH, 0.01, 2.5, "row_id", list(g) if aimed else None))
    for c, z in before.items():
        for t in range(len(z)):
            for j in range(2):
                up, down = z.copy(), z.copy()
                up[t, j] += 1e-5
                down[t, j] -= 1e-5
                slope = (goal(up) - goal(down)) / 2e-5
                if abs(slope) > 1e-7:
                    assert np.sign(after[c][t, j] - z[t, j]) == np.sign(slope), (c, t, j)


def test_the_update_turns_and_rows_stay_in_the_box(spark):
    d = frame(spark, 60)
    d = d.withColumn("y", F.when(F.col("row_id") == 7, None).otherwise(F.col("y")))
    g = [0.5, -1.0, 0.3, 0.2, -0.7, 1.0, 0.4]
    new = matching.perturbed(d, ["client_id"], NAMES, WIDTH, params=PARAMS, wanted=g)
    assert new.columns == d.columns and new.filter("y IS NULL").count() == 2
    z, own = matching.standard(d, ["client_id"], NAMES)
    both = d.join(new.select("client_id", "row_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("status").alias("s1")), ["client_id", "row_id"]).join(own, "client_id")
    worst = both.agg(F.max(F.abs(F.col("x1") - F.col("x")) / F.col("s_0")), F.max(F.abs(F.col("y1") - F.col("y")) / F.col("s_1")), F.count_if(F.col("s1") != F.col("status"))).first()
    assert max(worst[0], worst[1]) <= 2.5 + 1e-6 and worst[2] == 0
    shifted = both.select("client_id", "row_id", F.array((F.col("x1") - F.col("m_0")) / F.col("s_0"), F.coalesce((F.col("y1") - F.col("m_1")) / F.col("s_1"), F.lit(0.0))).alias("z"))
    was, now = arrays(z), arrays(shifted)
    for c in was:
        assert cosine(now[c], np.array(g)) > cosine(was[c], np.array(g)) + 0.3 and cosine(now[c], np.array(g)) > 0.8


def test_dealing_and_protection(spark, monkeypatch):
    d = frame(spark, 40)
    whole = {(r.client_id, r.row_id): (r.x, r.y) for r in matching.perturbed(d, ["client_id"], NAMES, WIDTH, protect=["y"], params=PARAMS, steps=3).collect()}
    was = {(r.client_id, r.row_id): (r.x, r.y) for r in d.collect()}
    assert all(whole[k][1] == was[k][1] for k in was) and any(whole[k][0] != was[k][0] for k in was)
    real = matching.order.in_blocks
    monkeypatch.setattr(matching.order, "in_blocks", lambda df, before, after, row="row_id", block=0: real(df, before, after, row, 8))
    parts = {(r.client_id, r.row_id): (r.x, r.y) for r in matching.perturbed(d, ["client_id"], NAMES, WIDTH, protect=["y"], params=PARAMS, steps=3).collect()}
    assert all(np.allclose(parts[k], whole[k]) for k in was)
    short = d.filter("row_id < 4")
    assert sorted(map(tuple, matching.perturbed(short, ["client_id"], NAMES, WIDTH, params=PARAMS, steps=2).collect())) == sorted(map(tuple, short.collect()))
    assert matching.perturbed(d.filter("false"), ["client_id"], NAMES, WIDTH, params=PARAMS, steps=1).count() == 0
    assert matching.perturbed(d.filter("false"), ["client_id"], NAMES, WIDTH).count() == 0


def test_without_a_wanted_update_the_error_rises(spark):
    from tidegate.operators import scenario

    d = frame(spark, 50)
    new = scenario.fabricated(d, "optimised", ["x", "y", "status"], 0, {"steps": 4, "width": WIDTH})
    assert new.columns == d.columns and new.join(d, ["client_id", "row_id", "status"]).count() == 100
    state, own = matching.standard(d, ["client_id"], ["x", "y", "status"])
    params = matching.surrogate(state, ["client_id"], 3, WIDTH)
    z = new.join(own, "client_id").select("client_id", "row_id", F.array(*[(F.col(c) - F.col(f"m_{i}")) / F.col(f"s_{i}") for i, c in enumerate(["x", "y", "status"])]).alias("z"))
    error = lambda t: {r.client_id: r.error for r in matching.updates(t, ["client_id"], 3, params, WIDTH).collect()}
    before, after = error(state), error(z)
    assert all(after[c] > 2 * before[c] for c in before)
