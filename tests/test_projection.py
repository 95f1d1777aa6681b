"""Projection: the segmented solution against dense algebra, batches of several segments, protected channels, nulls."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import order, projection, rules

RULES = [replace(rules.linear("x", {"y": 0.5}, 0.0, diff=True), eps=2.0), replace(rules.coupling("s", "y", 3.0), eps=1.5), replace(rules.linear("z", {"x": 0.1}, 0.2), eps=2.5)]
NAMES = ["x", "y", "z", "s"]


def batch(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([np.cumsum(rng.normal(size=n)) * 2, rng.normal(size=n) * 2, rng.normal(size=n) * 2, rng.integers(0, 3, n).astype(float)], axis=1)


def dense(x: np.ndarray, protect: tuple[str, ...], target: float = 0.0) -> np.ndarray:
    """The same passes with the whole matrix A and its pseudoinverse."""
    n, c = len(x), projection.constraints(NAMES, RULES, protect)
    ok = np.ones((n, len(RULES)), bool)
    ok[:, 1] = np.isin(np.rint(x[:, 3]), (0, 1))
    ok[0] = False
    active, out = np.zeros_like(ok), x.copy()
    for _ in range(projection.OUTER):
        r = out @ c.cur.T + c.const
        r[1:] += out[:-1] @ c.prev.T
        bad = ok & (np.abs(r) > c.eps)
        if bad.any(axis=1).mean() <= target:
            break
        active |= bad
        where = np.argwhere(active)
        a = np.zeros((len(where), n, len(NAMES)))
        for k, (t, i) in enumerate(where):
            a[k, t] += c.cur[i] * c.free
            a[k, t - 1] += c.prev[i] * c.free
        gap = np.array([np.clip(r[t, i], -0.95 * c.eps[i], 0.95 * c.eps[i]) - r[t, i] for t, i in where])
        out = out + (np.linalg.pinv(a.reshape(len(where), -1)) @ gap).reshape(x.shape)
    return out


def frame(spark, batches: dict):
    rows = [(k, 3 * i + 1, *map(float, v)) for k, x in batches.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "site string, row_id long, x double, y double, z double, s double")


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 37])
def test_block_system_is_solved(n):
    rng = np.random.default_rng(n)
    a = np.zeros((n * 2, n * 2))
    for t in range(n):
        a[2 * t : 2 * t + 2, 2 * t : 2 * t + 2] = np.eye(2) * 4
        if t:
            e = rng.normal(size=(2, 2)) * 0.5
            a[2 * t - 2 : 2 * t, 2 * t : 2 * t + 2], a[2 * t : 2 * t + 2, 2 * t - 2 : 2 * t] = e, e.T
    b = rng.normal(size=(n, 2, 3))
    d = np.stack([a[2 * t : 2 * t + 2, 2 * t : 2 * t + 2] for t in range(n)])
    e = np.stack([a[2 * t : 2 * t + 2, 2 * t + 2 : 2 * t + 4] for t in range(n - 1)]) if n > 1 else np.zeros((0, 2, 2))
    assert np.allclose(projection.tridiagonal(d, e, b).reshape(2 * n, 3), np.linalg.solve(a, b.reshape(2 * n, 3)))


@pytest.mark.parametrize("block", [4, None])  # four levels and one
def test_equals_dense_algebra_at_any_segment(spark, block):
    data = {"a": batch(90, 1), None: batch(65, 2), "c": batch(1, 3)}
    got = projection.project(frame(spark, data), ["site"], NAMES, RULES, protect=["s"], block=block).toPandas().sort_values("row_id")
    for k, x in data.items():
        mine = got[got["site"].isna()] if k is None else got[got["site"] == k]
        assert len(mine) == len(x)
        assert np.allclose(mine[NAMES].to_numpy(), dense(x, ("s",)), atol=1e-5), k
        assert (mine["s"].to_numpy() == x[:, 3]).all()


def test_projected_batches_are_admitted_and_admitted_ones_stay(spark):
    d = frame(spark, {"a": batch(600, 4), "b": batch(130, 5)})
    rule = RULES[:1]
    p = projection.project(d, ["site"], NAMES, rule, protect=["y", "z", "s"], block=64)
    share = lambda t: {r.site: r.violating_fraction for r in rules.verdicts(rules.residuals(order.with_previous(order.cumulative(t, ["site"], F.lit(0), [F.col("row_id")], row="i"), ["site"], ["x"], row="i"), rule), ["site"], rule).collect()}
    assert min(share(d).values()) > 0.2 and set(share(p).values()) == {0.0}
    again = projection.project(p.drop("moved"), ["site"], NAMES, rule, protect=["y", "z", "s"], block=64)
    assert again.agg(F.max("moved")).first()[0] == 0 and again.count() == 730
    most = projection.project(d, ["site"], NAMES, rule, protect=["y", "z", "s"], target=1.0)
    assert most.agg(F.max("moved")).first()[0] == 0


def test_nulls_bind_nothing_and_empty_batches(spark):
    x = batch(40, 6)
    x[10, 0], x[20, 1] = np.nan, np.nan
    d = frame(spark, {"a": x})
    p = projection.project(d, ["site"], NAMES, RULES[:1], protect=["s"]).toPandas().sort_values("row_id")
    assert np.isnan(p["x"].to_numpy()[10]) and np.isnan(p["y"].to_numpy()[20]) and p[["x", "y"]].isna().sum().sum() == 2
    r = p["x"].diff() - 0.5 * p["y"]
    assert (r.abs().dropna() <= 2.0).all()
    assert projection.project(d.filter("false"), ["site"], NAMES, RULES).count() == 0
    assert projection.project(d, ["site"], NAMES, []).count() == 40
