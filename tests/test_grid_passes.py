"""The grid's windows are met once for all cells, and moments and reports keep to what is known of a window."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import federation, grid, scenario
from tidegate.plans import scenarios

WINDOWS = "seed int, set string, x array<float>, label int, targeted boolean"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_windows_are_not_multiplied_by_cells(spark):
    rows = [(0, "clean_val", [float(i), 0.0], 0, False) for i in range(4)] + [(0, "test", [3.0, 0.0], 1, True), (0, "test", [9.0, 0.0], 1, False), (0, "test", [None, 0.0], 1, False), (0, "test", [9.0, 0.0], None, False), (7, "test", [1.0, 0.0], 1, True)]
    cells = spark.createDataFrame([(0, m, "krum", [1.0, b]) for m, b in (("clean", 0.0), ("gated", 1.0))], "seed int, mode string, defence string, w array<double>")
    out = grid.evaluated(spark.createDataFrame(rows, WINDOWS), cells, 1, 1.0)
    assert "lambda" not in plan(out) and "MapInArrow" in plan(out)
    got = {r.mode: r for r in out.collect()}
    # a window as far as the threshold raises no alarm, nor does one with an unknown reading, which counts among the others' windows
    assert {m: (r.threshold, r.precision, r.recall, r.f1, r.targeted_recall, r.untargeted_recall) for m, r in got.items()} == {"clean": (9.0, 1.0, 0.5, pytest.approx(2 / 3), 0.0, 0.5), "gated": (16.0, 1.0, 0.5, pytest.approx(2 / 3), 0.0, 0.5)}


def test_moments_in_a_product_of_matrices(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 6))
    rows = [(i % 3, [None if (i, j) == (5, 1) else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]
    m = federation.moments(spark.createDataFrame(rows, "client_id int, x array<double>"), 6, 2)
    assert "MapInArrow" in plan(m)
    x[5, 1] = np.nan
    for r in m.collect():
        own = x[r.client_id :: 3]
        f, y = np.column_stack([own[:, :4], np.ones(len(own))]), own[:, 4]
        assert r.n == len(own) and np.allclose(r.a, np.nanmean(f[:, :, None] * f[:, None, :], axis=0)) and np.allclose(r.b, np.nanmean(f * y[:, None], axis=0))


def test_evaluation_windows_in_one_pass(spark, data):
    sc = scenarios.built(spark, data)
    w = scenario.evaluation_windows(sc, 10, ["value", "flow"])
    assert "window_id" not in "".join(line for line in plan(w).splitlines() if "Join" in line)
    aims = {i for t in sc.targets.collect() for i in range(t.start_row, t.start_row + t.n_rows)}
    assert {r.window_id for r in w.filter("set = 'test' AND targeted").collect()} == {i for i in range(sc.attack.count() - 9) if aims & set(range(i + 1, i + 11))}
    assert w.filter(F.size("x") != 20).count() == 0
