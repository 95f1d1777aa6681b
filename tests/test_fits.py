"""Least squares, paired couplings, mixtures, trees, two-way differences and integer rules as tables."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.functions import trees
from tidegate.operators import fits, fixedpoint, mining, rules, stats


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) * [1, 1e3, 1e-3, 1] + [0, 1e6, 0, 5]
    y = x @ [2.0, 0.01, 300.0, 0.0] + 7 + rng.normal(size=300)
    rows = [(i % 2, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))] + [(0, 1.0, None, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0, 1.0, float("nan"))]
    d = spark.createDataFrame(rows, "k int, a double, b double, c double, e double, y double").repartition(5)
    for got in fits.least_squares(d, ["k"], "y", ["a", "b", "c", "e"]).collect():
        own = np.arange(300) % 2 == got.k
        m = np.c_[np.ones(150), x[own]]
        want, *_ = np.linalg.lstsq(m, y[own], rcond=None)
        r2 = 1 - ((y[own] - m @ want) ** 2).sum() / ((y[own] - y[own].mean()) ** 2).sum()
        assert got.n == 150 and got.r2 == pytest.approx(r2) and [got.coef_a, got.coef_b, got.coef_c, got.coef_e] == pytest.approx(want[1:].tolist(), rel=1e-6, abs=1e-6)


def test_predictors_that_say_nothing_new(spark):
    d = spark.range(50).select(F.col("id").cast("double").alias("a"), (2 * F.col("id")).cast("double").alias("b"), F.lit(3.0).alias("c"), (5 * F.col("id") + 1).cast("double").alias("y"))
    r = fits.least_squares(d, [], "y", ["a", "b", "c"]).first()
    assert (r.r2, r.coef_a, r.coef_b, r.coef_c, r.const) == pytest.approx((1, 5, 0, 0, 1))
    assert fits.least_squares(d.filter("a < 0"), [], "y", ["a"]).first().n == 0


def test_couplings_by_name(spark):
    d = spark.range(100).select((F.col("id") % 2).alias("S_1"), F.lit(0).alias("S_2"), (F.col("id") % 2 * 4.0 + F.col("id") / 1e4 * (F.col("id") % 2)).alias("F_1"), F.lit(0.0).alias("F_2"))
    got = {r.status: r for r in fits.paired_couplings(d, [("S_1", "F_1"), ("S_2", "F_2")]).collect()}
    assert got["S_1"].kept and got["S_1"].nominal == pytest.approx(4.005) and not got["S_2"].kept and got["S_2"].n_on == 0


def test_mixtures_fit_all_rows_alike(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, 600), rng.normal(20, 2, 300), rng.normal(50, 1, 100)])
    rows = [("s", float(x), 1) for x in v] + [("t", 5.0, 40), ("none", None, 3)]
    d = spark.createDataFrame(rows, "sensor string, value double, n int")
    one, many = ({r.sensor: r.w for r in mining.mixtures(d.repartition(p), rounds=25).collect()} for p in (1, 64))
    assert set(one) == {"s", "t"}
    for a, b in zip(one["s"], many["s"], strict=True):
        assert tuple(a) == pytest.approx(tuple(b), rel=1e-9)
    assert [c.mean for c in one["s"]] == pytest.approx([0, 20, 50], abs=0.4) and [c.weight for c in one["s"]] == pytest.approx([0.6, 0.3, 0.1], abs=0.01)


def test_states_pin_an_actuator(spark):
    d = spark.range(900).select((F.col("id") % 3 * 10 + F.rand(3)).alias("x"), F.when(F.col("id") % 3 == 2, 1).otherwise(2).alias("a"), (F.col("id") % 7).cast("int").alias("b"))
    got = mining.state_rules(d, ["x"], ["a", "b", "x"], rounds=20).collect()
    assert [(r.component, r.actuator, r.value, r.purity) for r in got] == [(0, "a", 2.0, 1.0), (1, "a", 2.0, 1.0), (2, "a", 1.0, 1.0)]


def test_trees(spark):
    rows = [(1, '{"a": [1, {"b": "x y"}], "c": null, "d": {}, "e": [], "f": {"g": {"h": true}}}'), (2, "7"), (3, None)]
    got = {(r.k, r.path): r.value for r in trees.flattened(spark.createDataFrame(rows, "k int, j string"), ["k"], "j").collect()}
    assert got == {(1, "$.a[0]"): "1", (1, "$.a[1].b"): "x y", (1, "$.c"): None, (1, "$.d"): "{}", (1, "$.e"): "[]", (1, "$.f.g.h"): "true", (2, "$"): "7"}
    with pytest.raises(ValueError, match="deeper"):
        trees.flattened(spark.createDataFrame(rows, "k int, j string"), ["k"], "j", deepest=2)
    a, b = (spark.createDataFrame(x, "path string, value string") for x in ([("p", "1.0"), ("q", "x"), ("r", None)], [("p", "1.0000000001"), ("q", "y"), ("s", "1")]))
    assert {r.path for r in stats.tree_diff(a, b).collect()} == {"q", "s"}


def test_differences_both_ways(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x int") for xs in ([1, 1, 2, None], [1, 2, 2, None]))
    assert {(r.x, r.side) for r in stats.two_way(a, b).collect()} == {(1, "a"), (2, "b")}
    assert stats.two_way(a, a).count() == 0


def test_integer_rules_as_tables_and_their_range(spark):
    own = [replace(rules.coupling("s", "f", 2.5, 1, 2, steady=True), eps=0.5), replace(rules.linear("v", {"k": -0.25}, 3.0, diff=True), eps=1.0)]
    q = fixedpoint.quantise(own, ["s", "f", "v", "k"])
    back = fixedpoint.from_table(fixedpoint.as_table(spark, q))
    assert back == q and [(r.cur, r.prev, r.applies) for r in back] == [(r.cur, r.prev, r.applies) for r in q]
    with pytest.raises(ValueError, match="can reach"):
        fixedpoint.quantise([replace(rules.linear("v", {"k": 1e9}, 0.0), eps=1.0)], ["v", "k"])
    with pytest.raises(ValueError, match="can reach"):
        fixedpoint.quantise([replace(rules.linear("v", {"k": 1.0}, 0.0), eps=1e10)], ["v", "k"])


def test_models_apart_disagree_where_they_should(spark):
    """A planted wrong answer is the only row that both models do not share."""
    own = [replace(rules.coupling("s", "f", 2.5, 1, 2, steady=True), eps=0.5)]
    s = fixedpoint.SCALE
    d = spark.createDataFrame([(i, (1 + i % 4 // 2) * s, (2 if i % 5 else 9) * s, (1 + (i - 1) % 4 // 2) * s, i > 0) for i in range(40)], "i int, x_s long, x_f long, prev_x_s long, has_prev boolean")
    fixed = fixedpoint.quantise(own, ["s", "f"])[0]
    first = d.select("i", fixedpoint.integer_applies(fixed).alias("a"), fixedpoint.integer_violates(fixed).alias("v"))
    a, v = fixedpoint.decimal_model(d, own)[0]
    second = d.select("i", a.alias("a"), v.alias("v"))
    assert stats.two_way(first, second).count() == 0 and first.filter("v").count() > 0
    wrong = second.withColumn("v", F.when(F.col("i") == 7, ~F.col("v")).otherwise(F.col("v")))
    assert sorted((r.i, r.side) for r in stats.two_way(first, wrong).collect()) == [(7, "a"), (7, "b")]
