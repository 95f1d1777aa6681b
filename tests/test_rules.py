"""Exact fixtures for rules, calibration and verdicts."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidegate.functions.names import is_flow
from tidegate.operators import fixedpoint, order, rules


def record(spark, rows, schema):
    return order.with_previous(spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], f"row_id long, {schema}").withColumn("batch_key", F.lit(0)), ["batch_key"], [c.split()[0] for c in schema.split(", ")])


def residual(spark, rule, rows, schema):
    d = rules.residuals(record(spark, rows, schema), [rule])
    return [r.r_0 for r in d.orderBy("row_id").collect()]


P = [1.0, 1.0, 2.0, 2.0, 2.0, 0.0, 1.0, 1.0, 2.0]
FIT = [0.0, 0.0, 2.5, 2.5, 2.5, 1.2, 0.9, 0.0, 2.5]


def test_coupling_applies_only_to_its_states(spark):
    r = residual(spark, rules.coupling("P101", "FIT201", 2.5, off=1, on=2), list(zip(P, FIT)), "P101 double, FIT201 double")
    assert r[5] is None and r[6] == pytest.approx(0.9) and all(abs(r[i]) < 1e-12 for i in (0, 1, 2, 3, 4, 7, 8))


def test_steady_coupling_needs_the_same_state_before(spark):
    r = residual(spark, rules.coupling("P101", "FIT201", 2.5, off=1, on=2, steady=True), list(zip(P, FIT)), "P101 double, FIT201 double")
    assert [i for i, x in enumerate(r) if x is None] == [0, 2, 5, 6, 8]
    assert all(abs(r[i]) < 1e-12 for i in (1, 3, 4, 7))


def test_default_encoding(spark):
    assert residual(spark, rules.coupling("S", "F", 2.0), [(0.0, 0.0), (1.0, 2.0), (1.0, 1.5)], "S double, F double") == [0.0, 0.0, -0.5]


def test_coupling_needs_two_states():
    with pytest.raises(ValueError):
        rules.coupling("S", "F", 1.0, off=1, on=1)


def test_balance_uses_the_rows_own_flows_and_skips_the_first(spark):
    r = residual(spark, rules.balance("L", ["A"], ["B"], area=2.0), [(1.0, 9.0, 9.0), (2.0, 4.0, 2.0), (2.0, 1.0, 3.0)], "L double, A double, B double")
    assert r == [None, 0.0, 1.0]


def test_bound_keeps_null_apart(spark):
    assert residual(spark, rules.bound("X", 0.0, 2.0), [(1.0,), (3.0,), (-1.0,), (None,), (float("nan"),)], "X double") == [0.0, 1.0, 1.0, None, None]


def test_missing_channel_never_applies(spark):
    assert residual(spark, rules.bound("Y", 0.0, 2.0), [(1.0,)], "X double") == [None]


def test_calibration_and_verdict(spark):
    rows = [(float(i % 10),) for i in range(100)]
    d = record(spark, rows, "X double")
    r = rules.calibrate(d, [rules.bound("X", 0.0, 5.0), rules.bound("Y", 0.0, 1.0), rules.bound("X", 0.0, 50.0)])
    assert r[0].eps == pytest.approx(6.0) and r[1].eps == 1e-6 and r[2].eps == 1e-9
    one = [replace(r[0], eps=3.0)]
    v = rules.verdicts(rules.residuals(d, one), ["batch_key"], one).first()
    assert v.violating_fraction == pytest.approx(0.1) and not v.admitted and v.per_rule == {"bound::X": pytest.approx(0.1)}
    assert v.mean_row_score == pytest.approx((1 / 3) / 10)


def test_no_tolerance_means_no_violation(spark):
    rule = rules.bound("X", 0.0, 1.0)
    d = rules.residuals(record(spark, [(9.0,)], "X double"), [rule])
    assert rules.verdicts(d, ["batch_key"], [rule]).first().admitted


def test_summary_reads_a_missing_flag_as_malicious(spark):
    v = spark.createDataFrame([(None, True), (True, False), (False, False), (False, True)], "is_malicious boolean, admitted boolean")
    s = rules.summary(v).first()
    assert (s.malicious_admitted_rate, s.honest_admitted_rate, s.n_honest_rejected) == (0.5, 0.5, 1)
    none = rules.summary(v.filter("is_malicious")).first()
    assert none.honest_admitted_rate is None


def test_alpha_is_monotone(spark):
    v = spark.createDataFrame([(x / 1000,) for x in range(30)], "violating_fraction double")
    n = [r.n_admitted for r in rules.alpha_sweep(v, [0.001, 0.005, 0.02]).orderBy("alpha").collect()]
    assert n == [2, 6, 21]


def test_cost_is_linear():
    r = [rules.bound("X", 0, 1), rules.linear("Y", {"X": 1.0})]
    assert rules.cost(r, 10) == 10 * rules.cost(r, 1)


def test_exact_derivative_of_a_coupling():
    cur, prev, const = fixedpoint.affine(rules.coupling("P", "F", 3.0, off=1, on=2))
    assert cur == {"F": 1.0, "P": -3.0} and prev == {} and const == 3.0


def test_quantise_refuses(spark):
    with pytest.raises(ValueError):
        fixedpoint.quantise([rules.bound("X", 0, 1)], ["X"])
    with pytest.raises(ValueError):
        fixedpoint.quantise([replace(rules.linear("Y", {"X": 1.0}), eps=1.0)], ["Y"])


@pytest.mark.parametrize("name,flow", [("FIT101", True), ("F_PU1", True), ("1_FIT_001_PV", True), ("P1_FT01Z", True), ("LIT101", False), ("2_FIC_101_CO", False), ("2_FQ_101_PV", False), ("P1_FCV01D", False), ("DEMAND", False), ("DPIT301", False)])
def test_flow_names(name, flow):
    assert is_flow(name) is flow


def test_one_shuffle_for_all_looking_back(spark, data):
    """All rules share one window; admission needs no Python."""
    from tidegate.plans import admission
    from tidegate.sources import views

    t = admission.looked_back(views.telemetry(spark, data))
    plan = rules.residuals(t, admission.RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(") <= 4 and "Python" not in plan
