"""Process rules as column expressions, their calibration and batch verdicts.

A residual is null where its rule does not apply. Rules read a row's channels and, as prev_<channel>
and has_prev, those of the row before; ``order.with_previous`` supplies them.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.scalar import no_nan
from tidegate.operators.order import exact_quantile

ALPHA, QUANTILE, SAFETY = 0.01, 0.999, 1.5
EPS_UNSEEN, EPS_ZERO = 1e-6, 1e-9


@dataclass(frozen=True)
class Rule:
    """kind: coupling, balance, bound or linear; eps: None means that nothing violates it."""

    name: str
    kind: str
    params: dict = field(hash=False)
    eps: float | None = None

    @property
    def degree(self) -> int:
        return 2 if self.kind == "bound" else 1

    def channels(self) -> list[str]:
        p = self.params
        return {"coupling": lambda: [p["status"], p["flow"]], "balance": lambda: [p["level"], *p["inflow"], *p["outflow"]], "bound": lambda: [p["channel"]], "linear": lambda: [p["target"], *p["terms"]]}[self.kind]()

    def looks_back(self) -> list[str]:
        """Channels whose previous value the rule reads."""
        p = self.params
        if self.kind == "coupling":
            return [p["status"]] if p["steady"] else []
        if self.kind == "balance":
            return [p["level"]]
        return [p["target"]] if self.kind == "linear" and p["diff"] else []

    def residual(self, columns: Sequence[str]) -> Column:
        """Null throughout if a channel is not among ``columns``."""
        if not set(self.channels()) <= set(columns):
            return F.lit(None).cast("double")
        p, x = self.params, lambda c: no_nan(F.col(c).cast("double"))
        back = lambda c: no_nan(F.col(f"prev_{c}").cast("double"))
        if self.kind == "coupling":
            s = F.rint(x(p["status"]))
            applies = s.isin(float(p["off"]), float(p["on"]))
            if p["steady"]:
                applies = applies & F.col("has_prev") & (s == F.rint(back(p["status"])))
            return F.when(applies, x(p["flow"]) - (x(p["status"]) - p["off"]) / float(p["on"] - p["off"]) * p["nominal"])
        if self.kind == "balance":
            net = reduce(add, map(x, p["inflow"]), F.lit(0.0)) - reduce(add, map(x, p["outflow"]), F.lit(0.0))
            return F.when(F.col("has_prev"), x(p["level"]) - back(p["level"]) - p["dt"] * net / p["area"])
        if self.kind == "bound":
            v = x(p["channel"])
            return F.when(v.isNotNull(), F.greatest(p["lo"] - v, v - p["hi"], F.lit(0.0)))
        said = reduce(add, [w * x(c) for c, w in p["terms"].items()], F.lit(float(p["const"])))
        if p["diff"]:
            return F.when(F.col("has_prev"), x(p["target"]) - back(p["target"]) - said)
        return x(p["target"]) - said


def coupling(status: str, flow: str, nominal: float, off: float = 0, on: float = 1, steady: bool = False) -> Rule:
    if off == on:
        raise ValueError("off and on must differ")
    return Rule(f"coupling::{status}~{flow}", "coupling", {"status": status, "flow": flow, "nominal": nominal, "off": off, "on": on, "steady": steady})


def balance(level: str, inflow: Sequence[str], outflow: Sequence[str], area: float, dt: float = 1.0) -> Rule:
    return Rule(f"balance::{level}", "balance", {"level": level, "inflow": list(inflow), "outflow": list(outflow), "area": area, "dt": dt})


def bound(channel: str, lo: float, hi: float) -> Rule:
    return Rule(f"bound::{channel}", "bound", {"channel": channel, "lo": lo, "hi": hi})


def linear(target: str, terms: dict[str, float], const: float = 0.0, diff: bool = False) -> Rule:
    return Rule(f"linear::{target}", "linear", {"target": target, "terms": dict(terms), "const": const, "diff": diff})


def looking_back(rules: Sequence[Rule]) -> list[str]:
    return sorted({c for r in rules for c in r.looks_back()})


def residuals(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with r_0, r_1, ... in the order of ``rules``; all of them in one projection."""
    return df.withColumns({f"r_{i}": r.residual(df.columns) for i, r in enumerate(rules)}) if rules else df


def calibrate(df: DataFrame, rules: Sequence[Rule], quantile: float = QUANTILE, safety: float = SAFETY) -> list[Rule]:
    """Rules with eps: safety x the exact quantile of |residual| over applicable rows (one number a rule comes back)."""
    sized = residuals(df, rules)
    long = sized.select(F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.abs(F.col(f"r_{i}")).alias("v")) for i in range(len(rules))])).alias("x")).select("x.*")
    found = {r.rule: r.q for r in exact_quantile(long, ["rule"], "v", quantile, "q").collect()}
    eps = [EPS_UNSEEN if i not in found else found[i] * safety for i in range(len(rules))]
    return [replace(r, eps=e if e > 0 else EPS_ZERO) for r, e in zip(rules, eps, strict=True)]


def violates(i: int, rule: Rule) -> Column:
    if rule.eps is None:
        return F.lit(False)
    return F.coalesce(F.abs(F.col(f"r_{i}")) > rule.eps, F.lit(False))


def excess(i: int, rule: Rule) -> Column:
    """max(|r| / eps - 1, 0); 0 where the rule does not apply."""
    if rule.eps is None:
        return F.lit(0.0)
    return F.coalesce(F.greatest(F.abs(F.col(f"r_{i}")) / rule.eps - 1, F.lit(0.0)), F.lit(0.0))


def row_score(rules: Sequence[Rule]) -> Column:
    return F.array_max(F.array(F.lit(0.0), *[excess(i, r) for i, r in enumerate(rules)]))


def any_violation(rules: Sequence[Rule]) -> Column:
    return reduce(lambda a, b: a | b, [violates(i, r) for i, r in enumerate(rules)], F.lit(False))


def verdicts(df: DataFrame, key: list[str], rules: Sequence[Rule], alpha: float = ALPHA) -> DataFrame:
    """A row per batch: n_rows, violating_fraction, admitted, per_rule, not_applicable, mean_row_score.

    ``df`` holds r_<i>. The denominator is all rows of the batch; a batch without rows has no row here
    (join to the list of batches and read null as 0 and admitted).
    """
    share = lambda c: F.avg(c.cast("double"))
    named = lambda f: F.map_from_arrays(F.array(*[F.lit(r.name) for r in rules]), F.array(*[f(i, r) for i, r in enumerate(rules)]))
    out = df.groupBy(*key).agg(
        F.count("*").alias("n_rows"),
        share(any_violation(rules)).alias("violating_fraction"),
        named(lambda i, r: share(violates(i, r))).alias("per_rule"),
        named(lambda i, r: share(F.col(f"r_{i}").isNull())).alias("not_applicable"),
        F.avg(row_score(rules)).alias("mean_row_score"),
    )
    return out.withColumn("admitted", F.col("violating_fraction") <= alpha)


def summary(verdict: DataFrame, malicious: str = "is_malicious") -> DataFrame:
    """malicious_admitted_rate, honest_admitted_rate (null without such clients), n_honest_rejected. A null flag counts as malicious."""
    bad = F.coalesce(F.col(malicious), F.lit(True))
    taken = F.col("admitted").cast("double")
    return verdict.agg(F.avg(F.when(bad, taken)).alias("malicious_admitted_rate"), F.avg(F.when(~bad, taken)).alias("honest_admitted_rate"), F.count_if(~bad & ~F.col("admitted")).alias("n_honest_rejected"))


def gate(clients: DataFrame, verdict: DataFrame, key: str = "client_id") -> DataFrame:
    """The clients whose batch was admitted; a client without a verdict stays."""
    return clients.join(verdict.filter(~F.col("admitted")).select(key), key, "left_anti")


def alpha_sweep(verdict: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """alpha, n_admitted, n_rejected over stored fractions."""
    each = verdict.select("violating_fraction", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    return each.groupBy("alpha").agg(F.count_if(F.col("violating_fraction") <= F.col("alpha")).alias("n_admitted"), F.count_if(F.col("violating_fraction") > F.col("alpha")).alias("n_rejected"))


def cost(rules: Sequence[Rule], k: int, bits: int = 32) -> int:
    """Multiplications for checking k sampled rows."""
    return k * (sum(max(r.degree, 1) for r in rules) + bits * len(rules))


#: Fixed values of the three-tank plant: areas of the tanks and nominal flows of their pumps.
PLANT_AREAS, PLANT_FLOWS = (12.0, 15.0, 10.0), (2.20, 2.05, 1.95)


def plant_rules(weak_bounds: bool = False, dt: float = 1.0) -> list[Rule]:
    """The balances of the three tanks, the couplings of the three pumps whose flow is their own, and optionally level bounds."""
    out = [balance(f"L_T{i}", [f"F_PU{i}"], [f"F_PU{i + 1}"], PLANT_AREAS[i - 1], dt) for i in (1, 2, 3)]
    out += [coupling(f"S_PU{i}", f"F_PU{i}", PLANT_FLOWS[i - 1]) for i in (1, 2, 3)]
    return out + ([bound(f"L_T{i}", 0.0, 12.0) for i in (1, 2, 3)] if weak_bounds else [])


RULE = "name string, kind string, params string, eps double"


def as_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """name, kind, params (JSON), eps: a row for each rule, to be kept in any format Spark writes."""
    return spark.createDataFrame([(r.name, r.kind, json.dumps(r.params, sort_keys=True), r.eps) for r in rules], RULE)


def from_table(table: DataFrame) -> list[Rule]:
    """The rules of a table, by name. ValueError for a kind that the engine does not know."""
    rows = table.select("name", "kind", "params", "eps").orderBy("name").collect()  # a row a rule
    unknown = {r.kind for r in rows} - {"coupling", "balance", "bound", "linear"}
    if unknown:
        raise ValueError(f"unknown kinds of rules: {sorted(unknown)}")
    return [Rule(r.name, r.kind, json.loads(r.params), r.eps) for r in rows]
