"""Rules in integers: coefficients, residuals and verdicts at a scale of 2^16, in long arithmetic."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.rules import Rule

SCALE, BIAS, LONG = 1 << 16, 1 << 31, 64
#: Columns of a table of integer rules; coefficients and conditions are JSON.
TABLE = "name string, cur string, prev string, c long, eps long, applies string"


@dataclass(frozen=True)
class FixedRule:
    """r = sum(cur x) + sum(prev x') + c; violates if |r| > eps. All but the names are integers."""

    name: str
    cur: dict[str, int] = field(hash=False)
    prev: dict[str, int] = field(hash=False)
    c: int = 0
    eps: int = 0
    applies: dict | None = field(default=None, hash=False)


def affine(rule: Rule) -> tuple[dict[str, float], dict[str, float], float]:
    """Coefficients of the row, of the row before, and the constant: a rule's exact derivative. A bound is not affine."""
    p = rule.params
    if rule.kind == "coupling":
        slope = p["nominal"] / (p["on"] - p["off"])
        return {p["flow"]: 1.0, p["status"]: -slope}, {}, p["off"] * slope
    if rule.kind == "balance":
        cur = {p["level"]: 1.0}
        for names, sign in ((p["inflow"], -1), (p["outflow"], 1)):
            for c in names:
                cur[c] = cur.get(c, 0.0) + sign * p["dt"] / p["area"]
        return cur, {p["level"]: -1.0}, 0.0
    if rule.kind == "linear":
        cur = {p["target"]: 1.0}
        for c, w in p["terms"].items():
            cur[c] = cur.get(c, 0.0) - w
        return cur, ({p["target"]: -1.0} if p["diff"] else {}), -float(p["const"])
    raise ValueError(f"{rule.name} is not affine")


def range_bits(coefficients: Sequence[int], bits: int = 32) -> int:
    """Bits that hold a residual of these coefficients over ``bits``-bit values, with sign."""
    return (sum(map(abs, coefficients)) << bits).bit_length() + 1


def quantise(rules: Sequence[Rule], channels: Sequence[str], scale: int = SCALE) -> list[FixedRule]:
    """ValueError for a rule without eps, over a channel that is not committed, or whose residual over 32-bit values could leave a long."""
    out = []
    for r in rules:
        if r.eps is None:
            raise ValueError(f"{r.name} has no tolerance")
        if not set(r.channels()) <= set(channels):
            raise ValueError(f"{r.name} reads a channel that is not committed")
        cur, prev, c = affine(r)
        p = r.params
        bits = range_bits([round(scale * v) for v in (*cur.values(), *prev.values())])
        if bits > LONG or abs(round(scale * scale * c)) >> LONG - 2 or abs(round(scale * scale * r.eps)) >> LONG - 2:
            raise ValueError(f"{r.name} can reach {bits} bits, a residual holds {LONG}")
        applies = {"status": p["status"], "off": p["off"], "on": p["on"], "steady": p["steady"]} if r.kind == "coupling" else None
        out.append(FixedRule(r.name, {k: round(scale * v) for k, v in cur.items()}, {k: round(scale * v) for k, v in prev.items()}, round(scale * scale * c), round(scale * scale * r.eps) + scale, applies))
    return out


def as_table(spark: SparkSession, rules: Sequence[FixedRule]) -> DataFrame:
    """``TABLE``: a row for each integer rule, to be exported in any format Spark writes."""
    dump = lambda x: json.dumps(x, sort_keys=True)
    return spark.createDataFrame([(r.name, dump(r.cur), dump(r.prev), r.c, r.eps, None if r.applies is None else dump(r.applies)) for r in rules], TABLE)


def from_table(table: DataFrame) -> list[FixedRule]:
    """The integer rules of a table, by name."""
    rows = table.select(*[x.split()[0] for x in TABLE.split(", ")]).orderBy("name").collect()  # a row a rule
    return [FixedRule(r.name, json.loads(r.cur), json.loads(r.prev), r.c, r.eps, json.loads(r.applies) if r.applies else None) for r in rows]


def quantised_rows(df: DataFrame, channels: Sequence[str], scale: int = SCALE) -> DataFrame:
    """x_<c>: rint(scale c) as long (ties to even)."""
    return df.withColumns({f"x_{c}": F.rint(F.col(c) * scale).cast("long") for c in channels})


def biased(x: Column) -> Column:
    """x + 2^31; an error outside of [-2^31, 2^31)."""
    return F.when((x >= -BIAS) & (x < BIAS), x + BIAS).otherwise(F.raise_error(F.lit("a value is out of range")).cast("long"))


def integer_residual(r: FixedRule) -> Column:
    """0 on the first row; reads x_<c> and prev_x_<c>."""
    terms = [F.lit(v).cast("long") * F.col(f"x_{c}") for c, v in r.cur.items()] + [F.lit(v).cast("long") * F.col(f"prev_x_{c}") for c, v in r.prev.items()]
    return F.when(F.col("has_prev"), reduce(add, terms, F.lit(r.c).cast("long"))).otherwise(F.lit(0).cast("long"))


def integer_applies(r: FixedRule, scale: int = SCALE) -> Column:
    """False on the first row for every rule."""
    if r.applies is None:
        return F.col("has_prev")
    at = lambda p: F.rint(F.col(f"{p}{r.applies['status']}") / scale)
    ok = F.col("has_prev") & at("x_").isin(float(r.applies["off"]), float(r.applies["on"]))
    return ok & (at("prev_x_") == at("x_")) if r.applies["steady"] else ok


def integer_violates(r: FixedRule) -> Column:
    return integer_applies(r) & (F.abs(integer_residual(r)) > r.eps)


def decimal_model(df: DataFrame, rules: Sequence[Rule], scale: int = SCALE) -> list[tuple[Column, Column]]:
    """(applies, violates) of each rule, from the rules as given, in decimals of 38 digits and by exact states: a model apart from ``integer_violates``. Reads x_<c>, prev_x_<c>, has_prev."""
    wide = lambda x: x.cast("decimal(20,0)")
    out = []
    for r in rules:
        cur, prev, c = affine(r)
        weigh = lambda v, x: wide(F.lit(round(scale * v))) * wide(F.col(x))
        terms = [weigh(v, f"x_{n}") for n, v in cur.items()] + [weigh(v, f"prev_x_{n}") for n, v in prev.items()]
        total = reduce(add, terms, F.lit(round(scale * scale * c)).cast("decimal(38,0)"))
        ok = F.col("has_prev")
        if r.kind == "coupling":
            p, at = r.params, F.col(f"x_{r.params['status']}")
            before = F.col(f"prev_x_{p['status']}") if p["steady"] else at
            ok = ok & F.coalesce(coupling_applies(before, at, int(p["off"] * scale), int(p["on"] * scale)), F.lit(False))
        out.append((ok, ok & F.coalesce(F.abs(total) > F.lit(round(scale * scale * r.eps) + scale), F.lit(False))))
    return out


def coupling_applies(before: Column, now: Column, off: int, on: int) -> Column:
    """Off/off or on/on, exactly."""
    return ((before == off) & (now == off)) | ((before == on) & (now == on))


def needed(rules: Sequence[FixedRule]) -> list[str]:
    """Channels whose previous value is read."""
    return sorted({c for r in rules for c in r.prev} | {r.applies["status"] for r in rules if r.applies})


def row_counts(df: DataFrame, rules: Sequence[FixedRule]) -> DataFrame:
    """v: rules violated; u: rules that do not apply."""
    count = lambda f: reduce(add, [f(r).cast("int") for r in rules], F.lit(0))
    return df.withColumns({"v": count(integer_violates), "u": count(lambda r: ~integer_applies(r))})


def verdict(df: DataFrame, key: list[str], alpha: float = 0.01) -> DataFrame:
    """From rows with v: n_rows, violating_fraction, admitted."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows"), F.avg((F.col("v") > 0).cast("double")).alias("violating_fraction")).withColumn("admitted", F.col("violating_fraction") <= alpha)
