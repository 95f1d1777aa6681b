"""Least change that makes a batch admissible: projection onto the rules' tolerances, for batches of any length.

Rules are affine (``fixedpoint.affine``), so what is violated gives linear constraints A d = gap over the batch; the correction of
least norm is A' (A A')^-1 gap. A constraint reads a row and the row before, so A A' is a symmetric block tridiagonal matrix with
a block for each row. It is solved by segments: every ``block``-th row is a separator, a task condenses the rows between two of them to
their effect on the two, and the separators make a system of the same form that is a block-th as long. The solution then goes back down.
No task holds more than a segment; where every batch is one segment there are no separators and its task finishes it. What was
violated once stays a constraint; passes go on until few enough rows violate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators import order
from tidegate.operators.fixedpoint import affine
from tidegate.operators.keep import written
from tidegate.operators.rules import Rule

OUTER, MARGIN, RIDGE = 30, 0.95, 1e-10
#: Rows of a segment, and numbers in the blocks of one (it has fewer rows under many rules).
SEGMENT, NUMBERS = 8192, 1_000_000

STATE = "__key string, __pos long, __row {row}, x array<double>, x0 array<double>, ok array<boolean>, active array<boolean>"
SYSTEM = "__key string, __pos long, d array<double>, e array<double>, b array<double>"
SOLVED = "__key string, __pos long, y array<double>"


@dataclass(frozen=True)
class Constraints:
    """Coefficients of the rules (a row each) on the row and the row before, and those on the channels that may move."""

    cur: np.ndarray
    prev: np.ndarray
    const: np.ndarray
    eps: np.ndarray
    free: np.ndarray


def constraints(channels: Sequence[str], rules: Sequence[Rule], protect: Sequence[str]) -> Constraints:
    parts = [affine(r) for r in rules]
    rows = lambda i: np.array([[p[i].get(c, 0.0) for c in channels] for p in parts])
    return Constraints(rows(0), rows(1), np.array([p[2] for p in parts]), np.array([r.eps for r in rules]), np.array([c not in protect for c in channels], float))


def tridiagonal(d: np.ndarray, e: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y of the block system with d on the diagonal, e[t] right and e[t]' left of it; odd blocks are eliminated, all at a time."""
    if len(d) == 1:
        return np.linalg.solve(d, b)
    m, left, right = d.shape[1], e[0::2], e[1::2]
    n, k = len(left), len(right)
    sides = np.zeros((n, m, 2 * m + b.shape[2]))
    sides[:, :, :m], sides[:k, :, m : 2 * m], sides[:, :, 2 * m :] = left.transpose(0, 2, 1), right, b[1::2]
    s = np.linalg.solve(d[1::2], sides)
    u, v, w = s[:, :, :m], s[:k, :, m : 2 * m], s[:, :, 2 * m :]
    back = right.transpose(0, 2, 1)
    de, be = d[0::2].copy(), b[0::2].copy()
    de[:n] -= left @ u
    be[:n] -= left @ w
    de[1 : k + 1] -= back @ v
    be[1 : k + 1] -= back @ w[:k]
    even = tridiagonal(de, -left[:k] @ v, be)
    odd = w - u @ even[:n]
    odd[:k] -= v @ even[1 : k + 1]
    y = np.empty((len(d), m, b.shape[2]))
    y[0::2], y[1::2] = even, odd
    return y


def _condensed(key: str, seg: int, d: np.ndarray, e: np.ndarray, b: np.ndarray, right: bool) -> pd.DataFrame:
    """What a segment adds to the separator on its left (its own block too) and to the one on its right (that one's block is its own segment's)."""
    m, stop = d.shape[1], len(d) - right
    zero = np.zeros((m, m))
    out = [(seg, d[0], zero, b[0])]
    if stop > 1:
        sides = np.zeros((stop - 1, m, 2 * m + 1))
        sides[0, :, :m], sides[:, :, -1] = e[0].T, b[1:stop]
        if right:
            sides[-1, :, m : 2 * m] = e[-1]
        s = tridiagonal(d[1:stop], e[1 : stop - 1], sides)
        out = [(seg, d[0] - e[0] @ s[0, :, :m], -e[0] @ s[0, :, m : 2 * m] if right else zero, b[0] - e[0] @ s[0, :, -1])]
        if right:
            out.append((seg + 1, -e[-1].T @ s[-1, :, m : 2 * m], zero, -e[-1].T @ s[-1, :, -1]))
    elif right:
        out = [(seg, d[0], e[0], b[0])]
    return pd.DataFrame([(key, p, x.ravel(), y.ravel(), z) for p, x, y, z in out], columns=["__key", "__pos", "d", "e", "b"])


def _filled(d: np.ndarray, e: np.ndarray, b: np.ndarray, y: list) -> np.ndarray:
    """The solution of a segment's rows, of which the first and the last may be given."""
    first, stop = int(y[0] is not None), len(d) - (len(d) > 1 and y[-1] is not None)
    out, sides = np.zeros(b.shape), b[first:stop].copy()
    if first:
        out[0] = y[0]
    if stop < len(d):
        out[-1] = y[-1]
    if first < stop:
        if first:
            sides[0] -= e[0].T @ out[0]
        if stop < len(d):
            sides[-1] -= e[-1] @ out[-1]
        out[first:stop] = tridiagonal(d[first:stop], e[first : stop - 1], sides[:, :, None])[:, :, 0]
    return out


def _dealt(df: DataFrame, block: int, before: bool) -> DataFrame:
    """Rows by ``__seg``: a segment's own, the separator after it and, if ``before``, the row before it."""
    own, place = F.floor(F.col("__pos") / block), F.col("__pos") % block
    to = F.array(own)
    to = F.when((place == 0) & (own > 0), F.concat(to, F.array(own - 1))).otherwise(to)
    if before:
        to = F.when(place == block - 1, F.concat(to, F.array(own + 1))).otherwise(to)
    return df.withColumn("__seg", F.explode(to))


def _system_of(pdf: pd.DataFrame, m: int) -> tuple:
    """Positions and blocks of condensed rows; the two parts of a separator are added."""
    pos, at = np.unique(pdf["__pos"].to_numpy(), return_inverse=True)
    d, e, b = np.zeros((len(pos), m, m)), np.zeros((len(pos), m, m)), np.zeros((len(pos), m))
    np.add.at(d, at, np.stack(pdf["d"]).reshape(-1, m, m))
    np.add.at(e, at, np.stack(pdf["e"]).reshape(-1, m, m))
    np.add.at(b, at, np.stack(pdf["b"]))
    return pos, d, e[:-1], b


def _known(pos: np.ndarray, pdf: pd.DataFrame) -> list:
    found = {p: np.asarray(y) for p, y in zip(pdf["__pos"], pdf["y"], strict=True) if y is not None}
    return [found.get(p) for p in pos]


def _condensed_solution(table: DataFrame, n: int, m: int, block: int) -> DataFrame:
    """SOLVED for a table of SYSTEM whose batches have at most ``n`` positions."""

    def condense(pdf: pd.DataFrame) -> pd.DataFrame:
        seg = int(pdf["__seg"].iloc[0])
        pos, d, e, b = _system_of(pdf, m)
        if pos[0] != seg * block:  # only the separator of a segment that has no rows
            return pd.DataFrame(columns=["__key", "__pos", "d", "e", "b"])
        return _condensed(pdf["__key"].iloc[0], seg, d, e, b, pos[-1] == (seg + 1) * block)

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        seg = int(pdf["__seg"].iloc[0])
        pos, d, e, b = _system_of(pdf, m)
        y = _filled(d, e, b, _known(pos, pdf))
        own = pos < (seg + 1) * block
        return pd.DataFrame({"__key": pdf["__key"].iloc[0], "__pos": pos[own], "y": list(y[own])})

    return _levels(table, n, m, block, False, condense, expand, SOLVED)


def _levels(table: DataFrame, n: int, m: int, block: int, before: bool, condense: Callable, expand: Callable, schema: str) -> DataFrame:
    """``expand`` over the segments of ``table``, given the solution at the separators where a batch has more than one segment."""
    if n > block:
        up = written(_dealt(table, block, before).groupBy("__key", "__seg").applyInPandas(condense, SYSTEM))
        y = written(_condensed_solution(up, math.ceil(n / block), m, block))
        table = table.join(y.select("__key", (F.col("__pos") * block).alias("__pos"), "y"), ["__key", "__pos"], "left")
    else:
        table = table.withColumn("y", F.lit(None).cast("array<double>"))
    return _dealt(table, block, before).groupBy("__key", "__seg").applyInPandas(expand, schema)


def _pass(state: DataFrame, n: int, c: Constraints, block: int, schema: str, target: float) -> DataFrame:
    """STATE after one correction of least norm, or after all of them where every batch is one segment."""
    m, cur, prev = len(c.cur), c.cur * c.free, c.prev * c.free
    same, cross = cur @ cur.T + prev @ prev.T, cur @ prev.T

    def system(pdf: pd.DataFrame) -> tuple:
        own, r, bad = _checked(pdf, c, block)
        active = np.stack(own["active"]).astype(bool) | bad
        a = active.astype(float)
        d = same * a[:, :, None] * a[:, None, :] + np.eye(m) * (RIDGE * a + 1 - a)[:, :, None]
        e = cross * a[:-1, :, None] * a[1:, None, :]
        return own, active, d, e, np.where(active, np.clip(r, -MARGIN * c.eps, MARGIN * c.eps) - r, 0.0)

    def condense(pdf: pd.DataFrame) -> pd.DataFrame:
        seg = int(pdf["__seg"].iloc[0])
        if not (pdf["__pos"] == seg * block).any():
            return pd.DataFrame(columns=["__key", "__pos", "d", "e", "b"])
        own, _, d, e, b = system(pdf)
        return _condensed(own["__key"].iloc[0], seg, d, e, b, own["__pos"].iloc[-1] == (seg + 1) * block)

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        seg = int(pdf["__seg"].iloc[0])
        if not (pdf["__pos"] == seg * block).any():
            return pdf.iloc[:0][["__key", "__pos", "__row", "x", "x0", "ok", "active"]]
        for _ in range(OUTER if n <= block else 1):
            own, _, bad = _checked(pdf, c, block)
            if n <= block and bad.any(axis=1).mean() <= target:
                break
            own, active, d, e, b = system(pdf)
            y = _filled(d, e, b, _known(own["__pos"].to_numpy(), own))
            change = y @ cur
            change[:-1] += y[1:] @ prev
            pdf = own = own.assign(x=list(np.stack(own["x"]).astype(float) + change), active=list(active))
        return own[own["__pos"] < (seg + 1) * block][["__key", "__pos", "__row", "x", "x0", "ok", "active"]]

    return _levels(state, n, m, block, True, condense, expand, schema)


def _checked(pdf: pd.DataFrame, c: Constraints, block: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A segment's rows in order without the one before it, their residuals, and which violate."""
    pdf = pdf.sort_values("__pos")
    x = np.nan_to_num(np.stack(pdf["x"]).astype(float))
    r = x @ c.cur.T + c.const
    r[1:] += x[:-1] @ c.prev.T
    keep = pdf["__pos"].to_numpy() >= pdf["__seg"].iloc[0] * block
    own = pdf[keep]
    return own, r[keep], np.stack(own["ok"]).astype(bool) & (np.abs(r[keep]) > c.eps)


def _shares(state: DataFrame, c: Constraints, block: int) -> DataFrame:
    """__key, rows, bad: the rows of each batch and how many violate."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        seg = int(pdf["__seg"].iloc[0])
        if (pdf["__pos"] < seg * block).all():
            return pd.DataFrame(columns=["__key", "rows", "bad"])
        own, _, bad = _checked(pdf, c, block)
        mine = own["__pos"].to_numpy() < (seg + 1) * block
        return pd.DataFrame({"__key": own["__key"].iloc[:1], "rows": [int(mine.sum())], "bad": [int(bad[mine].any(axis=1).sum())]})

    each = _dealt(state, block, True).groupBy("__key", "__seg").applyInPandas(count, "__key string, rows long, bad long")
    return each.groupBy("__key").agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))


def project(batches: DataFrame, key: list[str], channels: Sequence[str], rules: Sequence[Rule], row: str = "row_id", protect: Sequence[str] = (), target: float = 0.0, block: int | None = None) -> DataFrame:
    """key, row, the channels after projection, and moved: the row's change in deviations of its batch (root mean square).

    Rows are ordered by ``row``, which is unique and not null within ``key``. Where a rule applies is taken from the batch as it comes; the
    first row of a batch and rules without eps bind nothing. ``protect`` names channels that stay. A batch of which at most ``target`` of the rows violate comes
    back as it is; one that still violates after OUTER passes comes back as it stands. A null or NaN stays (null) and no rule that reads it binds; a
    batch without rows has no row.
    """
    names, rules = list(channels), [r for r in rules if r.eps is not None]
    c = constraints(names, rules, protect)
    block = block or int(max(8, min(SEGMENT, NUMBERS // max(1, len(rules)) ** 2)))
    kind = dict(batches.dtypes)
    schema = STATE.format(row=kind[row])
    rows = batches.select(F.to_json(F.struct(*key)).alias("__key"), *key, F.col(row).alias("__row"), *[F.col(n).cast("double").alias(n) for n in names])
    keys = written(rows.groupBy("__key").agg(F.count("*").alias("__n"), *[F.first(k).alias(k) for k in key], *[(F.stddev_pop(F.nanvl(F.col(n), F.lit(None))) + 1e-9).alias(f"s_{i}") for i, n in enumerate(names)]))
    placed = order.cumulative(rows.drop(*key), ["__key"], F.floor(F.col("__row") / order.BLOCK), [F.col("__row")], row="__pos")
    seen = order.with_previous(placed, ["__key"], sorted({x for r in rules for x in r.looks_back()}), row="__pos")
    ok = F.array(*[F.col("has_prev") & r.residual([*seen.columns]).isNotNull() for r in rules]).cast("array<boolean>")
    x = F.array(*[F.nanvl(F.col(n), F.lit(None)) for n in names])
    state = written(seen.select("__key", (F.col("__pos") - 1).alias("__pos"), "__row", x.alias("x"), x.alias("x0"), ok.alias("ok"), F.transform(ok, lambda _: F.lit(False)).alias("active")))
    n, done = keys.agg(F.max("__n")).first()[0], []  # one number
    for _ in range(OUTER if rules and c.free.any() and n else 0):
        if n <= block:
            state = written(_pass(state, n, c, block, schema, target))
            break
        shares = written(_shares(state, c, block))
        left = shares.filter(F.col("bad") > F.col("rows") * target)
        n = left.agg(F.max("rows")).first()[0]  # one number
        if n is None:
            break
        done.append(state.join(left, "__key", "left_anti"))
        state = written(_pass(state.join(left, "__key", "left_semi"), n, c, block, schema, target))
    out = reduce(DataFrame.unionByName, done, state).join(keys, "__key")
    value = lambda i: F.nanvl(F.col("x")[i], F.lit(None))
    square = sum((F.coalesce(F.pow((value(i) - F.col("x0")[i]) / F.col(f"s_{i}"), 2), F.lit(0.0)) for i in range(len(names))), F.lit(0.0))
    return out.select(*key, F.col("__row").alias(row), *[value(i).alias(n) for i, n in enumerate(names)], F.sqrt(square / len(names)).alias("moved"))


def cost(before: DataFrame, after: DataFrame, key: list[str], channels: Sequence[str], row: str = "row_id") -> DataFrame:
    """key, mean_shift, max_shift (|change| in population deviations + 1e-9), moved_rows (share), frobenius."""
    sd = before.groupBy(*key).agg(*[(F.stddev_pop(c) + 1e-9).alias(f"s_{c}") for c in channels])
    j = before.join(after.select(*key, row, *[F.col(c).alias(f"new_{c}") for c in channels]), [*key, row]).join(sd, key)
    gap = {c: F.abs(F.col(f"new_{c}") - F.col(c)) for c in channels}
    shift = F.array(*[gap[c] / F.col(f"s_{c}") for c in channels])
    total = F.aggregate(shift, F.lit(0.0), lambda a, b: a + b) / len(channels)
    square = sum((gap[c] * gap[c] for c in channels), F.lit(0.0))
    j = j.select(*key, total.alias("t"), F.array_max(shift).alias("m"), square.alias("q"))
    return j.groupBy(*key).agg(F.avg("t").alias("mean_shift"), F.max("m").alias("max_shift"), F.avg((F.col("m") > 1e-6).cast("double")).alias("moved_rows"), F.sqrt(F.sum("q")).alias("frobenius"))
