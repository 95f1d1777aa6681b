"""Least squares by groups: one pass of covariances, solved in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pivot under this share of its column's variance counts as none: the predictor says nothing new and takes no part.
SINGULAR = 1e-10


def solved(a: list[list[Column]], b: list[Column], scale: list[Column]) -> list[Column]:
    """The solution of a symmetric positive semidefinite system by elimination, as arrays of columns; unknowns with a vanishing pivot are 0."""
    p = len(b)
    a, b = [row[:] for row in a], b[:]
    ok: list[Column] = []
    for i in range(p):
        ok.append(a[i][i] > SINGULAR * scale[i])
        for j in range(i + 1, p):
            f = F.when(ok[i], a[j][i] / a[i][i]).otherwise(0.0)
            a[j] = [a[j][k] - f * a[i][k] if k > i else a[j][k] for k in range(p)]
            b[j] = b[j] - f * b[i]
    x: list[Column] = [F.lit(0.0)] * p
    for i in reversed(range(p)):
        rest = sum((a[i][j] * x[j] for j in range(i + 1, p)), F.lit(0.0))
        x[i] = F.when(ok[i], (b[i] - rest) / a[i][i]).otherwise(0.0)
    return x


def least_squares(df: DataFrame, key: Sequence[str], target: str, predictors: Sequence[str], prefix: str = "") -> DataFrame:
    """key, n, r2, const, coef_<predictor> of ``target`` on ``predictors`` with a constant; names start with ``prefix``.

    Rows with a null or NaN in any of them take no part. Covariances are taken about the means, so that large values do not cancel. A group whose target does not vary has
    r2 of 0. Expressions grow with the cube of the number of predictors: for a dozen, not hundreds.
    """
    names = [target, *predictors]
    d = df.select(*key, *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=names)
    cov = {(i, j): F.covar_pop(names[i], names[j]).alias(f"__c{i}_{j}") for i in range(len(names)) for j in range(i, len(names))}
    m = d.groupBy(*key).agg(F.count("*").alias("__n"), *[F.avg(c).alias(f"__m{i}") for i, c in enumerate(names)], *cov.values())
    c = lambda i, j: F.col(f"__c{min(i, j)}_{max(i, j)}")
    p = range(1, len(names))
    # each elimination's result becomes a column, so that expressions do not double at every step
    x = solved([[c(i, j) for j in p] for i in p], [c(i, 0) for i in p], [c(i, i) for i in p])
    m = m.withColumns({f"__x{i}": v for i, v in zip(p, x, strict=True)})
    told = sum((F.col(f"__x{i}") * c(i, 0) for i in p), F.lit(0.0))
    const = F.col("__m0") - sum((F.col(f"__x{i}") * F.col(f"__m{i}") for i in p), F.lit(0.0))
    r2 = F.when(c(0, 0) > 0, told / c(0, 0)).otherwise(0.0)
    return m.select(*key, F.col("__n").alias(f"{prefix}n"), r2.alias(f"{prefix}r2"), const.alias(f"{prefix}const"), *[F.col(f"__x{i}").alias(f"{prefix}coef_{names[i]}") for i in p])


def paired_couplings(df: DataFrame, pairs: Sequence[tuple[str, str]], cv_max: float = 0.10, least_on: int = 20, still: float = 1e-3) -> DataFrame:
    """status, flow, n_on, nominal, cv, off_top, kept: for each pair of a status and its own flow how the flow stands at the status's greatest value, and at its least.

    A pair is kept if at least ``least_on`` rows are on, their flow varies by at most ``cv_max``, and no flow passes while off. Two passes: the statuses' ends (one row), then the pairs.
    """
    status = sorted({s for s, _ in pairs})
    ends = df.agg(*[f(F.col(s).cast("double")).alias(f"__{n}_{s}") for s in status for n, f in (("lo", F.min), ("hi", F.max))])
    d = df.crossJoin(F.broadcast(ends))
    each = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(f).alias("flow"), F.col(f).cast("double").alias("v"), ((F.col(s) >= F.col(f"__hi_{s}")) & (F.col(f"__hi_{s}") > 0)).alias("on"), (F.col(s) <= F.col(f"__lo_{s}")).alias("off")) for s, f in pairs])
    x = d.select(F.explode(each).alias("x")).select("x.*").filter("v IS NOT NULL")
    on = F.when(F.col("on"), F.col("v"))
    g = x.groupBy("status", "flow").agg(F.count_if("on").alias("n_on"), F.avg(on).alias("nominal"), F.stddev_pop(on).alias("sd"), F.max(F.when(F.col("off"), F.abs("v"))).alias("off_top"))
    cv = F.col("sd") / (F.abs("nominal") + 1e-9)
    kept = (F.col("n_on") >= least_on) & (F.coalesce("off_top", F.lit(0.0)) < still) & (cv <= cv_max)
    return g.select("status", "flow", "n_on", "nominal", cv.alias("cv"), "off_top", F.coalesce(kept, F.lit(False)).alias("kept"))
