"""Robust aggregation of client updates in long form (client_id, dim, value).

Clients are few (tens), dimensions many: everything per dimension is a grouped aggregation dealt by
dim, and tables of clients or of client pairs stay small. Pairwise sums run over dim, not over pairs of rows
of a group: each dimension's few values meet once as an array and give partial sums for each pair. Every rule takes
``by``, columns that tell federations apart, so that the cells of a whole grid are one relation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.scalar import unit_hash

TRIM, KAPPA, TINY = 0.2, 1.0, 1e-12
ACCEPT_COSINE = 0.05


def beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """``left`` with the one row of ``right`` for its ``by`` (one row in all, without any)."""
    return left.join(F.broadcast(right), list(by)) if by else left.crossJoin(F.broadcast(right))


def mean(u: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return u.groupBy(*by, "dim").agg(F.avg("value").alias("value"))


def fedavg(u: DataFrame, weights: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean per dim weighted by ``weights`` (client_id, weight); without them the plain mean."""
    if weights is None:
        return mean(u, by)
    # one row per client
    w = u.join(weights, [*by, "client_id"])
    return w.groupBy(*by, "dim").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))


def norms(u: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return u.groupBy(*by, "client_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def pairs(u: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """a, b, dist2, dot for ordered pairs of different clients."""
    held = u.groupBy(*by, "dim").agg(F.collect_list(F.struct("client_id", "value")).alias("v"))
    each = held.select(*by, F.explode("v").alias("x"), "v").select(*by, "x", F.explode("v").alias("y")).filter("x.client_id <> y.client_id")
    gap = F.col("x.value") - F.col("y.value")
    return each.groupBy(*by, F.col("x.client_id").alias("a"), F.col("y.client_id").alias("b")).agg(F.sum(gap * gap).alias("dist2"), F.sum(F.col("x.value") * F.col("y.value")).alias("dot"))


def krum_scores(u: DataFrame, f: int | DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """client_id, score: the sum of the max(n - f - 2, 1) least squared distances to others; rank 1 is the best. ``f`` may be a table (by, f)."""
    p = pairs(u, by)
    n = p.select(*by, "a").distinct().groupBy(*by).agg(F.count("*").alias("n"))
    near = beside(p.withColumn("r", F.row_number().over(Window.partitionBy(*by, "a").orderBy("dist2", "b"))), n, by)
    near = beside(near, f, by) if isinstance(f, DataFrame) else near.withColumn("f", F.lit(f))
    s = near.filter(F.col("r") <= F.greatest(F.col("n") - F.col("f") - 2, F.lit(1))).groupBy(*by, F.col("a").alias("client_id")).agg(F.sum("dist2").alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("score", "client_id")))  # a row per client


def krum(u: DataFrame, f: int | DataFrame, multi: int = 1, by: Sequence[str] = ()) -> DataFrame:
    best = krum_scores(u, f, by).filter(F.col("rank") <= multi).select(*by, "client_id")
    return mean(u.join(best, [*by, "client_id"]), by)


def coordinate_median(u: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The lower median per dim."""
    return u.groupBy(*by, "dim").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("value"))


def trimmed_mean(u: DataFrame, trim: float = TRIM, by: Sequence[str] = ()) -> DataFrame:
    """Mean per dim without the int(n trim) least and greatest values; the plain mean where that leaves none."""
    w = Window.partitionBy(*by, "dim")
    r = u.withColumns({"r": F.row_number().over(w.orderBy("value", "client_id")), "n": F.count("*").over(w)}).withColumn("k", F.floor(F.col("n") * trim))
    return r.filter((F.col("k") == 0) | (2 * F.col("k") >= F.col("n")) | ((F.col("r") > F.col("k")) & (F.col("r") <= F.col("n") - F.col("k")))).groupBy(*by, "dim").agg(F.avg("value").alias("value"))


def norm_clip(u: DataFrame, clip: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Updates scaled down to ``clip`` (the lower median of the norms, if None), then the plain mean."""
    n = norms(u, by)
    if clip is None:
        scale = beside(n, n.groupBy(*by).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY norm)").alias("clip")), by)
    else:
        scale = n.withColumn("clip", F.lit(float(clip)))
    scale = scale.select(*by, "client_id", F.least(F.lit(1.0), F.col("clip") / (F.col("norm") + TINY)).alias("s"))
    return u.join(scale, [*by, "client_id"]).groupBy(*by, "dim").agg(F.avg(F.col("value") * F.col("s")).alias("value"))


def fltrust_weights(u: DataFrame, server: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """client_id, cosine, trust (cosine clamped at 0), factor that brings an update to the server's norm."""
    s = server.select(*by, "dim", F.col("value").alias("g"))
    d = u.join(s, [*by, "dim"]).groupBy(*by, "client_id").agg(F.sum(F.col("value") * F.col("g")).alias("dot"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"), F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("ng"))
    cosine = F.col("dot") / (F.col("n") * F.col("ng") + TINY)
    return d.select(*by, "client_id", cosine.alias("cosine"), F.greatest(cosine, F.lit(0.0)).alias("trust"), (F.col("ng") / (F.col("n") + TINY)).alias("factor"))


def fltrust(u: DataFrame, server: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """Trust-weighted mean of rescaled updates; zero where nobody is trusted; the plain mean without a server update."""
    if server is None:
        return mean(u, by)
    w = fltrust_weights(u, server, by)
    return u.join(w, [*by, "client_id"]).groupBy(*by, "dim").agg(F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("factor") * F.col("trust")), F.sum("trust")), F.lit(0.0)).alias("value"))


def history(rounds: DataFrame) -> DataFrame:
    """round, client_id, dim, value: sums over the rounds up to and including each."""
    w = Window.partitionBy("client_id", "dim").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return rounds.withColumn("value", F.sum("value").over(w))


def foolsgold_weights(h: DataFrame, kappa: float = KAPPA, by: Sequence[str] = ()) -> DataFrame:
    """client_id, weight (they sum to 1) from the clients' summed updates; one client has weight 1."""
    own = norms(h, by)
    p = pairs(h, by).join(own.withColumnsRenamed({"client_id": "a", "norm": "na"}), [*by, "a"]).join(own.withColumnsRenamed({"client_id": "b", "norm": "nb"}), [*by, "b"])
    cs = p.select(*by, "a", "b", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dot") / (F.col("na") * F.col("nb") + TINY))).alias("cs"))
    v = cs.groupBy(*by, "a").agg(F.max("cs").alias("v"))
    q = cs.join(v, [*by, "a"]).join(v.withColumnsRenamed({"a": "b", "v": "vb"}), [*by, "b"])
    pardoned = F.when((F.col("vb") > F.col("v")) & (F.col("vb") > TINY), F.col("cs") * F.col("v") / F.col("vb")).otherwise(F.col("cs"))
    w = q.groupBy(*by, "a").agg((1 - F.max(pardoned)).alias("w"))
    w = own.select(*by, "client_id").join(w.withColumnRenamed("a", "client_id"), [*by, "client_id"], "left").select(*by, "client_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("w", F.lit(1.0)))).alias("w"))
    every = Window.partitionBy(*by)  # a row per client
    w = w.withColumn("w", F.coalesce(F.try_divide(F.col("w"), F.max("w").over(every)), F.lit(0.0)))
    w = w.withColumn("w", F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.col("w"))))
    logit = kappa * (F.ln(F.col("w") / (1 - F.col("w") + TINY) + TINY) + 0.5)
    w = w.withColumn("w", F.greatest(F.lit(0.0), F.least(F.lit(1.0), logit)))
    total, n = F.sum("w").over(every), F.count("*").over(every)
    return w.select(*by, "client_id", F.when(total > 0, F.col("w") / total).otherwise(1.0 / n).alias("weight"))


def foolsgold(u: DataFrame, h: DataFrame, kappa: float = KAPPA, by: Sequence[str] = ()) -> DataFrame:
    return u.join(foolsgold_weights(h, kappa, by), [*by, "client_id"]).groupBy(*by, "dim").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def acceptance(name: str, u: DataFrame, f: int | DataFrame = 1, multi: int = 1, trim: float = TRIM, server: DataFrame | None = None, h: DataFrame | None = None, by: Sequence[str] = (), **_) -> DataFrame:
    """client_id, accepted under the rule ``name``."""
    every = Window.partitionBy(*by)
    if name == "krum":
        return krum_scores(u, f, by).select(*by, "client_id", (F.col("rank") <= multi).alias("accepted"))
    if name == "trimmed_mean":
        r = norms(u, by).withColumns({"r": F.row_number().over(every.orderBy("norm", "client_id")), "n": F.count("*").over(every)}).withColumn("k", F.floor(F.col("n") * trim))
        return r.select(*by, "client_id", ((F.col("k") == 0) | (2 * F.col("k") >= F.col("n")) | ((F.col("r") > F.col("k")) & (F.col("r") <= F.col("n") - F.col("k")))).alias("accepted"))
    if name == "fltrust" and server is not None:
        return fltrust_weights(u, server, by).select(*by, "client_id", (F.col("cosine") > ACCEPT_COSINE).alias("accepted"))
    if name == "foolsgold":
        return foolsgold_weights(h if h is not None else u, by=by).select(*by, "client_id", (F.col("weight") > 0.5 / F.count("*").over(every)).alias("accepted"))
    return u.select(*by, "client_id").distinct().withColumn("accepted", F.lit(True))


#: rule -> (updates, options) -> (by, dim, value)
DEFENCES: dict[str, Callable[..., DataFrame]] = {
    "fedavg": lambda u, weights=None, by=(), **_: fedavg(u, weights, by),
    "krum": lambda u, f=1, multi=1, by=(), **_: krum(u, f, multi, by),
    "median": lambda u, by=(), **_: coordinate_median(u, by),
    "trimmed_mean": lambda u, trim=TRIM, by=(), **_: trimmed_mean(u, trim, by),
    "norm_clip": lambda u, clip=None, by=(), **_: norm_clip(u, clip, by),
    "fltrust": lambda u, server=None, by=(), **_: fltrust(u, server, by),
    "foolsgold": lambda u, h=None, kappa=KAPPA, by=(), **_: foolsgold(u, u if h is None else h, kappa, by),
}


def aggregate(name: str, u: DataFrame, **options) -> DataFrame:
    """KeyError for an unknown rule; options that a rule does not know are ignored. ``by`` names columns that tell several federations apart."""
    return DEFENCES[name](u, **options)


# Attacks on updates. ``bad`` is a condition on client_id; rows of other clients stay.


def sign_flip(u: DataFrame, bad: Column, scale: float = 1.0) -> DataFrame:
    return u.withColumn("value", F.when(bad, -scale * F.col("value")).otherwise(F.col("value")))


def scaling(u: DataFrame, bad: Column, factor: float = 10.0) -> DataFrame:
    return u.withColumn("value", F.when(bad, factor * F.col("value")).otherwise(F.col("value")))


def _noised(u: DataFrame, bad: Column, size: float, seed: int, keep: float) -> DataFrame:
    sd = u.filter(~bad).agg(F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    # Box and Muller's normal number from two hashes of client and dim: the same at every number of partitions
    u1, u2 = (unit_hash(F.lit(seed), F.col("client_id"), F.col("dim"), F.lit(x)) for x in "ab")
    normal = F.sqrt(-2 * F.ln(1 - u1)) * F.cos(2 * math.pi * u2)
    v = F.when(bad, keep * F.col("value") + size * F.col("sd") * normal).otherwise(F.col("value"))
    return u.crossJoin(F.broadcast(sd)).withColumn("value", v).drop("sd")


def additive_noise(u: DataFrame, bad: Column, sigma: float = 1.0, seed: int = 0) -> DataFrame:
    """Normal noise of ``sigma`` deviations of all honest entries."""
    return _noised(u, bad, sigma, seed, 1.0)


def free_rider(u: DataFrame, bad: Column, jitter: float = 0.01, seed: int = 0) -> DataFrame:
    """Noise alone."""
    return _noised(u, bad, jitter, seed, 0.0)


def alie(u: DataFrame, bad: Column, z: float = 1.5) -> DataFrame:
    """Honest mean less z sample deviations per dim; unchanged with fewer than two honest clients."""
    s = u.groupBy("dim").agg(F.avg(F.when(~bad, F.col("value"))).alias("m"), F.stddev_samp(F.when(~bad, F.col("value"))).alias("sd"), F.count_if(~bad).alias("n"))
    v = F.when(bad & (F.col("n") >= 2), F.col("m") - z * F.col("sd")).otherwise(F.col("value"))
    return u.join(s, "dim").select(*[c if c != "value" else v.alias("value") for c in u.columns])


def min_max(u: DataFrame, bad: Column) -> DataFrame:
    """mu - t mu / |mu| with the greatest t >= 0 whose distance to every honest update stays within the honest diameter.

    For each honest x the squared distance |mu - x - t d|^2 is a quadratic in t, so t is in closed form.
    """
    honest = u.filter(~bad)
    mu = honest.groupBy("dim").agg(F.avg("value").alias("m"))
    wide = pairs(honest).agg(F.max("dist2").alias("d2"))
    size = mu.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    q = honest.join(mu, "dim").crossJoin(F.broadcast(size)).withColumn("g", F.col("m") - F.col("value"))
    q = q.groupBy("client_id").agg(F.sum(F.col("g") * F.col("g")).alias("c"), F.sum(F.col("g") * F.col("m") / (F.col("n") + TINY)).alias("b")).crossJoin(F.broadcast(wide))
    t = q.agg(F.greatest(F.min(F.col("b") + F.sqrt(F.greatest(F.col("b") * F.col("b") + F.col("d2") - F.col("c"), F.lit(0.0)))), F.lit(0.0)).alias("t"))
    put = mu.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(t)).select("dim", (F.col("m") - F.col("t") * F.col("m") / (F.col("n") + TINY)).alias("p"))
    return u.join(put, "dim").select(*[c if c != "value" else F.when(bad & F.col("p").isNotNull(), F.col("p")).otherwise(F.col("value")).alias("value") for c in u.columns])


UPDATE_ATTACKS: dict[str, Callable[..., DataFrame]] = {"sign_flip": sign_flip, "scaling": scaling, "additive_noise": additive_noise, "free_rider": free_rider, "alie": alie, "min_max": min_max}
