"""Statistics over result cells (seed, defence, mode, f1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.scalar import unit_hash

MIN_DAMAGE, DRAWS = 0.01, 100_000


def by_mode(cells: DataFrame) -> DataFrame:
    """seed, defence and a column for each mode: reference, naive, gated."""
    pick = lambda m: F.max(F.when(F.col("mode") == m, F.col("f1"))).alias(m)
    return cells.groupBy("seed", "defence").agg(pick("reference"), pick("naive"), pick("gated"))


def damages(cells: DataFrame, least: float = MIN_DAMAGE) -> DataFrame:
    """seed, defence, naive and gated damage against the reference, where the naive one reaches ``least``."""
    d = by_mode(cells).select("seed", "defence", (F.col("reference") - F.col("naive")).alias("d_naive"), (F.col("reference") - F.col("gated")).alias("d_gated"))
    return d.filter(F.col("d_naive") >= least)


def removal(cells: DataFrame, least: float = MIN_DAMAGE) -> DataFrame:
    """defence, n, removal: 1 - sum of gated damage / sum of naive damage."""
    return damages(cells, least).groupBy("defence").agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum("d_gated"), F.sum("d_naive"))).alias("removal"))


def rule_mode(cells: DataFrame) -> DataFrame:
    return cells.groupBy("defence", "mode").agg(F.avg("f1").alias("mean"), F.stddev_samp("f1").alias("sd"), F.count("*").alias("n"))


def sign_test(cells: DataFrame) -> DataFrame:
    """defence, better, worse, tied, p: one-sided binomial test that gated beats naive; p null without untied pairs."""
    d = by_mode(cells).filter("naive IS NOT NULL AND gated IS NOT NULL").groupBy("defence").agg(F.count_if(F.col("gated") > F.col("naive")).alias("better"), F.count_if(F.col("gated") < F.col("naive")).alias("worse"), F.count_if(F.col("gated") == F.col("naive")).alias("tied"))
    n = F.col("better") + F.col("worse")
    # ln C(n, i) from sums of logarithms; i from better to n
    ln_fact = lambda m: F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(m, F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))
    term = lambda i: F.exp(ln_fact(n) - ln_fact(i) - ln_fact(n - i) - n * F.ln(F.lit(2.0)))
    p = F.aggregate(F.sequence(F.col("better"), n), F.lit(0.0), lambda a, i: a + term(i))
    return d.withColumn("p", F.when(n > 0, F.least(p, F.lit(1.0))))


def bootstrap(values: DataFrame, key: list[str], value: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """key, low, high: the 2.5 and 97.5 percentiles of means of ``draws`` resamples; null for fewer than two values.

    A group holds one value a seed, a few dozen at most; each draw of it is a row of its own.
    """
    held = values.select(*key, F.col(value).cast("double").alias("__v")).groupBy(*key).agg(F.array_sort(F.collect_list("__v")).alias("__vs"))
    each = held.filter(F.size("__vs") >= 2).withColumn("__draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = lambda acc, i: acc + F.get("__vs", F.floor(unit_hash(F.lit(seed), F.col("__draw"), i) * F.size("__vs")).cast("int"))
    mean = F.aggregate(F.sequence(F.lit(1), F.size("__vs")), F.lit(0.0), drawn) / F.size("__vs")
    ends = each.select(*key, mean.alias("__m")).groupBy(*key).agg(F.percentile("__m", [0.025, 0.975]).alias("__e"))
    return held.select(*key).join(ends, key, "left").select(*key, F.col("__e")[0].alias("low"), F.col("__e")[1].alias("high"))


def wilcoxon_less(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """key, n, w, p: exact one-sided signed-rank test that a is less than b; zero differences are dropped.

    Ranks are doubled, so that ties have whole ones. The chance counts, over all signs, the sums that are as small: one more
    rank r turns the number of ways to each sum s into ways(s) + ways(s - r).
    """
    d = pairs.select(*key, (F.col(a) - F.col(b)).alias("__d"))
    size = Window.partitionBy(*key).orderBy(F.abs("__d"))
    ties = Window.partitionBy(*key, F.abs("__d"))
    ranked = d.filter("__d <> 0").select(*key, "__d", (2 * F.rank().over(size) + F.count("*").over(ties) - 1).cast("int").alias("__r"))
    held = ranked.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.when(F.col("__d") > 0, F.col("__r")).otherwise(0)).alias("__w"), F.sum("__r").alias("__t"), F.collect_list("__r").alias("__rs"))
    shifted = lambda ways, r: F.concat(F.array_repeat(F.lit(0.0), r), F.slice(ways, F.lit(1), F.size(ways) - r))
    first = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), F.col("__t").cast("int")))
    ways = F.aggregate("__rs", first, lambda acc, r: F.zip_with(acc, shifted(acc, r), lambda x, y: x + y))
    small = F.aggregate(F.slice(ways, F.lit(1), (F.col("__w") + 1).cast("int")), F.lit(0.0), lambda acc, x: acc + x)
    found = held.select(*key, "n", (F.col("__w") / 2).alias("w"), (small / F.pow(F.lit(2.0), F.col("n"))).alias("p"))
    every = pairs.select(*key).distinct().join(found, key, "left")
    return every.select(*key, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("p", F.lit(1.0)).alias("p"))


def two_way(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that stand more often on one side than on the other, as often as they do, with ``side`` (a or b). Both have the same columns; nulls are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def tree_diff(a: DataFrame, b: DataFrame, tol: float = 1e-9) -> DataFrame:
    """path, a, b, where two flattened results (path, value as text) differ: missing on a side, or beyond ``tol``."""
    j = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), "path", "full_outer")
    x, y = F.col("a").try_cast("double"), F.col("b").try_cast("double")
    same = F.coalesce(F.abs(x - y) <= tol, F.col("a") == F.col("b"), F.col("a").isNull() & F.col("b").isNull())
    return j.filter(~same)
