"""Detection metrics and distribution overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.scalar import ratio
from tidegate.operators.order import exact_quantile

QUANTILE, BINS = 0.995, 200


def threshold(clean: DataFrame, q: float = QUANTILE) -> DataFrame:
    """One row, ``threshold``: the exact quantile of the clean scores."""
    return exact_quantile(clean, [], "score", q, "threshold")


def _prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def report(scores: DataFrame, limit: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, fpr. An alarm is a score over the threshold; undefined shares are 0."""
    d = scores.crossJoin(F.broadcast(limit)).withColumn("alarm", F.col("score") > F.col("threshold"))
    c = d.agg(*[F.count_if((F.col("label") == y) & (F.col("alarm") if a else ~F.col("alarm"))).alias(n) for n, y, a in (("tp", 1, True), ("fp", 0, True), ("fn", 1, False), ("tn", 0, False))])
    c = c.withColumns(_prf(F.col("tp"), F.col("fp"), F.col("fn")))
    return c.withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def _totals(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.sum("label").alias("pos"), F.count("*").alias("n"))


def f1_best(ranked: DataFrame) -> DataFrame:
    """One row, f1_best and its inclusive threshold; null with a single class. ``ranked`` has rank and tp by descending score."""
    d = ranked.crossJoin(F.broadcast(_totals(ranked)))
    f1 = ratio(2.0 * F.col("tp"), F.col("rank") + F.col("pos"))
    best = d.agg(F.max(F.struct(f1.alias("f1"), (-F.col("rank")).alias("r"), F.col("score").alias("s"))).alias("b"), F.max("pos").alias("pos"), F.max("n").alias("n"))
    two = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return best.select(F.when(two, F.col("b.f1")).alias("f1_best"), F.when(two, F.col("b.s")).alias("threshold"))


def auc_pr(ranked: DataFrame) -> DataFrame:
    """One row, auc_pr: average precision by rank; null with a single class."""
    d = ranked.agg(F.sum(F.col("label") * F.col("tp") / F.col("rank")).alias("s"), F.sum("label").alias("pos"), F.count("*").alias("n"))
    return d.select(F.when((F.col("pos") > 0) & (F.col("pos") < F.col("n")), F.col("s") / F.col("pos")).alias("auc_pr"))


def delays(segments: DataFrame, alarms: DataFrame, key: list[str], row: str = "row_id") -> DataFrame:
    """key, seg_id, delay: rows from a segment's start to its first alarm; null if missed."""
    rows = segments.select(*key, "seg_id", "start_row", F.explode(F.sequence("start_row", F.col("start_row") + F.col("n_rows") - 1)).alias(row))
    hit = rows.join(alarms.select(*key, row), [*key, row]).groupBy(*key, "seg_id").agg(F.min(F.col(row) - F.col("start_row")).alias("delay"))
    return segments.select(*key, "seg_id").join(hit, [*key, "seg_id"], "left")


def overlap(values: DataFrame, bins: int = BINS) -> DataFrame:
    """One row, overlap: the shared mass of two normalised histograms on the pooled range. values: side (a or b), value.

    The last bin holds its right edge; a range of one point overlaps fully.
    """
    span = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.least(F.floor((F.col("value") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    d = values.crossJoin(F.broadcast(span)).filter("value IS NOT NULL").withColumn("bin", F.when(F.col("hi") > F.col("lo"), at).otherwise(0))
    n = d.groupBy("bin").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))  # a row per bin
    whole = n.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return n.crossJoin(F.broadcast(whole)).agg(F.sum(F.least(ratio(F.col("a"), F.col("na")), ratio(F.col("b"), F.col("nb")))).alias("overlap"))


def attack_success(clean: Column, poisoned: Column) -> dict[str, Column]:
    drop = clean - poisoned
    return {"drop": drop, "relative_drop": F.when(clean == 0, 0.0).otherwise(F.try_divide(drop, clean))}
