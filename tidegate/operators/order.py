"""Row order as data: numbering, neighbours and running sums without one task per record.

A record's order is implicit in a file and must be a column here. No operator ranks a whole record
in one task: rows are dealt by (key, bucket of the order) and the buckets' totals, which are few, give each bucket
its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of a numbered record.
BLOCK = 65_536


def cumulative(df: DataFrame, key: list[str], bucket: Column, order: list[Column], sums: dict[str, Column] | None = None, row: str = "row_id", descending: bool = False) -> DataFrame:
    """``df`` with ``row`` (1, 2, ... by ``order`` within ``key``) and inclusive running sums.

    ``bucket`` must not decrease along the order (not increase, if ``descending``); ties of the order are arbitrary. A
    null bucket comes first (last, if ``descending``), as a null in the order does.
    """
    sums = sums or {}
    d = df.withColumn("__b", bucket)
    totals = d.groupBy(*key, "__b").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*key).orderBy(F.desc("__b") if descending else F.asc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(*[F.col(k).alias(f"__k_{k}") for k in key], F.col("__b").alias("__kb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__s_{o}") for o in sums])
    within = Window.partitionBy(*key, "__b").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"__rn": F.row_number().over(within), **{f"__r_{o}": F.sum(c).over(upto) for o, c in sums.items()}})
    same = F.col("__b").eqNullSafe(F.col("__kb"))
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    d = d.join(start, same)
    return d.select(*df.columns, (F.col("__n0") + F.col("__rn")).cast("long").alias(row), *[(F.col(f"__s_{o}") + F.coalesce(f"__r_{o}", F.lit(0))).alias(o) for o in sums])


def numbered(df: DataFrame, key: list[str], time: str, ties: list[str], unit: str = "day", row: str = "row_id") -> DataFrame:
    """``row`` from 1 within ``key`` by (time, ties); rows of one ``unit`` of time meet in a task."""
    return cumulative(df, key, F.date_trunc(unit, F.col(time)), [F.col(time), *map(F.col, ties)], row=row)


def in_blocks(df: DataFrame, before: int, after: int, row: str = "row_id", block: int = BLOCK) -> DataFrame:
    """Rows with ``__block`` and ``__own``; each block also holds ``before`` rows before and ``after`` rows after it.

    Window functions over (key, __block) that look back and ahead no further are exact for own rows.
    """
    own = F.floor((F.col(row) - 1) / block)
    if max(before, after) > block:  # the frame reaches over several blocks
        first, last = F.greatest(F.floor((F.col(row) - 1 - after) / block), F.lit(0)), F.floor((F.col(row) - 1 + before) / block)
        return df.withColumn("__block", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("__own", F.col("__block") == own)
    place = F.col(row) - own * block  # 1 .. block
    to = F.array(F.struct(own.alias("b"), F.lit(True).alias("o")))
    to = F.when((place > block - before) if before else F.lit(False), F.concat(to, F.array(F.struct((own + 1).alias("b"), F.lit(False).alias("o"))))).otherwise(to)
    back = F.array(F.struct((own - 1).alias("b"), F.lit(False).alias("o")))
    to = F.when((place <= after) & (own > 0) if after else F.lit(False), F.concat(to, back)).otherwise(to)
    return df.withColumn("__to", F.explode(to)).withColumns({"__block": F.col("__to.b"), "__own": F.col("__to.o")}).drop("__to")


def framed(df: DataFrame, key: list[str], columns: dict, before: int = 0, after: int = 0, row: str = "row_id", block: int = BLOCK) -> DataFrame:
    """``df`` with window ``columns``: name -> function of the window ordered by ``row``. One shuffle."""
    w = Window.partitionBy(*key, "__block").orderBy(row)
    d = in_blocks(df, before, after, row, block)
    return d.withColumns({n: f(w) for n, f in columns.items()}).filter("__own").drop("__block", "__own")


def with_previous(df: DataFrame, key: list[str], channels: list[str], row: str = "row_id", block: int = BLOCK) -> DataFrame:
    """``df`` with prev_<channel> and has_prev: the values of the row before within ``key``; null and false on the first."""
    lagged = {f"prev_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in channels}
    return framed(df, key, {**lagged, "has_prev": lambda w: F.lag(F.lit(True), 1, False).over(w)}, before=1, row=row, block=block)


def filled(df: DataFrame, key: list[str], channel: str, out: str, row: str = "row_id", block: int = BLOCK) -> DataFrame:
    """``out``: the last known value of ``channel`` up to the row, else the first known one after it."""
    return all_filled(df.withColumn(out, F.col(channel)), key, [out], row, block)


def all_filled(df: DataFrame, key: list[str], channels: list[str], row: str = "row_id", block: int = BLOCK) -> DataFrame:
    """``df`` with each of ``channels`` filled forward, then backward: one window over blocks for all of them, and one join with the blocks' edges."""
    d = df.withColumn("__block", F.floor((F.col(row) - 1) / block))
    known = lambda c, f: f(F.when(F.col(c).isNotNull(), F.struct(row, c)))[c]
    edges = [x for i, c in enumerate(channels) for x in (known(c, F.max).alias(f"__last_{i}"), known(c, F.min).alias(f"__first_{i}"))]
    over = Window.partitionBy(*key).orderBy("__block")
    before, after = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    carried = d.groupBy(*key, "__block").agg(*edges) if channels else d.select(*key, "__block").distinct()
    carry = [x for i in range(len(channels)) for x in (F.last(f"__last_{i}", ignorenulls=True).over(before).alias(f"__carry_{i}"), F.first(f"__first_{i}", ignorenulls=True).over(after).alias(f"__next_{i}"))]
    carried = carried.select(*key, "__block", *carry)
    w = Window.partitionBy(*key, "__block").orderBy(row)
    back = {f"__back_{i}": F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for i, c in enumerate(channels)}
    ahead = {f"__ahead_{i}": F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) for i, c in enumerate(channels)}
    d = d.withColumns(back | ahead).join(carried, [*key, "__block"])
    put = {c: F.coalesce(f"__back_{i}", f"__carry_{i}", f"__ahead_{i}", f"__next_{i}").alias(c) for i, c in enumerate(channels)}
    return d.select(*[put.get(c, F.col(f"`{c}`")) for c in df.columns])


def exact_quantile(df: DataFrame, key: list[str], value: str, q: float, out: str, accuracy: int = 10_000) -> DataFrame:
    """key, ``out``: the linearly interpolated quantile of the non-null values, exactly.

    An approximate quantile is off by 1 / ``accuracy`` of the ranks at most, so two of them enclose the two order statistics.
    Values under the bracket are only counted; the few inside are counted by value (ties, however many, are one row) and
    ranked in buckets of the bracket. An outlier or a heavy tie makes no large task.
    """
    slack = 3.0 / accuracy
    v = df.select(*key, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL")
    edges = F.percentile_approx("__v", [max(0.0, q - slack), min(1.0, q + slack)], accuracy)
    stats = v.groupBy(*key).agg(edges.alias("__e"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.count("*").alias("__n"))
    # of few values a rank is more than the slack: all are inside
    few = F.col("__n") <= 4 * accuracy
    low_end = F.when(few | F.lit(q <= slack), F.col("__min")).otherwise(F.col("__e")[0])
    high_end = F.when(few | F.lit(q >= 1 - slack), F.col("__max")).otherwise(F.col("__e")[1])
    stats = stats.select(*key, "__n", low_end.alias("__lo"), high_end.alias("__hi"))
    joined = v.join(stats, key) if key else v.crossJoin(F.broadcast(stats))  # one row
    # what lies under the bracket is one row, of no value
    inside = F.col("__v") >= F.col("__lo")
    counts = joined.filter("__v <= __hi").groupBy(*key, "__n", "__lo", "__hi", F.when(inside, F.col("__v")).alias("__w")).agg(F.count("*").alias("__c"))
    width = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300))
    bucket = F.when(F.col("__w").isNull(), -1).otherwise(F.floor((F.col("__w") - F.col("__lo")) / width * 256)).cast("long")
    ranked = cumulative(counts, key, bucket, [F.asc_nulls_first("__w")], {"__upto": F.col("__c")}, row="__rank")
    at = (F.col("__n") - 1) * F.lit(q)
    low, part = F.floor(at), at - F.floor(at)
    a = F.min(F.when(F.col("__upto") >= low + 1, F.col("__w")))
    b = F.min(F.when(F.col("__upto") >= low + 2, F.col("__w")))
    return ranked.groupBy(*key).agg((a + (F.coalesce(b, a) - a) * F.max(part)).alias(out))


def islands(df: DataFrame, key: list[str], flag: str, row: str = "row_id", block: int = BLOCK) -> DataFrame:
    """key, seg_id, start_row, n_rows for each maximal run of rows whose ``flag`` is 1; seg_id from 1 within ``key``."""
    edges = framed(df.select(*key, row, flag), key, {"__b": lambda w: F.coalesce(F.lag(flag).over(w), F.lit(0)), "__a": lambda w: F.coalesce(F.lead(flag).over(w), F.lit(0))}, 1, 1, row, block)
    edges = edges.filter((F.col(flag) == 1) & ((F.col("__b") != 1) | (F.col("__a") != 1)))
    starts = cumulative(edges.filter("__b <> 1").select(*key, F.col(row).alias("start_row")), key, F.floor(F.col("start_row") / block), [F.col("start_row")], row="seg_id")
    ends = cumulative(edges.filter("__a <> 1").select(*key, F.col(row).alias("end_row")), key, F.floor(F.col("end_row") / block), [F.col("end_row")], row="seg_id")
    return starts.join(ends, [*key, "seg_id"]).select(*key, "seg_id", "start_row", (F.col("end_row") - F.col("start_row") + 1).alias("n_rows"))
