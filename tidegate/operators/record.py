"""Slicing, sharding, rewriting and windowing of a numbered record.

Random choices are seeded hashes of a row's or segment's id, so they are the same on every run and
at every number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.names import is_flow, role_by_name
from tidegate.functions.scalar import unit_hash
from tidegate.operators.order import BLOCK, cumulative, framed

MIN_SHARD_ROWS = 500


def channel_catalog(df: DataFrame, max_levels: int = 6, exclude: Sequence[str] = ()) -> DataFrame:
    """channel, n_levels, role. Role by the name's prefix, else discrete with at most ``max_levels`` values; one pass.

    Distinct (channel, value) pairs are pre-aggregated and counted across tasks; no task holds a channel's values.
    """
    numeric = [f.name for f in df.schema.fields if f.name not in exclude and f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte")]
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in numeric])).alias("x")).select("x.*")
    levels = each.filter("v IS NOT NULL").distinct().groupBy("channel").agg(F.count("*").alias("n_levels"))
    named = F.coalesce(*[F.when(F.col("channel") == c, F.lit(role_by_name(c))) for c in numeric])
    return levels.select("channel", "n_levels", F.coalesce(named, F.when(F.col("n_levels") <= max_levels, "discrete").otherwise("continuous")).alias("role"))


def temporal_shards(df: DataFrame, shards: int, n: Column, row: str = "row_id") -> DataFrame:
    """``client_id`` 0 .. shards-1 by edges floor(n i / shards) on the row number."""
    at = F.col(row) - 1
    guess = F.floor(at * shards / n)
    edge = lambda i: F.floor(i * n / shards)
    return df.withColumn("client_id", F.when(at < edge(guess), guess - 1).when(at >= edge(guess + 1), guess + 1).otherwise(guess).cast("int"))


def even_shards(df: DataFrame, shards: int, n: Column, key: Column, ident: str) -> DataFrame:
    """``client_id`` by a seeded deal: rows in hash order, split evenly, the first n mod shards a row larger."""
    ranked = cumulative(df.withColumn("__h", key), [], F.floor(F.col("__h") * F.ceil(n / BLOCK)), [F.col("__h"), F.col(ident)], row="__r").drop("__h")
    at, big, small = F.col("__r") - 1, F.floor(n / shards) + 1, F.floor(n / shards)
    head = (n % shards) * big
    return ranked.withColumn("client_id", F.when(at < head, F.floor(at / big)).otherwise(n % shards + F.floor((at - head) / F.greatest(small, F.lit(1)))).cast("int")).drop("__r")


def slices(df: DataFrame, n: Column, fractions: dict[str, float], rest: str = "client_pool", row: str = "row_id") -> DataFrame:
    """``slice``: consecutive parts of int(n * fraction) rows each, then ``rest``."""
    out, start = None, F.lit(0).cast("double")
    for name, fraction in fractions.items():
        end = start + F.floor(n * fraction)
        hit = F.col(row) <= end
        out = F.when(hit, name) if out is None else out.when(hit, name)
        start = end
    return df.withColumn("slice", out.otherwise(rest) if out is not None else F.lit(rest))


def stride(df: DataFrame, skip: int, step: int, row: str = "row_id") -> DataFrame:
    """Skip, then every ``step``-th row, numbered anew."""
    at = F.col(row) - 1 - skip
    return df.filter((at >= 0) & (at % step == 0)).withColumn(row, F.floor(at / step) + 1)


def scaler(df: DataFrame, channels: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """One row: m_<c> and s_<c>, mean and population deviation; a deviation under ``floor`` is 1."""
    sd = lambda c: F.when(F.stddev_pop(c) < floor, 1.0).otherwise(F.stddev_pop(c))
    return df.agg(*[F.avg(c).alias(f"m_{c}") for c in channels], *[sd(c).alias(f"s_{c}") for c in channels])


def standardised(df: DataFrame, fitted: DataFrame, channels: Sequence[str]) -> DataFrame:
    """z_<c> = (c - mean) / deviation; ``fitted`` is one row."""
    return df.crossJoin(F.broadcast(fitted)).select(*df.columns, *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(f"z_{c}") for c in channels])


def windows(df: DataFrame, key: list[str], channels: Sequence[str], label: str, width: int, step: int = 1, row: str = "row_id", also: Sequence[str] = ()) -> DataFrame:
    """key, window_id, x (rows after rows, as float), label, and the columns ``also``: each full window of ``width`` rows from every ``step``-th row; the label and these are the greatest of a window's."""
    cells = F.array(*[F.col(c).cast("float") for c in channels])
    ahead = {f"__x{i}": lambda w, i=i: F.lead("__x", i).over(w) for i in range(1, width)}
    greatest = {f"__max{i}": lambda w, c=c: F.max(c).over(w.rowsBetween(0, width - 1)) for i, c in enumerate([label, *also])}
    made = framed(df.withColumn("__x", cells), key, ahead | greatest, 0, width - 1, row)
    xs = ["__x", *ahead]
    made = made.filter(F.col(xs[-1]).isNotNull() & ((F.col(row) - 1) % step == 0))
    return made.select(*key, (F.floor((F.col(row) - 1) / step)).alias("window_id"), F.concat(*xs).alias("x"), F.col("__max0").alias("label"), *[F.col(f"__max{i}").alias(c) for i, c in enumerate(also, 1)])


def touched_windows(df: DataFrame, key: list[str], target: str, width: int, row: str = "row_id") -> DataFrame:
    """key, row_id of a window's first row, touched: 1 if the window holds a target row."""
    made = framed(df, key, {"touched": lambda w: F.max(target).over(w.rowsBetween(0, width - 1)), "__n": lambda w: F.count("*").over(w.rowsBetween(0, width - 1))}, 0, width - 1, row)
    return made.filter(F.col("__n") == width).select(*key, row, "touched")


def densest(df: DataFrame, key: list[str], value: str, width: int, row: str = "row_id") -> DataFrame:
    """key, start_row, total: the full window of the largest sum, the first of equals."""
    made = framed(df, key, {"__s": lambda w: F.sum(value).over(w.rowsBetween(0, width - 1)), "__n": lambda w: F.count("*").over(w.rowsBetween(0, width - 1))}, 0, width - 1, row)
    best = F.max(F.struct(F.col("__s").alias("total"), (-F.col(row)).alias("at")))
    return made.filter(F.col("__n") == width).groupBy(*key).agg(best.alias("b")).select(*key, (-F.col("b.at")).alias("start_row"), F.col("b.total").alias("total"))


def batches(df: DataFrame, key: list[str], starts: DataFrame, rows: int, row: str = "row_id") -> DataFrame:
    """Rows of ``df`` for each batch of ``starts`` (key, batch_id, start), numbered from 1 within the batch.

    A batch meets rows by the cells of ``rows`` rows that it touches, two at most, so ``starts`` is not spread over single rows.
    """
    cell = lambda at: F.floor((at - 1) / rows)
    each = starts.select(*key, "batch_id", "start", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + rows - 1))).alias("__cell"))
    met = df.withColumn("__cell", cell(F.col(row))).join(each, [*key, "__cell"]).filter((F.col(row) >= F.col("start")) & (F.col(row) < F.col("start") + rows))
    return met.withColumn(row, F.col(row) - F.col("start") + 1).drop("start", "__cell")


def overlapping(df: DataFrame, rows: int, step: int, row: str = "row_id") -> DataFrame:
    """``df`` with ``batch_id`` (from 0), once for each batch of ``rows`` rows from every ``step``-th row that holds the row; the last batches of a record are short.

    A row knows its batches by its number, so no table of batches is made or joined.
    """
    at = F.col(row) - 1
    first = F.greatest(F.floor((at - rows) / step) + 1, F.lit(0).cast("bigint"))
    return df.withColumn("batch_id", F.explode(F.sequence(first.cast("int"), F.floor(at / step).cast("int"))))


def roll(df: DataFrame, key: list[str], channels: Sequence[str], shift: int, row: str = "row_id") -> DataFrame:
    """``channels`` circularly shifted by ``shift`` rows within ``key``; the other columns stay."""
    n = df.groupBy(*key).agg(F.count("*").alias("__n"))
    moved = df.join(n, key).select(*key, (F.pmod(F.col(row) - 1 + shift, F.col("__n")) + 1).alias(row), *channels)
    return df.drop(*channels).join(moved, [*key, row]).select(df.columns)


def scale_flows(df: DataFrame, factor: float = 1.3, flows: Sequence[str] | None = None) -> DataFrame:
    flows = [c for c in df.columns if is_flow(c)] if flows is None else flows
    return df.withColumns({c: F.col(c) * factor for c in flows})


def permute_within(df: DataFrame, key: list[str], regime: str, channels: Sequence[str], seed: int, row: str = "row_id") -> DataFrame:
    """Within each (key, regime) one seeded permutation of the ``channels`` jointly; time order and the rest stay."""
    by = [*key, regime]
    placed = cumulative(df, by, F.floor((F.col(row) - 1) / BLOCK), [F.col(row)], row="__at")
    drawn = df.select(*by, row, *channels).withColumn("__h", unit_hash(F.lit(seed), *map(F.col, [*key, row])))
    sizes = df.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("__buckets"))
    drawn = cumulative(drawn.join(sizes, by), by, F.floor(F.col("__h") * F.col("__buckets")), [F.col("__h"), F.col(row)], row="__at").select(*by, "__at", *channels)
    return placed.drop(*channels).join(drawn, [*by, "__at"]).select(df.columns)


def regimes(df: DataFrame, channels: Sequence[str], k: int = 4, seed: int = 0, out: str = "regime") -> DataFrame:
    """``out``: the k-means cluster of the standardised channels (deviation + 1e-9)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in channels], *[F.stddev_pop(c).alias(f"s_{c}") for c in channels]).first()
    z = df.withColumns({f"__z_{c}": F.coalesce((F.col(c) - (s[f"m_{c}"] or 0.0)) / ((s[f"s_{c}"] or 0.0) + 1e-9), F.lit(0.0)) for c in channels})
    v = VectorAssembler(inputCols=[f"__z_{c}" for c in channels], outputCol="__v").transform(z)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol=out, initSteps=4).fit(v).transform(v).drop("__v", *[f"__z_{c}" for c in channels])


def splice_regimes(df: DataFrame, key: list[str], segments: int, seed: int, row: str = "row_id") -> DataFrame:
    """The record cut into ``segments`` even pieces per key, put in a seeded order and numbered anew; unchanged if shorter than twice that."""
    n = df.groupBy(*key).agg(F.count("*").alias("__n"))
    d = df.join(n, key).withColumn("__seg", F.floor((F.col(row) - 1) * segments / F.col("__n")).cast("int"))
    sizes = d.groupBy(*key, "__seg").agg(F.count("*").alias("__c"), F.min(row).alias("__first"))  # at most `segments` a key
    w = Window.partitionBy(*key).orderBy(unit_hash(F.lit(seed), *map(F.col, key), F.col("__seg")), "__seg").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.withColumn("__start", F.coalesce(F.sum("__c").over(w), F.lit(0))).select(*key, "__seg", "__first", "__start")
    new = F.when(F.col("__n") < 2 * segments, F.col(row)).otherwise(F.col("__start") + F.col(row) - F.col("__first") + 1)
    return d.join(moved, [*key, "__seg"]).withColumn(row, new.cast("long")).select(df.columns)


def relabel(df: DataFrame, label: str, fraction: float, seed: int, ident: str) -> DataFrame:
    """A seeded share of the positive labels set to 0."""
    return df.withColumn(label, F.when((F.col(label) == 1) & (unit_hash(F.lit(seed), F.col(ident)) < fraction), 0).otherwise(F.col(label)))


def budgeted(segments: DataFrame, key: list[str], budget: int, seed: int) -> DataFrame:
    """Segments (key, seg_id, start_row, n_rows) in a seeded order until ``budget`` rows a key; the last one is cut short."""
    h = segments.withColumn("__h", unit_hash(F.lit(seed), *map(F.col, [*key, "seg_id"])))
    h = h.join(segments.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("__buckets")), key)
    run = cumulative(h, key, F.floor(F.col("__h") * F.col("__buckets")), [F.col("__h"), F.col("seg_id")], {"__upto": F.col("n_rows")}, row="__r")
    left = budget - (F.col("__upto") - F.col("n_rows"))
    return run.filter(left > 0).withColumn("n_rows", F.least("n_rows", left)).drop("__h", "__upto", "__r", "__buckets")


def splice(df: DataFrame, key: list[str], pieces: DataFrame, source: DataFrame, channels: Sequence[str], row: str = "row_id") -> DataFrame:
    """Rows overwritten by stretches of ``source``, with ``spliced``; where pieces (key, seq, at, from_row, n_rows) overlap the later wins."""
    each = pieces.select(*key, "seq", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n_rows") - 1)).alias("i", "d"), "at", "from_row")
    each = each.select(*key, "seq", (F.col("at") + F.col("i")).alias(row), (F.col("from_row") + F.col("i")).alias("__src"))
    last = each.groupBy(*key, row).agg(F.max_by("__src", "seq").alias("__src"))
    new = last.join(source.select(*key, F.col(row).alias("__src"), *[F.col(c).alias(f"__{c}") for c in channels]), [*key, "__src"]).drop("__src").withColumn("__hit", F.lit(True))
    joined = df.join(new, [*key, row], "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in channels else c for c in df.columns], F.coalesce("__hit", F.lit(False)).alias("spliced"))


def interval_labels(df: DataFrame, intervals: DataFrame, row: str = "row_id", cell: int = 1024) -> DataFrame:
    """``label``: 1 in an interval [start, stop) of ``intervals``. Intervals meet rows by cells of the row axis, an equi-join."""
    cells = intervals.filter("stop > start").withColumn("__c", F.explode(F.sequence(F.floor((F.col("start") - 1) / cell), F.floor((F.col("stop") - 2) / cell))))
    hit = df.select(row, F.floor((F.col(row) - 1) / cell).alias("__c")).join(cells, "__c").filter((F.col(row) >= F.col("start")) & (F.col(row) < F.col("stop"))).select(row).distinct()
    return df.join(hit.withColumn("label", F.lit(1)), row, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def exposed(windows: DataFrame, key: list[str], label: str, strength: float, seed: int, ident: str = "window_id") -> DataFrame:
    """key, pos, ident: a training selection with replacement, as long as the client's windows.

    The first int(n strength) positions draw from windows whose ``label`` is 1, the rest from the others; a client without
    labelled windows draws from the others alone (and the reverse). The same selection can be applied to another version of the batch.
    """
    hot = (F.col(label) == 1).cast("int")
    ranked = cumulative(windows.select(*key, ident, hot.alias("__hot")), [*key, "__hot"], F.floor(F.col(ident) / BLOCK), [F.col(ident)], row="__i")
    sizes = ranked.groupBy(*key).agg(F.count("*").alias("__n"), F.sum("__hot").alias("__h"))
    pos = cumulative(windows.select(*key, ident), key, F.floor(F.col(ident) / BLOCK), [F.col(ident)], row="pos").select(*key, "pos").join(sizes, key)
    cold = F.col("__n") - F.col("__h")
    want = F.when(F.col("__h") == 0, 0).when(cold == 0, 1).otherwise((F.col("pos") <= F.floor(F.col("__n") * strength)).cast("int"))
    size = F.when(want == 1, F.col("__h")).otherwise(cold)
    drawn = pos.select(*key, "pos", want.alias("__hot"), (F.floor(unit_hash(F.lit(seed), *map(F.col, [*key, "pos"])) * size) + 1).cast("long").alias("__i"))
    return drawn.join(ranked, [*key, "__hot", "__i"]).select(*key, "pos", ident)


def optimised(df: DataFrame, **options) -> DataFrame:
    """Rows moved within a box so that a surrogate of the detector errs, or learns what is wanted: ``matching.perturbed``."""
    from tidegate.operators import matching

    return matching.perturbed(df, **options)


#: name -> (operator, what it preserves)
FABRICATIONS: dict[str, tuple[Callable[..., DataFrame], str]] = {
    "channel_roll": (roll, "each channel's values"),
    "within_regime_permutation": (permute_within, "each channel's values within a regime"),
    "conservation_scaling": (scale_flows, "status channels and levels"),
    "regime_splicing": (splice_regimes, "rows"),
    "optimised": (optimised, "status channels, the box of 2.5 deviations"),
    "splice_only": (lambda df, **_: df, "everything"),
}


def fabricate(df: DataFrame, kind: str, **options) -> DataFrame:
    """KeyError for an unknown kind."""
    return FABRICATIONS[kind][0](df, **options)
