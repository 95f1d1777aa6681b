"""Batches optimised against a surrogate of the detector, within a box around the recorded rows.

The surrogate is the linear window model of ``federation``, whose derivatives are plain expressions: a window of inputs f and target y has the
error e = y - f w, the gradient of its squared error by the parameters is -2 e f, and both change linearly with the rows. In a step each window gives three
numbers, each row sums what the windows that hold it say, and moves by ``rate`` deviations in that direction. Rows are dealt to blocks once for all steps: a block is one row of arrays
and also holds its neighbours' edge rows, of which each step uses up some, so steps need no shuffle. Steps are synchronous, so the result does not depend
on how rows are dealt. Where a wanted update is given, a pass before each step takes the batch's own update, a row for each batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.arrays import matrix
from tidegate.operators import federation, order
from tidegate.operators.federation import dot
from tidegate.operators.keep import written

STEPS, RATE, RADIUS, ROUNDS = 10, 0.5, 2.5, 20
#: Own rows of a block of arrays.
BLOCK = 8192


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _windows(state: DataFrame, key: list[str], width: int, row: str) -> DataFrame:
    """``state`` with __x, all numbers of the window that starts at a row; rows without a full window are left out."""
    made = order.framed(state, key, {f"__z{i}": lambda w, i=i: F.lead("z", i).over(w) for i in range(1, width)}, 0, width - 1, row)
    ahead = [f"__z{i}" for i in range(1, width)]
    return made.filter(F.col(["z", *ahead][-1]).isNotNull()).withColumn("__x", F.concat("z", *ahead)).drop(*ahead)


def _packed(state: DataFrame, key: list[str], before: int, after: int, row: str, *held: str) -> DataFrame:
    """key, first, own (first own row), last (last own row) and ``held`` (numbers of rows after rows): a row for each block, which also holds its neighbours' edge rows."""
    d = order.in_blocks(state.select(*key, row, *held), before, after, row, BLOCK)
    mine = F.when(F.col("__own"), F.col(row))
    packs = d.groupBy(*key, "__block").agg(F.sort_array(F.collect_list(F.struct(row, *held))).alias("__r"), F.min(mine).alias("own"), F.max(mine).alias("last"))
    return packs.filter("own IS NOT NULL").select(*key, F.col("__r")[0][row].alias("first"), "own", "last", *[F.flatten(F.col("__r")[c]).alias(c) for c in held])


def _schema(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _said(z: np.ndarray, width: int, by: Sequence[float]) -> np.ndarray:
    """What ``by`` gives for the inputs of each window of the rows ``z``, summed in their order."""
    m, channels = len(z) - width + 1, z.shape[1]
    out = np.zeros(m)
    for i, w in enumerate(by[:-1]):
        out += z[i // channels : i // channels + m, i % channels] * w
    return out + by[-1]


def updates(state: DataFrame, key: list[str], channels: int, params: Sequence[float], width: int, row: str = "row_id") -> DataFrame:
    """key, u (the direction in which training on the batch moves the parameters), error (mean squared), n_windows; ``z`` holds a row's numbers."""
    return _updates(_packed(state, key, 0, width - 1, row, "z"), key, channels, params, width)


def _updates(packs: DataFrame, key: list[str], channels: int, params: Sequence[float], width: int) -> DataFrame:
    """``updates`` from blocks that hold ``width`` - 1 rows after their own. A window with an unknown reading counts, but tells nothing."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                first, own, last = (batch.column(c)[i].as_py() for c in ("first", "own", "last"))
                z, known = (x[0, (own - first) * channels :].reshape(-1, channels) for x in matrix(batch.column("z").slice(i, 1)))
                z, known = (x[: last - own + width] for x in (z, known))
                m = max(len(z) - width + 1, 0)
                total, square, count = np.zeros(len(params)), 0.0, 0
                if m:
                    f = np.column_stack([*(z[p : p + m] for p in range(width - 1)), np.ones(m)])
                    e = z[width - 1 :, 0] - _said(z, width, params)
                    good = np.logical_and.reduce([known[p : p + m].all(axis=1) for p in range(width - 1)] + [known[width - 1 :, 0]])
                    total, square, count = 2 * (f[good].T @ e[good]), float(e[good] @ e[good]), int(good.sum())
                out.append((total, square, count, m))
            kept = batch.select(key)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x[0] for x in out], pa.list_(pa.float64())), *[pa.array([x[i] for x in out], t) for i, t in ((1, pa.float64()), (2, pa.int64()), (3, pa.int64()))]], [*key, "total", "square", "known", "n"])

    each = packs.select(*key, "first", "own", "last", "z").mapInArrow(sums, f"{_schema(packs, *key)}, total array<double>, square double, known long, n long")
    known = F.sum("known")
    u = F.array(*[F.try_divide(F.sum(F.col("total")[i]), known) for i in range(len(params))])
    return each.groupBy(*key).agg(u.alias("u"), F.try_divide(F.sum("square"), known).alias("error"), F.sum("n").alias("n_windows")).filter("n_windows > 0")


def cosine(u: Column, wanted: Sequence[float]) -> Column:
    size = math.sqrt(sum(g * g for g in wanted)) + 1e-12
    return dot(u, _numbers(wanted)) / ((F.sqrt(dot(u, u)) + 1e-12) * size)


def _towards(u: Column, wanted: Sequence[float]) -> Column:
    """The derivative of ``cosine`` by ``u``."""
    size, norm, c = math.sqrt(sum(g * g for g in wanted)) + 1e-12, F.sqrt(dot(u, u)) + 1e-12, cosine(u, wanted)
    return F.zip_with(u, _numbers(wanted), lambda x, g: g / (norm * size) - c * x / (norm * norm))


def _moved(packs: DataFrame, key: list[str], free: Sequence[bool], params: Sequence[float], width: int, rates: Sequence[float], radius: float) -> DataFrame:
    """``packs`` after a step for each of ``rates``; each step takes ``width`` - 1 rows off what is right of the edges. With ``v`` the steps go along it."""
    channels, aimed = len(free), "v" in packs.columns
    table = lambda by: np.reshape(by[:-1], (width - 1, channels))

    def step(z: np.ndarray, z0: np.ndarray, rate: float, v: Sequence[float] | None) -> np.ndarray:
        m, slope = len(z) - width + 1, np.zeros(z.shape)
        if m > 0 and (v is not None or not aimed):
            # what a window says of its inputs along the parameters, of its inputs along v, and of its target
            error = z[width - 1 :, 0] - _said(z, width, params)
            target = error if v is None else _said(z, width, v)
            for i, w in enumerate(table(params)):
                slope[i : i + m] -= target[:, None] * w
            for i, w in enumerate(table(v)) if v is not None else ():
                slope[i : i + m] += error[:, None] * w
            slope[width - 1 :, 0] += target
        return np.where(free, np.clip(z + rate * np.sign(slope), z0 - radius, z0 + radius), z)

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                z, z0 = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, channels) for c in ("z", "z0"))
                v = batch.column("v")[i].as_py() if aimed else None
                for rate in rates:
                    z = step(z, z0, rate, v)
                out.append(z.ravel())
            kept = batch.select([*key, "first", "own", "last", "z0"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.list_(pa.float64()))], [*kept.schema.names, "z"])

    return packs.mapInArrow(move, _schema(packs, *key, "first", "own", "last", "z0", "z"))


def _unpacked(packs: DataFrame, key: list[str], channels: int, row: str) -> DataFrame:
    """key, row, z, z0 of the blocks' own rows."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, own, last = (batch.column(c)[i].as_py() for c in ("first", "own", "last"))
                n, at = last - own + 1, (own - first) * channels
                lists = [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * channels, pa.array(batch.column(c)[i].values.to_numpy(zero_copy_only=False)[at : at + n * channels])) for c in ("z", "z0")]
                kept = batch.select(key).take(pa.array(np.full(n, i)))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.arange(own, last + 1)), *lists], [*key, row, "z", "z0"])

    return packs.mapInArrow(rows, f"{_schema(packs, *key)}, `{row}` long, z array<double>, z0 array<double>")


def _stepped(state: DataFrame, key: list[str], free: Sequence[bool], params: Sequence[float], width: int, rates: float | Sequence[float], radius: float, row: str, wanted: Sequence[float] | None) -> DataFrame:
    """``state`` after a step for each of ``rates``. Rows are dealt once, with as many edge rows as all steps look over."""
    rates = [float(r) for r in np.atleast_1d(rates)]
    reach = len(rates) * (width - 1)
    packs = _packed(state, key, reach, reach, row, "z", "z0")
    if wanted is None:
        return _unpacked(_moved(packs, key, free, params, width, rates, radius), key, len(free), row)
    packs = written(packs)
    for rate in rates:
        v = written(_updates(packs, key, len(free), params, width).select(*key, _towards(F.col("u"), wanted).alias("v")))
        packs = written(_moved(packs.join(v, key, "left"), key, free, params, width, [rate], radius))
    return _unpacked(packs, key, len(free), row)


def standard(batch: DataFrame, key: list[str], channels: Sequence[str], row: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(key, row, z, z0) in deviations of the own batch, nulls as its mean; and key, m_<i>, s_<i>, a row for each batch."""
    own = batch.groupBy(*key).agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(channels)], *[(F.stddev_pop(c) + 1e-8).alias(f"s_{i}") for i, c in enumerate(channels)])
    z = F.array(*[F.coalesce((F.col(c).cast("double") - F.col(f"m_{i}")) / F.col(f"s_{i}"), F.lit(0.0)) for i, c in enumerate(channels)])
    return batch.select(*key, row, *channels).join(own, key).select(*key, row, z.alias("z"), z.alias("z0")), own


def surrogate(state: DataFrame, key: list[str], channels: int, width: int, row: str = "row_id", rounds: int = ROUNDS) -> list[float]:
    """Parameters of the window model after ``rounds`` on the batches' own windows; none without a window."""
    w = _windows(state.select(*key, row, "z"), key, width, row).select(*key, F.col("__x").alias("x"))
    held = written(federation.moments(w.withColumnRenamed(key[0], "client_id"), width * channels, channels))
    return [] if held.isEmpty() else federation.run_rounds(held, rounds)


def perturbed(batch: DataFrame, key: list[str], channels: Sequence[str], width: int, protect: Sequence[str] = (), params: Sequence[float] | None = None, wanted: Sequence[float] | None = None, steps: int = STEPS, rate: float = RATE, radius: float = RADIUS, row: str = "row_id") -> DataFrame:
    """``batch`` with its ``channels`` (the first is the one that the model predicts) moved at most ``radius`` of the batch's own deviations; other columns stay.

    With ``wanted``, an update of the parameters, the batch's own update is turned towards it; without, the surrogate's error on the batch
    is raised. ``params`` is the surrogate; without it one is trained on the batches. Steps shrink evenly to a fifth of ``rate``. Rows are numbered from 1 by ``row`` within ``key``,
    none of which is null. ``protect`` names channels that stay; a null stays, and counts as the mean; a batch shorter than a window stays as it is.
    """
    state, own = standard(batch, key, channels, row)
    state = written(state)
    params = params if params is not None else surrogate(state, key, len(channels), width, row)
    free = [c not in protect for c in channels]
    if steps and any(free) and params:
        state = _stepped(state, key, free, params, width, [rate * (1 - 0.8 * i / steps) for i in range(steps)], radius, row, wanted)
    new = state.join(own, key).select(*key, row, *[(F.col("z")[i] * F.col(f"s_{i}") + F.col(f"m_{i}")).alias(f"__new_{i}") for i in range(len(channels))], *[(F.col("z")[i] != F.col("z0")[i]).alias(f"__moved_{i}") for i in range(len(channels))])
    at = {c: i for i, c in enumerate(channels) if free[i]}
    put = {c: F.when(F.col(f"__moved_{i}") & F.col(c).isNotNull(), F.col(f"__new_{i}")).otherwise(F.col(c).cast("double")).alias(c) for c, i in at.items()}
    return batch.join(new, [*key, row]).select(*[put.get(c, F.col(f"`{c}`")) for c in batch.columns])


def wanted_update(windows: DataFrame, params: Sequence[float], width: int, channels: int) -> list[float]:
    """The update that training on ``windows`` (x) makes at ``params``: the step that lowers the error on them. One row comes back."""
    m = federation.moments(windows.select(F.lit(0).alias("one"), "x"), width * channels, channels, "one")
    row = m.select(F.zip_with(F.transform("a", lambda r: dot(r, _numbers(params))), "b", lambda aw, b: 2 * (b - aw)).alias("u")).first()
    return list(row.u) if row else [0.0] * len(params)


