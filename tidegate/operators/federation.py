"""Federated rounds of a window model: one pass over the windows, then rounds over the clients' moments.

The model predicts a window's last reading of the first channel from the readings before it, linearly with a constant. A
client's full-batch gradient of the squared error needs only the mean products of its inputs and target: ``moments`` takes
these in one partially aggregated pass over all its windows, and any number of local steps and rounds then work on
a few numbers a client. Updates leave in long form, which the rules of ``aggregation`` combine and its attacks rewrite.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.arrays import matrix
from tidegate.operators import aggregation
from tidegate.operators.keep import written

RATE, EPOCHS = 0.05, 2


def inputs(width: int, channels: int) -> list[Column]:
    """A window's readings before its last row, and 1; ``x`` holds ``width`` numbers, ``channels`` a row."""
    return [F.col("x")[i].cast("double") for i in range(width - channels)] + [F.lit(1.0)]


def target(width: int, channels: int) -> Column:
    return F.col("x")[width - channels].cast("double")


def moments(windows: DataFrame, width: int, channels: int, *key: str) -> DataFrame:
    """key (client_id, if none is named), n, a (rows of the mean products of inputs), b (of inputs and target).

    A mean is over the windows in which both factors are known. Sums are taken a batch of windows at a time, as a product of matrices, and added up for each key.
    """
    key = list(key) or ["client_id"]
    d, held = width - channels + 1, windows.select(*key, "x")
    upper = np.triu_indices(d + 1)  # inputs, 1 and target

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, known = (np.insert(m[:, :d], d - 1, 1, axis=1) for m in matrix(batch.column("x")))
            codes = batch.select(key).to_pandas().groupby(key, dropna=False, sort=False).ngroup().to_numpy()
            rows = np.argsort(codes, kind="stable")
            parts = np.split(rows, np.flatnonzero(np.diff(codes[rows])) + 1)
            total = [(x[r].T @ x[r])[upper] for r in parts]
            count = [(known[r].T.astype(float) @ known[r])[upper] for r in parts]
            firsts = batch.select(key).take(pa.array([r[0] for r in parts]))
            yield pa.RecordBatch.from_arrays([*firsts.columns, pa.array([len(r) for r in parts]), pa.array(total), pa.array(count)], [*key, "n", "total", "count"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in held.select(*key).schema.fields)
    each = held.mapInArrow(sums, f"{kinds}n long, total array<double>, count array<double>")
    each = each.select(*key, "n", F.posexplode(F.arrays_zip("total", "count")).alias("at", "v"))
    means = each.groupBy(*key, "at").agg(F.sum("n").alias("n"), F.try_divide(F.sum("v.total"), F.sum("v.count")).alias("mean"))
    m = means.groupBy(*key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "mean"))).alias("m"))
    place = {(i, j): F.col("m")[p]["mean"] for p, (i, j) in enumerate(zip(*map(np.ndarray.tolist, upper), strict=True))}
    rows = [F.array(*[place[min(i, j), max(i, j)] for j in range(d)]) for i in range(d)]
    return m.select(*key, "n", F.array(*rows).alias("a"), F.array(*[place[i, d] for i in range(d)]).alias("b"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def stepped(w: Column, rate: float = RATE) -> Column:
    """The parameters ``w`` after one full-batch step on the row's moments (a, b)."""
    step = F.zip_with(F.transform("a", lambda row: dot(row, w)), "b", lambda aw, b: 2 * rate * (b - aw))
    return F.zip_with(w, step, lambda x, s: x + s)


def local_updates(held: DataFrame, params: Sequence[float], epochs: int = EPOCHS, rate: float = RATE, key: str = "client_id") -> DataFrame:
    """key, dim, value: each client's change of the parameters after ``epochs`` full-batch steps on its moments."""
    start = F.array(*[F.lit(float(p)) for p in params])
    d = held.withColumn("w", start)
    for _ in range(epochs):
        d = d.withColumn("w", stepped(F.col("w"), rate))
    return d.select(key, F.posexplode(F.zip_with("w", start, lambda w, s: w - s)).alias("dim", "value"))


def run_rounds(held: DataFrame, rounds: int, rule: str = "fedavg", attack: Callable[[DataFrame], DataFrame] | None = None, epochs: int = EPOCHS, rate: float = RATE, **options) -> list[float]:
    """Global parameters after ``rounds`` from zero; ``attack`` rewrites a round's updates. The moments are written once; one number a parameter comes back a round."""
    held = written(held)
    width = len(held.select("b").first().b)
    params = [0.0] * width
    for _ in range(rounds):
        u = local_updates(held, params, epochs, rate)
        u = attack(u) if attack else u
        for row in aggregation.aggregate(rule, u, **options).collect():
            params[row.dim] += row.value
    return params


def score(windows: DataFrame, params: Sequence[float], keep: list[str], channels: int) -> DataFrame:
    """Columns ``keep`` with score: the squared error of each window's prediction."""
    width = len(params) - 1 + channels
    said = sum((c * float(p) for c, p in zip(inputs(width, channels), params, strict=True)), F.lit(0.0))
    return windows.select(*keep, F.pow(target(width, channels) - said, 2).alias("score"))
