"""Window models with layers, trained by synchronous minibatch steps: Spark sums the gradients, an optimiser's state is kept between steps.

Windows are dealt into parts once and written part by part, so that a step reads its own part alone. A step sends every client's parameters out, sums each client's
gradient within tasks and then over tasks (no array of windows ever leaves a task), and applies Adam. Parameters of a few clients are the only numbers on the driver. The
parameters of a model are one flat vector, whose changes leave in long form (client_id, dim, value) for the rules of ``aggregation``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.scalar import unit_hash
from tidegate.operators import aggregation
from tidegate.operators.keep import shared_folder

RATE, BETAS, TINY = 1e-3, (0.9, 0.999), 1e-8
SUMS = "client_id long, n long, loss double, g array<double>"


@dataclass(frozen=True)
class Dense:
    """Layers of the given widths, rectified but for the last; a window's loss is the mean squared error of its reconstruction."""

    widths: tuple[int, ...]

    @property
    def size(self) -> int:
        return sum(a * b + b for a, b in zip(self.widths, self.widths[1:], strict=False))

    def start(self, seed: int) -> np.ndarray:
        """Uniform within one over the root of a layer's inputs."""
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.uniform(-1, 1, a * b + b) / np.sqrt(a) for a, b in zip(self.widths, self.widths[1:], strict=False)])

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.widths, self.widths[1:], strict=False):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def _values(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        held, layers = [x], self.layers(flat)
        for i, (w, b) in enumerate(layers):
            z = held[-1] @ w + b
            held.append(z if i == len(layers) - 1 else np.maximum(z, 0))
        return held

    def score(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        return ((self._values(flat, x)[-1] - x) ** 2).mean(axis=1)

    def gradient(self, flat: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Sums over the windows ``x`` of the loss and of its gradient."""
        held, layers = self._values(flat, x), self.layers(flat)
        back = 2 * (held[-1] - x) / x.shape[1]
        loss, parts = float(((held[-1] - x) ** 2).mean(axis=1).sum()), []
        for i in reversed(range(len(layers))):
            parts.append(np.concatenate([(held[i].T @ back).ravel(), back.sum(axis=0)]))
            if i:
                back = (back @ layers[i][0].T) * (held[i] > 0)
        return loss, np.concatenate(parts[::-1])


#: name -> model of windows of a width
MODELS: dict[str, Callable[[int], Dense]] = {
    "window_ae": lambda width: Dense((width, 128, 24, 128, width)),
    "small_ae": lambda width: Dense((width, 16, 4, 16, width)),
    "linear_ae": lambda width: Dense((width, width)),
}


def build(name: str, width: int) -> Dense:
    """KeyError for an unknown model."""
    if name not in MODELS:
        raise KeyError(f"unknown model {name!r}; known: {', '.join(MODELS)}")
    return MODELS[name](width)


def dealt(windows: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    """``windows`` (client_id, window_id, x) written by ``part``: minibatches that a seeded hash decides. A client without windows in a part keeps its parameters there."""
    part = F.floor(unit_hash(F.lit(seed), F.col("client_id"), F.col("window_id")) * parts).cast("int")
    path = f"{shared_folder(windows.sparkSession)}/windows-{uuid.uuid4().hex}"
    windows.select(F.col("client_id").cast("long").alias("client_id"), "x", part.alias("part")).write.partitionBy("part").parquet(path)
    return windows.sparkSession.read.schema("client_id long, x array<float>, part int").parquet(path)


def _matrix(x: pa.ListArray) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)


def gradients(batch: DataFrame, model: Dense, params: dict[int, np.ndarray]) -> dict[int, tuple[int, float, np.ndarray]]:
    """client_id -> number of windows, mean loss and mean gradient over the rows of ``batch``, a client for which there are parameters at a time."""
    shared = batch.sparkSession.sparkContext.broadcast(params)

    def rows(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*held], pa.int64()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1] for h in held.values()], pa.float64()), pa.array([h[2] for h in held.values()], pa.list_(pa.float64()))], ["client_id", "n", "loss", "g"])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            ids, x = b["client_id"].to_numpy(), None
            for c in np.unique(ids):
                if c not in shared.value:
                    continue
                x = _matrix(b["x"]) if x is None else x
                own = x[ids == c]
                loss, g = model.gradient(shared.value[c], own)
                n, l0, g0 = held.get(c, (0, 0.0, 0.0))
                held[c] = (n + len(own), l0 + loss, g0 + g)
        yield rows(held)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for c, n, loss, g in zip(b["client_id"].to_pylist(), b["n"].to_pylist(), b["loss"].to_pylist(), _matrix(b["g"]) if b.num_rows else [], strict=True):
                n0, l0, g0 = held.get(c, (0, 0.0, 0.0))
                held[c] = (n0 + n, l0 + loss, g0 + g)
        yield rows(held)

    partial = batch.select("client_id", "x").mapInArrow(taken, SUMS)
    found = partial.repartition("client_id").mapInArrow(summed, SUMS).toArrow()  # a row a client
    g = _matrix(found["g"].combine_chunks()) if len(found) else []
    return {c: (n, loss / n, row / n) for c, n, loss, row in zip(found["client_id"].to_pylist(), found["n"].to_pylist(), found["loss"].to_pylist(), g, strict=True)}


class Adam:
    """Moving moments of one client's gradients; a new one for each round."""

    def __init__(self, size: int, rate: float = RATE):
        self.rate, self.t, self.m, self.v = rate, 0, np.zeros(size), np.zeros(size)

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = BETAS[0] * self.m + (1 - BETAS[0]) * g
        self.v = BETAS[1] * self.v + (1 - BETAS[1]) * g * g
        return w - self.rate * (self.m / (1 - BETAS[0] ** self.t)) / (np.sqrt(self.v / (1 - BETAS[1] ** self.t)) + TINY)


def local_train(windows: DataFrame, model: Dense, start: np.ndarray, clients: list[int], epochs: int, parts: int, rate: float = RATE, seed: int = 0) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """Each client's change from ``start`` after ``epochs`` passes over the parts of ``windows`` (as ``dealt``), in a seeded order, and its mean loss over the last pass."""
    params = {c: start.copy() for c in clients}
    adam = {c: Adam(model.size, rate) for c in clients}
    rng, losses = np.random.default_rng(seed), {}
    for _ in range(epochs):
        seen: dict[int, list[tuple[int, float]]] = {}
        for part in rng.permutation(parts).tolist():
            for c, (n, loss, g) in gradients(windows.filter(F.col("part") == part), model, params).items():
                params[c] = adam[c].step(params[c], g)
                seen.setdefault(c, []).append((n, loss))
        losses = {c: sum(n * x for n, x in each) / sum(n for n, _ in each) for c, each in seen.items()}
    return {c: w - start for c, w in params.items()}, losses


def as_updates(spark, changes: dict[int, np.ndarray]) -> DataFrame:
    """client_id, dim, value."""
    ids, size = list(changes), len(next(iter(changes.values())))
    return spark.createDataFrame(pa.table({"client_id": np.repeat(np.array(ids, np.int64), size), "dim": np.tile(np.arange(size, dtype=np.int32), len(ids)), "value": np.concatenate([changes[c] for c in ids])}))


def run_rounds(windows: DataFrame, model: Dense, rounds: int, rule: str = "fedavg", attack: Callable[[DataFrame], DataFrame] | None = None, epochs: int = 1, parts: int = 4, rate: float = RATE, seed: int = 0, **options) -> tuple[np.ndarray, list[dict[int, float]]]:
    """The global parameters after ``rounds`` rounds of all clients of ``windows`` (as ``dealt``), and each round's losses by client. ``attack`` rewrites a round's updates."""
    spark = windows.sparkSession
    flat, history = model.start(seed), []
    clients = sorted(r.client_id for r in windows.select("client_id").distinct().collect())  # the clients' ids
    for t in range(rounds):
        changes, losses = local_train(windows, model, flat, clients, epochs, parts, rate, seed + t)
        u = as_updates(spark, changes)
        u = attack(u) if attack else u
        step = aggregation.aggregate(rule, u, **options).toArrow()  # a number a parameter
        flat = flat.copy()
        flat[step["dim"].to_numpy()] += step["value"].to_numpy()
        history.append(losses)
    return flat, history


def score(windows: DataFrame, model: Dense, flat: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with score: each window's mean squared error of reconstruction."""
    schema = ", ".join(f"`{c}` {t}" for c, t in windows.select(*keep).dtypes)
    shared = windows.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(shared.value, _matrix(b.column(b.num_columns - 1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], [*keep, "score"])

    return windows.select(*keep, "x").mapInArrow(run, f"{schema}, score double")
