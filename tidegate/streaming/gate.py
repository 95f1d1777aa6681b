"""The admission check on a stream: residuals with the previous row in state, and verdicts over windows of time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegate.functions.scalar import no_nan
from tidegate.operators import rules
from tidegate.operators.rules import Rule


def with_previous(stream: DataFrame, channel: str, key: str = "client_id", time: str = "ts", ident: str = "event_id") -> DataFrame:
    """key, time, ident, value, prev: each row with the value of the row before it of the same key, across micro-batches.

    State holds one value and time a key. Within a micro-batch rows go by (time, ident); a row that comes later than one
    already seen follows that one.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([time, ident])
        last = state.get[0] if state.exists else None
        prev = rows[channel].shift(1)
        if last is not None and len(rows):
            prev.iloc[0] = last
        state.update((float(rows[channel].iloc[-1]),))
        yield pd.DataFrame({"key": k[0], "time": rows[time], "ident": rows[ident], "value": rows[channel].astype(float), "prev": prev.astype(float)})

    return stream.groupBy(key).applyInPandasWithState(run, "key long, time timestamp, ident long, value double, prev double", "last double", "append", GroupStateTimeout.NoTimeout)


def in_order(stream: DataFrame, channels: Sequence[str], late: str = "10 minutes", idle: str = "1 hour", key: str = "client_id", time: str = "ts", ident: str = "event_id") -> DataFrame:
    """key, time, ident, row_id, ``channels``, prev_<channel>, has_prev: each key's rows in the order of (time, ident), whatever order they come in.

    A row waits in state until the watermark, ``late`` behind the greatest time seen, has passed it; then it leaves with the values of the row before it, so that every
    residual of ``rules`` applies to the stream as it does to a table. A row that comes after the watermark has passed it is dropped. State holds the waiting rows, the
    last row and its number; a key that stays without rows for ``idle`` of the watermark's time loses its state, and its next row counts as a first one. A null time is dropped.
    """
    names = list(channels)
    kept = ", ".join(f"`{c}` double" for c in names)
    out = f"key long, time timestamp, ident long, row_id long, {kept}, {', '.join(f'`prev_{c}` double' for c in names)}, has_prev boolean"
    span = pd.Timedelta(idle).value // 1_000_000

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, idents, values, last, count = state.get if state.exists else ([], [], [], [], 0)
        new = [f for f in frames if len(f)]
        rows = pd.DataFrame(np.array(values, float).reshape(-1, len(names)), columns=names).assign(**{time: pd.to_datetime(pd.Series(times, dtype="int64"), unit="us"), ident: pd.Series(idents, dtype="int64")})
        rows = pd.concat([*([rows] if times else []), *new]).sort_values([time, ident]) if new or times else rows
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        at = rows[time].astype("datetime64[us]") if len(rows) else pd.Series([], dtype="datetime64[us]")
        ready, wait = rows[at <= mark], rows[at > mark]
        if len(ready):
            x = ready[names].to_numpy(float)
            before = np.vstack([np.array(last, float).reshape(-1, len(names)) if last else np.full((1, len(names)), np.nan), x[:-1]])
            frame = {"key": k[0], "time": ready[time], "ident": ready[ident], "row_id": count + 1 + np.arange(len(ready))} | {c: x[:, i] for i, c in enumerate(names)} | {f"prev_{c}": before[:, i] for i, c in enumerate(names)}
            has = np.ones(len(ready), bool)
            has[0] = bool(last)
            last, count = x[-1].tolist(), count + len(ready)
            yield pd.DataFrame(frame | {"has_prev": has})
        if state.hasTimedOut and not len(wait):
            state.remove()
            return
        waiting = (wait[time].astype("datetime64[us]").astype("int64").tolist(), wait[ident].astype("int64").tolist(), wait[names].to_numpy(float).ravel().tolist())
        state.update((*waiting, last, count))
        # the next waiting row's time, or the end of the idle span
        state.setTimeoutTimestamp(max(mark.value // 1_000_000 + 1, (waiting[0][0] // 1000 + 1) if waiting[0] else mark.value // 1_000_000 + span))

    marked = stream.filter(F.col(time).isNotNull()).select(key, time, ident, *[F.col(c).cast("double").alias(c) for c in names]).withWatermark(time, late)
    held = "times array<long>, idents array<long>, values array<double>, last array<double>, n long"
    return marked.groupBy(key).applyInPandasWithState(run, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def judged(ordered: DataFrame, rule_set: Sequence[Rule]) -> DataFrame:
    """``ordered`` (as ``in_order``) with violates: whether any rule of the set is violated; NaN, which stands for no value there, is none here."""
    values = [c for c, t in ordered.dtypes if t == "double"]
    return rules.residuals(ordered.withColumns({c: no_nan(F.col(c)) for c in values}), rule_set).withColumn("violates", rules.any_violation(rule_set)).drop(*[f"r_{i}" for i in range(len(rule_set))])


def verdicts(flagged: DataFrame, width: str = "1 hour", late: str = "10 minutes", alpha: float = 0.01) -> DataFrame:
    """key, start, n_rows, violating_fraction, admitted over tumbling windows; flagged: key, time, violates. Rows later than ``late`` are dropped."""
    w = flagged.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late).groupBy(F.window("time", width), "key")
    out = w.agg(F.count("*").alias("n_rows"), F.avg(F.col("violates").cast("double")).alias("violating_fraction"))
    return out.select("key", F.col("window.start").alias("start"), "n_rows", "violating_fraction", (F.col("violating_fraction") <= alpha).alias("admitted"))
