"""A grid of federations, (seed, mode, defence) each, trained round by round as one relation and resumed from the last whole round.

``moments`` holds a row for each seed, mode and client: the mean products of its windows (``federation.moments``), which are all that local steps need. A round
joins them with the cells' parameters, lets every aggregation rule work on the cells that use it, keyed by seed and mode, and writes the new parameters, the clients'
summed updates and what was accepted as one part of a ledger. A job that is killed starts again after the last part that is entered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.arrays import matrix
from tidegate.functions.scalar import ratio
from tidegate.operators import aggregation, federation
from tidegate.operators.keep import Ledger
from tidegate.operators.order import exact_quantile

BY = ["seed", "mode"]
CELL = ["seed", "mode", "defence"]
MODES = ("clean", "honest_only", "fabricated", "projected", "gated")
#: kind: params (client_id null), history (a client's updates so far), accepted (value 1 or 0, dim null), norm (of an update, dim null)
STATE = "kind string, seed int, mode string, defence string, client_id long, is_malicious boolean, dim int, value double"


def wanted(seeds: Sequence[int], modes: Sequence[str], defences: Sequence[str], spark) -> DataFrame:
    """A row for each cell. ValueError for an unknown mode or rule."""
    unknown = [*(set(modes) - set(MODES)), *(set(defences) - set(aggregation.DEFENCES))]
    if unknown:
        raise ValueError(f"unknown modes or rules: {sorted(unknown)}")
    return spark.createDataFrame([(s, m, d) for s in seeds for m in modes for d in defences], "seed int, mode string, defence string")


def _updates(moments: DataFrame, params: DataFrame, epochs: int, rate: float) -> DataFrame:
    """CELL, client_id, is_malicious, n, dim, value: every client's change in every cell."""
    d = moments.join(params.select(*CELL, "w"), BY).withColumn("w0", F.col("w"))
    for _ in range(epochs):
        d = d.withColumn("w", federation.stepped(F.col("w"), rate))
    return d.select(*CELL, "client_id", "is_malicious", "n", F.posexplode(F.zip_with("w", "w0", lambda w, s: w - s)).alias("dim", "value"))


def _as_state(df: DataFrame, kind: str, **more: Column) -> DataFrame:
    names = [x.split()[0] for x in STATE.split(", ")]
    held = {"kind": F.lit(kind), "client_id": F.lit(None).cast("long"), "is_malicious": F.lit(None).cast("boolean"), "dim": F.lit(None).cast("int")} | more
    return df.select(*[(held[c] if c in held else F.col(c)).alias(c) for c in names])


def train(moments: DataFrame, server: DataFrame, cells: DataFrame, rounds: int, ledger: Ledger, epochs: int = federation.EPOCHS, rate: float = federation.RATE) -> DataFrame:
    """CELL, w: the parameters of every cell after ``rounds`` rounds from zero.

    ``moments``: seed, mode, client_id, is_malicious, n, a, b; ``server``: seed, n, a, b of the clean rows that the server holds. Rounds that the ledger has are
    not run again. Parameters, clients and cells are few; rows of a round are their product.
    """
    spark = moments.sparkSession
    width = len(server.select("b").first().b)
    zero = F.array(*[F.lit(0.0)] * width)
    done, state = ledger.done(), None
    first = 0
    while f"round-{first:05d}" in done:
        first += 1
    if first:
        state = ledger.read(f"round-{min(first, rounds) - 1:05d}", STATE)
    used = sorted(r.defence for r in cells.select("defence").distinct().collect())  # the rules' names
    bad = moments.groupBy(*BY).agg(F.greatest(F.count_if("is_malicious"), F.lit(1)).alias("f"))
    for t in range(first, rounds):
        params = cells.withColumn("w", zero) if state is None else vectors(state)
        each = _updates(moments, params, epochs, rate)
        sums = each if state is None else each.unionByName(state.filter("kind = 'history'").select(*CELL, "client_id", "is_malicious", F.lit(0).cast("long").alias("n"), "dim", "value"))
        history = sums.groupBy(*CELL, "client_id", "is_malicious", "dim").agg(F.sum("value").alias("value"))
        own = _updates(server.join(cells.select(*BY).distinct(), "seed").withColumns({"client_id": F.lit(-1).cast("long"), "is_malicious": F.lit(False)}), params, epochs, rate)
        now = ledger.write(f"updates-{t:05d}", _as_state(each, "update", client_id=F.col("client_id"), is_malicious=F.col("is_malicious"), dim=F.col("dim")).unionByName(_as_state(history, "history", client_id=F.col("client_id"), is_malicious=F.col("is_malicious"), dim=F.col("dim"))).unionByName(_as_state(own, "server", client_id=F.col("client_id"), is_malicious=F.col("is_malicious"), dim=F.col("dim"))))
        parts = [now.filter("kind = 'history'")]
        weights = moments.select(*BY, "client_id", F.col("n").alias("weight"))
        for name in used:
            mine = now.filter(F.col("defence") == name)
            u, h, s = (mine.filter(F.col("kind") == k).select(*BY, "client_id", "is_malicious", "dim", "value") for k in ("update", "history", "server"))
            options = {"by": BY, "weights": weights, "server": s.select(*BY, "dim", "value"), "h": h, "f": bad}
            flags = u.select(*BY, "client_id", "is_malicious").distinct()
            delta, taken = aggregation.aggregate(name, u, **options), aggregation.acceptance(name, u, **options)
            before = params.filter(F.col("defence") == name).select(*BY, F.posexplode("w").alias("dim", "was"))
            after = before.join(delta, [*BY, "dim"], "left").select(*BY, "dim", (F.col("was") + F.coalesce("value", F.lit(0.0))).alias("value"))
            own_ = {"defence": F.lit(name)}
            parts.append(_as_state(after, "params", dim=F.col("dim"), **own_))
            parts.append(_as_state(taken.join(flags, [*BY, "client_id"]).withColumn("value", F.col("accepted").cast("double")), "accepted", client_id=F.col("client_id"), is_malicious=F.col("is_malicious"), **own_))
            parts.append(_as_state(aggregation.norms(u, BY).join(flags, [*BY, "client_id"]).withColumnRenamed("norm", "value"), "norm", client_id=F.col("client_id"), is_malicious=F.col("is_malicious"), **own_))
        state = ledger.write(f"round-{t:05d}", reduce(DataFrame.unionByName, parts).coalesce(1))
    return cells.withColumn("w", zero) if state is None else vectors(state)


def vectors(state: DataFrame) -> DataFrame:
    """CELL, w: a state's parameters as one array a cell."""
    held = state.filter("kind = 'params'").groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("p"))
    return held.select(*CELL, F.transform("p", lambda x: x["value"]).alias("w"))


def history(ledger: Ledger, rounds: int) -> DataFrame:
    """CELL, round, malicious_accepted, honest_accepted (shares of clients), norm_mean, norm_malicious, from the ledger's parts."""
    parts = [ledger.read(f"round-{t:05d}", STATE).filter("kind IN ('accepted', 'norm')").withColumn("round", F.lit(t)) for t in range(rounds)]
    d = reduce(DataFrame.unionByName, parts)
    of = lambda kind, who=None: F.avg(F.when((F.col("kind") == kind) & (F.lit(True) if who is None else F.col("is_malicious") == who), F.col("value")))
    return d.groupBy(*CELL, "round").agg(F.coalesce(of("accepted", True), F.lit(0.0)).alias("malicious_accepted"), of("accepted", False).alias("honest_accepted"), of("norm").alias("norm_mean"), F.coalesce(of("norm", True), F.lit(0.0)).alias("norm_malicious"))


def evaluated(windows: DataFrame, params: DataFrame, channels: int, quantile: float) -> DataFrame:
    """CELL, threshold, precision, recall, f1, targeted_recall, untargeted_recall.

    ``windows``: seed, set (clean_val, test), x, label, targeted. Each window is scored under all cells of its seed, whose parameters and thresholds are few and go
    with the task; the threshold is the exact quantile of a cell's clean scores. A task adds up its test windows: a row for each cell leaves it. The sums of a score run
    in the order of the inputs, so equal windows have equal scores. A recall without such windows is null; a window with an unknown reading raises no alarm.
    """
    spark = windows.sparkSession
    held = sorted(tuple(r) for r in params.select(*CELL, "w").collect())  # a row a cell
    cells = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(held)], "cell int, seed int, mode string, defence string")
    of = {s: [i for i, r in enumerate(held) if r[0] == s] for s in {r[0] for r in held}}
    weights = {s: np.array([held[i][3] for i in at]) for s, at in of.items()}

    def scored(batch: pa.RecordBatch) -> Iterator[tuple]:
        """For each seed: cells, rows, scores (cells by rows), and whether the readings of a row are known."""
        seeds = batch.column("seed").to_numpy(zero_copy_only=False)
        for seed in np.unique(seeds) if batch.num_rows else ():
            if seed in of:
                rows = np.flatnonzero(seeds == seed)
                x, known = (m[rows].T.copy() for m in matrix(batch.column("x")))
                w, last = weights[seed], len(x) - channels
                said = np.zeros((len(w), len(rows)))
                for i in range(last):
                    said += w[:, i, None] * x[i]
                yield np.array(of[seed]), rows, np.square(x[last] - (said + w[:, last, None])), known[: last + 1].all(axis=0)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, score, known in scored(batch):
                score = score[:, known]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, score.shape[1]).astype(np.int32)), pa.array(score.ravel())], ["cell", "score"])

    # few values outside of the bracket need no fine sketch: what is inside is counted by value
    scores = windows.filter("set = 'clean_val'").select("seed", "x").mapInArrow(clean, "cell int, score double")
    limits = {r.cell: r.threshold for r in exact_quantile(scores, ["cell"], "score", quantile, "threshold", 1000).collect()}  # a row a cell
    names = ["n", "tp", "fp", "fn", "aimed", "aimed_hit", "other", "other_hit"]

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(held), len(names)), dtype=np.int64)
        limit = np.array([limits.get(i, np.nan) for i in range(len(held))])
        for batch in batches:
            flag = lambda c, v, b=batch: pc.fill_null(pc.equal(b.column(c), v), False).to_numpy(zero_copy_only=False)
            bad, aimed, labelled = flag("label", 1), flag("targeted", True), batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            for at, rows, score, known in scored(batch):
                hit, aim = bad[rows], aimed[rows]
                over = score > limit[at, None]
                over |= np.isnan(score) & ~np.isnan(limit[at, None])  # NaN is the greatest
                alarm, quiet = over & known, ~over & known
                sums = [np.full(len(at), len(rows)), (alarm & hit).sum(axis=1), (alarm & (labelled[rows] & ~hit)).sum(axis=1), (quiet & hit).sum(axis=1)]
                for kind in (hit & aim, hit & ~aim):
                    sums += [np.full(len(at), kind.sum()), (alarm & kind).sum(axis=1)]
                total[at] += np.stack(sums, axis=1)
        seen = np.array([i for i in limits if total[i, 0]], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(seen), *map(pa.array, total[seen].T)], ["cell", *names])

    counts = windows.filter("set = 'test'").select("seed", "x", "label", "targeted").mapInArrow(judged, f"cell int, {', '.join(f'{n} long' for n in names)}")
    counts = counts.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names])
    limit = spark.createDataFrame(list(limits.items()), "cell int, threshold double")
    out = counts.join(F.broadcast(limit), "cell").join(F.broadcast(cells), "cell")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    share = lambda c: F.try_divide(F.col(f"{c}_hit"), F.col(c))
    return out.select(*CELL, "threshold", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), share("aimed").alias("targeted_recall"), share("other").alias("untargeted_recall"))


def summary(cells: DataFrame, least: float = 0.03) -> DataFrame:
    """defence, f1 by mode (means over seeds), damage of the attack with and without projection, the share of it that projecting takes away, whether the rule was damaged
    (``least`` at least) and whether projecting helped the attacker there (damage of 0.01 at least)."""
    m = cells.groupBy("defence").pivot("mode", list(MODES)).agg(F.avg("f1"))
    m = m.withColumns({"damage": F.col("clean") - F.col("fabricated"), "damage_projected": F.col("clean") - F.col("projected")})
    removed = F.when(F.col("damage") > 1e-9, 1 - F.col("damage_projected") / F.col("damage"))
    m = m.withColumn("removed", removed)
    return m.select("defence", *MODES, "damage", "damage_projected", "removed", (F.col("damage") >= least).alias("damaged"), (F.coalesce(F.col("removed") < 0, F.lit(False)) & (F.col("damage") >= 0.01)).alias("helped"))
