"""The grid of federations over the event record: rules, modes and seeds in one call."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.scalar import tidy
from tidegate.operators import aggregation, federation, grid, order, projection, record, rules, scenario
from tidegate.operators.keep import Ledger, shared_folder, written
from tidegate.plans import scenarios
from tidegate.sources.results import config_hash

CHANNELS, WIDTH, ROUNDS, SEEDS, QUANTILE = ["value", "flow"], 10, 2, (0,), 0.995


def projected(sc: scenario.Scenario) -> DataFrame:
    """The malicious clients' batches, brought within the rules' tolerances as wholes; statuses stay."""
    affine = [r for r in sc.rules if r.kind != "bound" and r.eps]
    return projection.project(sc.batches.filter("is_malicious"), ["client_id"], sc.channels, affine, protect=["status"]).drop("moved")


def rejected(sc: scenario.Scenario, moved: DataFrame, alpha: float) -> DataFrame:
    """client_id of the clients whose batch fails the check after the malicious have projected theirs."""
    every = sc.batches.filter("NOT is_malicious").select("client_id", "row_id", *sc.channels).unionByName(moved)
    d = rules.residuals(order.with_previous(every, ["client_id"], rules.looking_back(sc.rules)), sc.rules)
    return rules.verdicts(d, ["client_id"], sc.rules, alpha).filter("NOT admitted").select("client_id")


def moments(sc: scenario.Scenario, alpha: float) -> DataFrame:
    """mode, client_id, is_malicious, n, a, b of every client in each of the five modes; each set of windows is made once."""
    made = lambda batches, drawn: federation.moments(scenario.windows_of(sc, batches, WIDTH, CHANNELS, drawn), WIDTH * len(CHANNELS), len(CHANNELS))
    who = sc.shards.select("client_id", "is_malicious").distinct()
    own = written(made(sc.shards, False).join(F.broadcast(who), "client_id"))
    moved = written(projected(sc))
    bad = F.lit(True).alias("is_malicious")
    attack = written(made(sc.batches.filter("is_malicious"), True).select("*", bad))
    passing = written(made(moved, True).select("*", bad))
    honest = own.filter("NOT is_malicious")
    modes = {
        "clean": own.withColumn("is_malicious", F.lit(False)),
        "honest_only": honest,
        "fabricated": honest.unionByName(attack),
        "projected": honest.unionByName(passing),
        "gated": honest.unionByName(passing).join(rejected(sc, moved, alpha), "client_id", "left_anti"),
    }
    return reduce(DataFrame.unionByName, [d.select(F.lit(m).alias("mode"), F.col("client_id").cast("long").alias("client_id"), "is_malicious", "n", "a", "b") for m, d in modes.items()])


def run(spark: SparkSession, sf_dir: str, folder: str, seeds: Sequence[int] = SEEDS, modes: Sequence[str] = grid.MODES, defences: Sequence[str] = tuple(aggregation.DEFENCES), rounds: int = ROUNDS, settings: scenario.Settings = scenarios.SETTINGS) -> DataFrame:
    """Every cell of the grid: CELL, its detection report, malicious_accepted (mean over rounds), physics_admitted (share of malicious batches that the check
    admits as fabricated). Finished parts below ``folder`` are not made again; a changed setting, seed, mode or rule makes a folder of its own there.
    """
    config = config_hash({"settings": repr(settings) + repr(settings.options), "seeds": list(seeds), "modes": list(modes), "defences": list(defences), "data": sf_dir, "width": WIDTH, "channels": CHANNELS})
    ledger = Ledger(spark, folder, config)
    done = ledger.done()
    names = {"moments": "seed int, mode string, client_id long, is_malicious boolean, n long, a array<array<double>>, b array<double>", "server": "seed int, n long, a array<array<double>>, b array<double>", "windows": "seed int, set string, x array<float>, label int, targeted boolean", "verdicts": "seed int, is_malicious boolean, admitted boolean"}
    if not set(names) <= done:
        parts: dict[str, list[DataFrame]] = {n: [] for n in names}
        for seed in seeds:
            sc = scenarios.built(spark, sf_dir, replace(settings, seed=seed))
            s = F.lit(seed).alias("seed")
            root = sc.slices["root"].withColumn("client_id", F.lit(0))
            parts["moments"].append(moments(sc, settings.alpha).select(s, "*"))
            parts["server"].append(federation.moments(scenario.windows_of(sc, root, WIDTH, CHANNELS), WIDTH * len(CHANNELS), len(CHANNELS)).select(s, "n", "a", "b"))
            parts["windows"].append(scenario.evaluation_windows(sc, WIDTH, CHANNELS).select(s, "set", "x", "label", "targeted"))
            parts["verdicts"].append(sc.verdicts.select(s, "is_malicious", "admitted"))
        for name, each in parts.items():
            ledger.write(name, reduce(DataFrame.unionByName, each))
    held = {n: ledger.read(n, schema) for n, schema in names.items()}
    cells = grid.wanted(seeds, modes, defences, spark)
    params = written(grid.train(held["moments"].filter(F.col("mode").isin(*modes)), held["server"], cells, rounds, ledger))
    report = grid.evaluated(held["windows"], params, len(CHANNELS), QUANTILE)
    taken = grid.history(ledger, rounds).groupBy(*grid.CELL).agg(F.avg("malicious_accepted").alias("malicious_accepted"))
    admitted = held["verdicts"].filter("is_malicious").groupBy("seed").agg(F.avg(F.col("admitted").cast("double")).alias("physics_admitted"))
    return report.join(taken, grid.CELL).join(admitted, "seed", "left")


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven rules in all five modes over one scenario of the whole event record."""
    cells = run(spark, sf_dir, f"{shared_folder(spark)}/grid-{uuid.uuid4().hex}")
    return cells.select(*grid.CELL, *[tidy(F.col(c), 5).alias(c) for c in cells.columns if c not in grid.CELL])


QUERIES = {"grid_cells": (grid_cells, None)}
