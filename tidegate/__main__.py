"""Command line: ``python -m tidegate`` or ``spark-submit`` with this file; the session's master and settings come from Spark's own configuration.

    query NAME --data DIR [--out DIR]               a registered query, shown or written as Parquet
    grid --data DIR --out DIR [--seeds ...] ...     the grid of federations, resumed from what is finished below --out
    record KIND FOLDER --out DIR                    a plant's record, found, checked and written as Parquet
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tidegate.operators import aggregation, grid
from tidegate.plans import grids, scenarios
from tidegate.plans.catalog import QUERIES
from tidegate.sources import records


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegate", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="job", required=True)
    q = sub.add_parser("query")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("--data", required=True)
    q.add_argument("--out")
    g = sub.add_parser("grid")
    g.add_argument("--data", required=True)
    g.add_argument("--out", required=True)
    g.add_argument("--seeds", nargs="+", type=int, default=[0])
    g.add_argument("--modes", nargs="+", choices=grid.MODES, default=list(grid.MODES))
    g.add_argument("--defences", nargs="+", choices=list(aggregation.DEFENCES), default=list(aggregation.DEFENCES))
    g.add_argument("--rounds", type=int, default=25)
    g.add_argument("--clients", type=int, default=scenarios.SETTINGS.clients)
    g.add_argument("--malicious", type=float, default=scenarios.SETTINGS.malicious)
    g.add_argument("--alpha", type=float, default=scenarios.SETTINGS.alpha)
    r = sub.add_parser("record")
    r.add_argument("kind", choices=sorted(records.PARTS))
    r.add_argument("folder")
    r.add_argument("--out", required=True)
    r.add_argument("--skip", type=int, default=records.SKIP)
    r.add_argument("--step", type=int, default=records.STRIDE)
    return p


def main(words: Sequence[str] | None = None) -> DataFrame:
    """Runs a job and returns its result; what is written replaces what was there, but for the grid's finished parts."""
    a = parser().parse_args(words)
    spark = SparkSession.builder.appName(f"tidegate {a.job}").getOrCreate()
    if a.job == "record":
        normal, attack = records.kept(spark, a.folder, a.kind, a.out, a.skip, a.step)
        return normal.unionByName(attack, allowMissingColumns=True).groupBy("att_flag").count()
    if a.job == "query":
        out = QUERIES[a.name][0](spark, a.data)
        if a.out:
            out.write.mode("overwrite").parquet(a.out)
            return spark.read.parquet(a.out)
        return out
    settings = replace(scenarios.SETTINGS, clients=a.clients, malicious=a.malicious, alpha=a.alpha)
    cells = grids.run(spark, a.data, a.out, a.seeds, a.modes, a.defences, a.rounds, settings)
    cells.write.mode("overwrite").parquet(f"{a.out}/cells")
    return grid.summary(spark.read.parquet(f"{a.out}/cells"))


if __name__ == "__main__":
    main().show(200, truncate=False)
