"""Result cells: an append-only table, keyed by cell and configuration, that a rerun resumes from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["seed", "defence", "mode", "config_hash"]


def config_hash(config: dict) -> str:
    """Of all settings, so that a changed setting makes a new cell."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def append(cells: DataFrame, path: str, config: dict) -> None:
    cells.withColumn("config_hash", F.lit(config_hash(config))).write.mode("append").partitionBy("seed").parquet(path)


def open_cells(spark: SparkSession, wanted: DataFrame, path: str, config: dict) -> DataFrame:
    """The cells of the grid that are not in the table yet."""
    wanted = wanted.withColumn("config_hash", F.lit(config_hash(config)))
    try:
        done = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return wanted
    return wanted.join(done.select(*KEY).distinct(), KEY, "left_anti")
