"""Intermediate tables that are written once, in the folder that the session's driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``; a folder of its own for a session on one machine without it, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read from there, so that what made it runs once. A path that is given is overwritten."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Ledger:
    """Parts of a long job, each written whole and then entered in a log; a part without an entry counts as not done.

    An entry is one file that Spark commits by a rename, so that a job killed anywhere leaves either the part with its entry or a part that is written again.
    """

    SCHEMA = "part string, config string"

    def __init__(self, spark: SparkSession, folder: str, config: str):
        self.spark, self.folder, self.config = spark, folder, config

    def _path(self, part: str) -> str:
        return f"{self.folder}/{self.config}/{part}"

    def done(self) -> set[str]:
        """The parts that are entered under this configuration."""
        try:
            log = self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/log")
            return {r.part for r in log.filter(log.config == self.config).select("part").distinct().collect()}  # a row a part
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return set()

    def write(self, part: str, df: DataFrame) -> DataFrame:
        """``df`` as the part: written, then entered, then read back."""
        kept = written(df, self._path(part))
        self.spark.createDataFrame([(part, self.config)], self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return kept

    def read(self, part: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(part))
