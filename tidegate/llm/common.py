"""Small helpers that every text operator shares."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str, lower: bool = False) -> list[bytes]:
    """The words of ``WORD`` in UTF-8; ``lower`` turns A-Z, and only these, to lower case.

    bytes.split() cuts at exactly the characters that WORD leaves out, bytes.lower() changes ASCII alone.
    """
    raw = text.encode("utf-8", "replace")
    return (raw.lower() if lower else raw).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset a session on one machine gets a folder of its own; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's shared checkpoint folder and read it back. Parts survive the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def clean_text(name: str = "text"):
    """The text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the session's shared folder and read from there: smaller than a checkpoint, and read by column."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` (a few numbers a row) marked for broadcast where a count shows that it has few rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """``left`` joined with ``right`` (a row for each key) on ``key``; keys of ``hot`` (key, parts) meet in as many places, dealt by the column ``by``.

    Spark splits a skewed side by itself only where it is plain rows, not the result of an aggregate on the same key.
    """
    few = sized(stored(hot))
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("__parts")))
    few = few.withColumnRenamed("parts", "__parts")
    left = left.join(few, key, "left").withColumn("__part", part.cast("int")).drop("__parts")
    right = right.join(few, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)).cast("int") - 1))).drop("__parts")
    return left.join(right, [key, "__part"]).drop("__part")


#: Rows of an Arrow batch, and texts that a Python worker takes from one at once: what either side holds is bounded by these.
BATCH, BATCH_BYTES, TEXTS = 2048, 8 << 20, 1024


def batched(df: DataFrame) -> DataFrame:
    """``df``, after setting the session's Arrow batches to ``BATCH`` rows and ``BATCH_BYTES`` bytes: Spark's own 10,000 rows and 64 MB are held off the heap by each task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def trimming(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int | None = None):
    """``run`` on batches of at most ``rows``. At a task's end freed memory goes back to the system: Spark reuses Python workers, and what they
    kept would add to the next stage's."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)) if rows else batches
        yield from run(parts)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return inner
