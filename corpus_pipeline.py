"""Corpus preparation: quality, near-duplicates, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. ``run`` writes each
stage's rows as Parquet under the session's shared folder and reads them back for the next one. They stay there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidegate.llm import decontamination, neardedup, privacy, quality, sentencepieces
from tidegate.llm.common import shared_folder

STAGES = [
    ("quality trees", quality.keep_good),
    ("simhash near-dedup", neardedup.dedup_stage),
    ("benchmark decontamination", decontamination.drop_contaminated),
    ("personal data", privacy.sanitise_stage),
    ("sentencepiece", sentencepieces.encode_stage),
]

#: Trees, trained models and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/pipeline-{uuid.uuid4().hex}-{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
