"""JSON documents as tables of paths and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.keep import written

DEEPEST = 64


def flattened(df: DataFrame, key: list[str], column: str, deepest: int = DEEPEST) -> DataFrame:
    """``key``, path ($.a[1].b), value (text): the leaves of each row's JSON; an empty object or array is a leaf.

    The documents are parsed once into variants and taken apart level by level, each level's inner nodes written once. A null document has no leaf; text
    that is no JSON is an error of Spark's parser. ValueError for documents deeper than ``deepest``.
    """
    nodes = df.select(*key, F.lit("$").alias("path"), F.parse_json(column).alias("v")).filter(F.col(column).isNotNull())
    leaves = []
    for _ in range(deepest):
        kind = F.schema_of_variant("v")
        inner = (kind.startswith("OBJECT<") & (F.length(kind) > 8)) | (kind.startswith("ARRAY<") & (F.to_json("v") != "[]"))
        held = written(nodes.select(*key, "path", F.to_json("v").alias("j"), F.coalesce(inner, F.lit(False)).alias("inner"), F.when(~F.coalesce(inner, F.lit(False)), F.col("v").cast("string")).alias("value")))
        leaves.append(held.filter("NOT inner").select(*key, "path", F.coalesce("value", F.when(F.col("j").isin("{}", "[]"), F.col("j"))).alias("value")))
        below = held.filter("inner")
        if below.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
        spark = df.sparkSession
        parts = below.select(*key, F.col("path").alias("above"), F.parse_json("j").alias("whole")).lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        nodes = parts.select(*key, F.concat("above", step).alias("path"), F.col("value").alias("v"))
    raise ValueError(f"a document is deeper than {deepest} levels")
