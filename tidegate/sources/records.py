"""Finding, reading, checking and keeping plant records.

A folder is listed by Spark, recursively, as a table of files; which file serves which part of a record is a rank over columns of that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.sources import plants

#: Fragments of the names of a record's parts, endings of tables, the labelled plant's usual stride and start.
PARTS = {
    "inline": {"normal": "normal", "attack": "attack"},
    "logged": {"normal": "14days", "attack": "attack", "intervals": "attack_description"},
    "flagged": {"normal": "dataset03", "attack": "dataset04"},
}
TABLES, UNREAD = ("csv", "xlsx"), ("xls",)
STRIDE, SKIP = 5, 21_600


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name (lower case), ending, length, changed of every file below ``folder``; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return listed.select("path", name.alias("name"), F.regexp_extract(name, r"[.]([^.]*)$", 1).alias("ending"), "length", F.col("modificationTime").alias("changed"))


def preference() -> Column:
    """Smaller is better: tables of process data, then CSV, then the highest version (none is lowest), then the name."""
    version = F.try_element_at(F.regexp_extract_all("name", F.lit(r"_v(\d+)"), F.lit(1)), F.lit(1)).cast("int")
    return F.struct((~F.contains("name", F.lit("dataset"))).alias("other"), (F.col("ending") != "csv").alias("sheet"), (-F.coalesce(version, F.lit(-1))).alias("version"), F.col("name").alias("name"))


def parts(listed: DataFrame, kind: str) -> DataFrame:
    """part, path, changed: the best file for each part of a record of ``kind``. Lists of attacks, lock files and hidden files serve none."""
    serving = listed.filter(F.col("ending").isin(*TABLES) & ~F.startswith("name", F.lit("~$")) & ~F.startswith("name", F.lit(".")))
    if kind == "inline":
        serving = serving.filter(~F.contains("name", F.lit("list")))
    wanted = PARTS[kind]
    # the longest fragment that a name holds decides, so that a description of attacks is not taken for the attacks
    part = F.coalesce(*[F.when(F.contains("name", F.lit(f)), F.lit(p)) for p, f in sorted(wanted.items(), key=lambda x: -len(x[1]))])
    best = Window.partitionBy("part").orderBy(preference())
    return serving.withColumn("part", part).filter("part IS NOT NULL").withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("part", "path", "changed")


def find(spark: SparkSession, folder: str, kind: str) -> dict[str, str]:
    """part -> path; FileNotFoundError where a normal and an attack record are both missing."""
    found = {r.part: r.path for r in parts(files(spark, folder), kind).collect()}  # three rows at most
    if not {"normal", "attack"} & set(found):
        raise FileNotFoundError(f"no record of normal or attack data below {folder}")
    return found


def checked(normal: DataFrame, attack: DataFrame, labelled: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both records; ValueError if the normal one holds attack rows or, where ``labelled``, the other holds none."""
    rows = lambda d: d.agg(F.coalesce(F.sum("att_flag"), F.lit(0)).alias("n")).first().n
    if rows(normal):
        raise ValueError("the record of normal operation holds attack rows")
    if labelled and not rows(attack):
        raise ValueError("the record of attacks holds no attack row")
    return normal, attack


def load(spark: SparkSession, folder: str, kind: str, skip: int = SKIP, step: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """(normal, attack) of a record of ``kind``: inline (labels in the rows; the normal part skips its start, then keeps every ``step``-th row), logged
    (labels from an interval sheet) or flagged. ValueError for another kind, and as ``checked`` says; FileNotFoundError where the normal or the attack part is missing."""
    if kind not in PARTS:
        raise ValueError(f"unknown kind of record {kind!r}; known: {', '.join(PARTS)}")
    at = find(spark, folder, kind)
    missing = {"normal", "attack"} - set(at)
    if missing:
        old = [r.name for r in files(spark, folder).filter(F.col("ending").isin(*UNREAD)).select("name").collect()]  # names in a record's folder
        more = f"; files of the binary sheet format are not read, save them as .xlsx: {', '.join(sorted(old))}" if old else ""
        raise FileNotFoundError(f"no {' and no '.join(sorted(missing))} part below {folder}; found: {', '.join(f'{p} in {f}' for p, f in sorted(at.items()))}{more}")
    if kind == "inline":
        return checked(plants.read_inline(spark, at["normal"], skip, step), plants.read_inline(spark, at["attack"], 0, step))
    if kind == "flagged":
        return checked(plants.read_flagged(spark, at["normal"]), plants.read_flagged(spark, at["attack"]))
    intervals = plants.interval_rows(plants.read_sheet(spark, at["intervals"])) if "intervals" in at else None
    return checked(plants.read_logged(spark, at["normal"]), plants.read_logged(spark, at["attack"], intervals), intervals is not None)


def kept(spark: SparkSession, folder: str, kind: str, store: str, skip: int = SKIP, step: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """As ``load``, from Parquet below ``store``, where it is written once for each state of the files, kind, skip and stride."""
    names = parts(files(spark, folder), kind).select(F.concat_ws("|", "part", "path", F.col("changed").cast("string")).alias("x"))
    state = names.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("x"))), 256).alias("h")).first().h[:24]
    out = [f"{store}/{kind}-{state}-{skip}-{step}-{part}" for part in ("normal", "attack")]
    try:
        return tuple(spark.read.parquet(p) for p in out)
    except Exception as e:  # not written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    for d, p in zip(load(spark, folder, kind, skip, step), out, strict=True):
        d.write.mode("overwrite").parquet(p)
    return tuple(spark.read.parquet(p) for p in out)
