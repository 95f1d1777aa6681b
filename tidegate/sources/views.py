"""Telemetry, client updates, scores and result cells as views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.order import cumulative, numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str, key: bool = True) -> DataFrame:
    """client_id, row_id, event_id, ts, value, k, status (1 off, 2 on, 0 changing), att_flag from events.

    row_id counts within the client, or with ``key`` false over the whole record.
    """
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("client_id"),
        "event_id",
        "ts",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(0).alias("status"),
        (F.col("event_type") == "error").cast("int").alias("att_flag"),
    )
    return numbered(e, ["client_id"] if key else [], "ts", ["event_id"])


SQL_TELEMETRY = """tel AS (SELECT user_id % 10 AS client_id, event_id, ts, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS status, CAST(event_type = 'error' AS INTEGER) AS att_flag,
  row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS row_id, row_number() OVER (ORDER BY ts, event_id) AS record_row FROM events)"""


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, row_id, level, inflow, outflow, valve (0 or 1) from lineitem, by ship date."""
    x = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("client_id"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_extendedprice").alias("level"),
        F.col("l_quantity").alias("inflow"),
        (F.col("l_discount") * 100).alias("outflow"),
        (F.col("l_linestatus") == "F").cast("int").alias("valve"),
    )
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "level", "inflow", "outflow", "valve"]
    return numbered(x, ["client_id"], "l_shipdate", ties, unit="month").select("client_id", "row_id", "level", "inflow", "outflow", "valve")


SQL_SHIPMENTS = """ship AS (SELECT l_suppkey % 10 AS client_id, l_extendedprice AS level, l_quantity AS inflow, l_discount * 100 AS outflow, CAST(l_linestatus = 'F' AS INTEGER) AS valve,
  row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount * 100, CAST(l_linestatus = 'F' AS INTEGER)) AS row_id FROM lineitem)"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, dim, value: the mean vector of each label of embeddings."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("client_id"), F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("client_id", "dim").agg(F.avg(F.col("v").cast("double")).alias("value"))


def client_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("client_id")).agg(F.count("*").alias("weight"))


def server_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dim, value: the mean over vectors of even id."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0").select(F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("value"))


def round_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round (vec_id mod 5), client_id, dim, value."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("round"), F.col("label").alias("client_id"), F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("round", "client_id", "dim").agg(F.avg(F.col("v").cast("double")).alias("value"))


SQL_UPDATES = """long AS (SELECT vec_id, label AS client_id, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
upd AS (SELECT client_id, dim, avg(v) AS value FROM long GROUP BY ALL), wt AS (SELECT label AS client_id, count(*) AS weight FROM embeddings GROUP BY ALL),
srv AS (SELECT dim, avg(v) AS value FROM long WHERE vec_id % 2 = 0 GROUP BY ALL)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed, defence, mode, f1: a result grid from orders. mode: F reference, O naive, P gated."""
    mode = F.when(F.col("o_orderstatus") == "F", "reference").when(F.col("o_orderstatus") == "O", "naive").otherwise("gated")
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("seed"), F.col("o_orderpriority").alias("defence"), mode.alias("mode")).agg((F.avg("o_totalprice") / 1e6).alias("f1"))


SQL_CELLS = """cells AS (SELECT year(o_orderdate)::INTEGER AS seed, o_orderpriority AS defence, CASE o_orderstatus WHEN 'F' THEN 'reference' WHEN 'O' THEN 'naive' ELSE 'gated' END AS mode, avg(o_totalprice) / 1e6 AS f1 FROM orders GROUP BY ALL)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, score, label of the whole record by descending score; id breaks ties."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"))
    return cumulative(e, [], F.floor(F.col("score") * 64).cast("long"), [F.desc("score"), F.asc("id")], {"tp": F.col("label")}, row="rank", descending=True)


SQL_SCORES = """sc AS (SELECT event_id AS id, value AS score, CAST(event_type = 'error' AS INTEGER) AS label, row_number() OVER w AS rank, sum(CAST(event_type = 'error' AS INTEGER)) OVER w AS tp FROM events
  WINDOW w AS (ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
