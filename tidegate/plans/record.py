"""Queries over a record's order, segments, windows and fabrications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.scalar import tidy, unit_hash
from tidegate.operators import order, record
from tidegate.sources import views

KEY = ["client_id"]
TEL = f"WITH {views.SQL_TELEMETRY}"
UNIT = "(('0x' || substr(md5({}), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0"
SHARDS, STRIDE, SKIP, WIDTH, BATCH_ROWS, BATCHES, SHIFT, SEGMENTS, DENSE = 7, 5, 100, 10, 50, 20, 7, 12, 40
FRACTIONS = {"mining": 0.30, "validation": 0.15, "root": 0.05}
INTERVALS = [(11, 40), (30, 55), (300, 301), (900, 2100), (2500, 2500)]


def _n(df: DataFrame) -> DataFrame:
    """df with n, its number of rows."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias("n"))))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.telemetry(spark, sf_dir, key=False).withColumnRenamed("client_id", "user_group")


def channel_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", (F.col("l_linestatus") == "F").cast("int").alias("S_status"), F.col("l_quantity").alias("F_quantity"))
    return record.channel_catalog(x)


_CH = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "l_tax": "l_tax", "l_linenumber": "l_linenumber"}
SQL_ROLES = " UNION ALL ".join([f"SELECT '{c}' AS channel, count(DISTINCT {c}) AS n_levels, CASE WHEN count(DISTINCT {c}) <= 6 THEN 'discrete' ELSE 'continuous' END AS role FROM lineitem" for c in _CH] + ["SELECT 'S_status', count(DISTINCT l_linestatus = 'F'), 'discrete' FROM lineitem", "SELECT 'F_quantity', count(DISTINCT l_quantity), 'continuous' FROM lineitem"])


def temporal_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = record.temporal_shards(_n(_whole(spark, sf_dir)), SHARDS, F.col("n"))
    return d.groupBy("client_id").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


SQL_TEMPORAL = f"{TEL}, e AS (SELECT i, floor(n * i / {SHARDS}) AS lo, floor(n * (i + 1) / {SHARDS}) AS hi FROM range(0, {SHARDS}) AS r(i), (SELECT count(*) AS n FROM tel)) SELECT i::INTEGER AS client_id, count(*) AS n_rows, min(record_row) AS first_row, max(record_row) AS last_row FROM tel JOIN e ON record_row > lo AND record_row <= hi GROUP BY i"


def iid_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = record.even_shards(_n(_whole(spark, sf_dir)), SHARDS, F.col("n"), unit_hash(F.lit(17), F.col("event_id")), "event_id")
    return d.groupBy("client_id").agg(F.count("*").alias("n_rows"), F.sum("event_id").alias("id_sum"))


SQL_IID = f"SELECT (ntile({SHARDS}) OVER (ORDER BY {UNIT.format("'17/' || event_id")}, event_id) - 1)::INTEGER AS client_id, event_id FROM events"
SQL_IID = f"SELECT client_id, count(*) AS n_rows, sum(event_id)::BIGINT AS id_sum FROM ({SQL_IID}) GROUP BY 1"


def record_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = record.slices(_n(_whole(spark, sf_dir)), F.col("n"), FRACTIONS)
    return d.groupBy("slice").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


SQL_SLICES = f"""{TEL}, n AS (SELECT count(*) AS n FROM tel) SELECT CASE WHEN record_row <= floor(n * 0.30) THEN 'mining' WHEN record_row <= floor(n * 0.30) + floor(n * 0.15) THEN 'validation'
  WHEN record_row <= floor(n * 0.30) + floor(n * 0.15) + floor(n * 0.05) THEN 'root' ELSE 'client_pool' END AS slice, count(*) AS n_rows, min(record_row) AS first_row, max(record_row) AS last_row FROM tel, n GROUP BY 1"""


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.stride(_whole(spark, sf_dir), SKIP, STRIDE).select("row_id", "event_id")


SQL_STRIDE = f"{TEL} SELECT (record_row - 1 - {SKIP}) // {STRIDE} + 1 AS row_id, event_id FROM tel WHERE record_row > {SKIP} AND (record_row - 1 - {SKIP}) % {STRIDE} = 0"


def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.telemetry(spark, sf_dir).withColumn("one", F.lit(1.0))
    z = record.standardised(t, record.scaler(t, ["value", "k", "one"]), ["value", "k", "one"])
    return z.select("client_id", "row_id", *[tidy(F.col(f"z_{c}")).alias(f"z_{c}") for c in ("value", "k", "one")])


SQL_STANDARDISE = f"{TEL}, s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM tel) SELECT client_id, row_id, round((value - mv) / sv, 6) + 0.0 AS z_value, round((k - mk) / sk, 6) + 0.0 AS z_k, 0.0::DOUBLE AS z_one FROM tel, s"


def attack_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.islands(views.telemetry(spark, sf_dir), KEY, "att_flag")


_ISL = "isl AS (SELECT client_id, row_id, row_id - row_number() OVER (PARTITION BY client_id ORDER BY row_id) AS g FROM tel WHERE att_flag = 1), seg AS (SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY min(row_id)) AS seg_id, min(row_id) AS start_row, count(*) AS n_rows FROM isl GROUP BY client_id, g)"
SQL_SEGMENTS = f"{TEL}, {_ISL} SELECT * FROM seg"


def segment_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.budgeted(attack_segments(spark, sf_dir), KEY, 60, 777).select("client_id", "seg_id", "start_row", F.col("n_rows").cast("long").alias("n_rows"))


SQL_BUDGET = f"""{TEL}, {_ISL}, r AS (SELECT *, sum(n_rows) OVER (PARTITION BY client_id ORDER BY {UNIT.format("'777/' || client_id || '/' || seg_id")}, seg_id) AS upto FROM seg)
SELECT client_id, seg_id, start_row, least(n_rows, 60 - (upto - n_rows))::BIGINT AS n_rows FROM r WHERE 60 - (upto - n_rows) > 0"""


def targeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = record.touched_windows(views.telemetry(spark, sf_dir), KEY, "att_flag", WIDTH)
    return d.groupBy("client_id").agg(F.count("*").alias("n_windows"), F.sum("touched").alias("n_touched"))


SQL_TARGETED = f"{TEL}, x AS (SELECT client_id, max(att_flag) OVER w AS touched, count(*) OVER w AS n FROM tel WINDOW w AS (PARTITION BY client_id ORDER BY row_id ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING)) SELECT client_id, count(*) AS n_windows, sum(touched)::BIGINT AS n_touched FROM x WHERE n = {WIDTH} GROUP BY 1"


def splice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attack stretches of each client laid over its record at seeded places, later ones over earlier ones."""
    t = views.telemetry(spark, sf_dir)
    n = t.groupBy("client_id").agg(F.count("*").alias("n"))
    seg = order.islands(t, KEY, "att_flag").join(n, "client_id")
    at = F.floor(unit_hash(F.lit(5), F.col("client_id"), F.col("seg_id")) * (F.col("n") - F.col("n_rows"))) + 1
    pieces = seg.select("client_id", F.col("seg_id").alias("seq"), at.alias("at"), F.col("start_row").alias("from_row"), "n_rows")
    return record.splice(t, KEY, pieces, t, ["value", "k", "att_flag"]).select("client_id", "row_id", "value", "k", "att_flag", "spliced")


SQL_SPLICE = f"""{TEL}, {_ISL}, n AS (SELECT client_id, count(*) AS n FROM tel GROUP BY 1),
p AS (SELECT client_id, seg_id, start_row, n_rows, floor({UNIT.format("'5/' || client_id || '/' || seg_id")} * (n - n_rows))::BIGINT + 1 AS at_row FROM seg JOIN n USING (client_id)),
e AS (SELECT client_id, seg_id, at_row + i AS row_id, start_row + i AS src FROM (SELECT *, unnest(range(0, n_rows)) AS i FROM p)),
l AS (SELECT client_id, row_id, arg_max(src, seg_id) AS src FROM e GROUP BY ALL)
SELECT t.client_id, t.row_id, CASE WHEN l.src IS NULL THEN t.value ELSE s.value END AS value, CASE WHEN l.src IS NULL THEN t.k ELSE s.k END AS k, CASE WHEN l.src IS NULL THEN t.att_flag ELSE s.att_flag END AS att_flag, l.src IS NOT NULL AS spliced
FROM tel AS t LEFT JOIN l ON l.client_id = t.client_id AND l.row_id = t.row_id LEFT JOIN tel AS s ON s.client_id = l.client_id AND s.row_id = l.src"""


def interval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = spark.createDataFrame(INTERVALS, "start long, stop long")
    return record.interval_labels(_whole(spark, sf_dir).select("row_id", "event_id"), sheet).select("row_id", "label")


SQL_INTERVALS = f"{TEL} SELECT record_row AS row_id, max((record_row >= a AND record_row < b)::INTEGER) AS label FROM tel, (VALUES {', '.join(map(str, INTERVALS))}) AS v(a, b) GROUP BY 1"


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = record.windows(views.telemetry(spark, sf_dir), KEY, ["value", "k"], "att_flag", WIDTH, STRIDE)
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + F.round(b.cast("double"), 2))
    return w.select("client_id", "window_id", F.size("x").alias("width"), tidy(total, 3).alias("total"), "label")


SQL_WINDOWS = f"""{TEL}, x AS (SELECT client_id, row_id, count(*) OVER w AS n, sum(round(value, 2) + k) OVER w AS s, max(att_flag) OVER w AS label FROM tel WINDOW w AS (PARTITION BY client_id ORDER BY row_id ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING))
SELECT client_id, (row_id - 1) // {STRIDE} AS window_id, {2 * WIDTH}::INTEGER AS width, round(s, 3) AS total, label FROM x WHERE n = {WIDTH} AND (row_id - 1) % {STRIDE} = 0"""


def ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.telemetry(spark, sf_dir).withColumn("value", F.when(F.col("k") % 3 == 0, F.col("value")))
    return order.filled(t, KEY, "value", "filled", block=64).select("client_id", "row_id", "filled")


SQL_FILL = f"{TEL}, x AS (SELECT client_id, row_id, CASE WHEN k % 3 = 0 THEN value END AS v FROM tel) SELECT client_id, row_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM x"


def densest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.densest(views.telemetry(spark, sf_dir), KEY, "att_flag", DENSE)


SQL_DENSEST = f"{TEL}, x AS (SELECT client_id, row_id, sum(att_flag) OVER w AS s, count(*) OVER w AS n FROM tel WINDOW w AS (PARTITION BY client_id ORDER BY row_id ROWS BETWEEN CURRENT ROW AND {DENSE - 1} FOLLOWING)) SELECT client_id, arg_min(row_id, {{'a': -s, 'b': row_id}}) AS start_row, max(s)::BIGINT AS total FROM x WHERE n = {DENSE} GROUP BY 1"


def batch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean |first difference| of seeded batches; the first row of a batch has no predecessor."""
    t = views.telemetry(spark, sf_dir)
    n = t.groupBy("client_id").agg(F.count("*").alias("n"))
    starts = n.withColumn("batch_id", F.explode(F.sequence(F.lit(0), F.lit(BATCHES - 1)))).select("client_id", "batch_id", (F.floor(unit_hash(F.lit(3), F.col("client_id"), F.col("batch_id")) * (F.col("n") - BATCH_ROWS + 1)) + 1).alias("start"))
    b = order.with_previous(record.batches(t, KEY, starts, BATCH_ROWS), [*KEY, "batch_id"], ["value"])
    return b.groupBy("client_id", "batch_id").agg(F.count("*").alias("n_rows"), tidy(F.avg(F.abs(F.col("value") - F.col("prev_value")))).alias("mean_step"))


SQL_BATCHES = f"""{TEL}, n AS (SELECT client_id, count(*) AS n FROM tel GROUP BY 1), b AS (SELECT client_id, i::INTEGER AS batch_id, floor({UNIT.format("'3/' || client_id || '/' || i")} * (n - {BATCH_ROWS} + 1))::BIGINT + 1 AS s FROM n, range(0, {BATCHES}) AS r(i)),
x AS (SELECT t.client_id, batch_id, abs(value - lag(value) OVER (PARTITION BY t.client_id, batch_id ORDER BY row_id)) AS d FROM tel AS t JOIN b ON t.client_id = b.client_id AND row_id BETWEEN s AND s + {BATCH_ROWS - 1})
SELECT client_id, batch_id, count(*) AS n_rows, round(avg(d), 6) AS mean_step FROM x GROUP BY ALL"""


def channel_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.roll(views.telemetry(spark, sf_dir), KEY, ["status"], SHIFT).select("client_id", "row_id", "value", "status")


SQL_ROLL = f"{TEL}, n AS (SELECT client_id, count(*) AS n FROM tel GROUP BY 1) SELECT a.client_id, a.row_id, a.value, b.status FROM tel AS a JOIN n USING (client_id) JOIN tel AS b ON b.client_id = a.client_id AND b.row_id = ((a.row_id - 1 - {SHIFT}) % n + n) % n + 1"


def conservation_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = record.scale_flows(views.shipments(spark, sf_dir), 1.3, ["inflow", "outflow"])
    return d.groupBy("client_id").agg(*[tidy(F.avg(c)).alias(c) for c in ("level", "inflow", "outflow")])


SQL_SCALING = f"WITH {views.SQL_SHIPMENTS} SELECT client_id, round(avg(level), 6) AS level, round(avg(inflow * 1.3), 6) AS inflow, round(avg(outflow * 1.3), 6) AS outflow FROM ship GROUP BY 1"


def regime_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.telemetry(spark, sf_dir).withColumn("regime", F.floor(F.col("k") / 25))
    return record.permute_within(t, KEY, "regime", ["status"], 9).select("client_id", "row_id", "k", "status")


SQL_PERMUTE = f"""{TEL}, a AS (SELECT client_id, row_id, k, k // 25 AS g, status, row_number() OVER (PARTITION BY client_id, k // 25 ORDER BY row_id) AS p, row_number() OVER (PARTITION BY client_id, k // 25 ORDER BY {UNIT.format("'9/' || client_id || '/' || row_id")}, row_id) AS q FROM tel)
SELECT a.client_id, a.row_id, a.k, b.status FROM a JOIN a AS b ON a.client_id = b.client_id AND a.g = b.g AND a.p = b.q"""


def regime_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.splice_regimes(views.telemetry(spark, sf_dir), KEY, SEGMENTS, 4).select("client_id", "row_id", "event_id")


SQL_REGIME_SPLICE = f"""{TEL}, n AS (SELECT client_id, count(*) AS n FROM tel GROUP BY 1), s AS (SELECT t.client_id, row_id, event_id, floor((row_id - 1) * {SEGMENTS} / n)::INTEGER AS seg FROM tel AS t JOIN n USING (client_id))
SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY {UNIT.format("'4/' || client_id || '/' || seg")}, seg, row_id) AS row_id, event_id FROM s"""

FABRICATED = ("splice_only", "channel_roll", "conservation_scaling", "regime_splicing")


def fabricated(t: DataFrame, kind: str) -> DataFrame:
    options = {"channel_roll": {"key": KEY, "channels": ["status"], "shift": SHIFT}, "conservation_scaling": {"factor": 1.3, "flows": ["value"]}, "regime_splicing": {"key": KEY, "segments": SEGMENTS, "seed": 4}}
    return record.fabricate(t, kind, **options.get(kind, {}))


def fabrication_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fabrication and client: rows, mean value, mean |step| and rows with status on."""
    t = views.telemetry(spark, sf_dir).select("client_id", "row_id", "value", "k", "status")
    each = []
    for kind in FABRICATED:
        d = order.with_previous(fabricated(t, kind), KEY, ["value"])
        each.append(d.groupBy("client_id").agg(F.count("*").alias("n_rows"), tidy(F.avg("value"), 5).alias("mean_value"), tidy(F.avg(F.abs(F.col("value") - F.col("prev_value"))), 5).alias("mean_step"), F.count_if((F.col("status") == 2) & (F.col("k") >= 50)).alias("on_rows")).withColumn("fabrication", F.lit(kind)))
    return reduce(DataFrame.unionByName, each)


_FAB = {"splice_only": "SELECT client_id, row_id, value, k, status FROM tel", "channel_roll": SQL_ROLL.split(" SELECT a.client_id", 1)[1].replace(", a.row_id, a.value, b.status FROM", "SELECT a.client_id, a.row_id, a.value, a.k, b.status FROM", 1), "conservation_scaling": "SELECT client_id, row_id, value * 1.3 AS value, k, status FROM tel"}
SQL_EFFECT = f"""{TEL}, n AS (SELECT client_id, count(*) AS n FROM tel GROUP BY 1), s AS (SELECT t.client_id, row_id, value, k, status, floor((row_id - 1) * {SEGMENTS} / n)::INTEGER AS seg FROM tel AS t JOIN n USING (client_id)),
f AS ({' UNION ALL '.join(f"SELECT '{k}' AS fabrication, * FROM ({q})" for k, q in _FAB.items())} UNION ALL SELECT 'regime_splicing', client_id, row_number() OVER (PARTITION BY client_id ORDER BY {UNIT.format("'4/' || client_id || '/' || seg")}, seg, row_id), value, k, status FROM s),
d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY fabrication, client_id ORDER BY row_id)) AS step FROM f)
SELECT fabrication, client_id, count(*) AS n_rows, round(avg(value), 5) AS mean_value, round(avg(step), 5) AS mean_step, count(*) FILTER (status = 2 AND k >= 50) AS on_rows FROM d GROUP BY ALL"""

QUERIES = {
    "channel_roles": (channel_roles, SQL_ROLES),
    "temporal_shards": (temporal_shards, SQL_TEMPORAL),
    "iid_shards": (iid_shards, SQL_IID),
    "record_slices": (record_slices, SQL_SLICES),
    "stride_sample": (stride_sample, SQL_STRIDE),
    "standardise": (standardise, SQL_STANDARDISE),
    "attack_segments": (attack_segments, SQL_SEGMENTS),
    "segment_budget": (segment_budget, SQL_BUDGET),
    "targeted_windows": (targeted_windows, SQL_TARGETED),
    "splice_rows": (splice_rows, SQL_SPLICE),
    "interval_labels": (interval_labels, SQL_INTERVALS),
    "sliding_windows": (sliding_windows, SQL_WINDOWS),
    "ffill_bfill": (ffill_bfill, SQL_FILL),
    "densest_window": (densest_window, SQL_DENSEST),
    "batch_windows": (batch_windows, SQL_BATCHES),
    "channel_roll": (channel_roll, SQL_ROLL),
    "conservation_scaling": (conservation_scaling, SQL_SCALING),
    "regime_permutation": (regime_permutation, SQL_PERMUTE),
    "regime_splice": (regime_splice, SQL_REGIME_SPLICE),
    "fabrication_effect": (fabrication_effect, SQL_EFFECT),
}
