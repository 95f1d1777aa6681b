"""Queries over a whole scenario: from two records to the verdict on every client's batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.scalar import tidy
from tidegate.operators import order, rules, scenario
from tidegate.operators.keep import written
from tidegate.plans.record import UNIT
from tidegate.sources import views

CHANNELS = ["value", "k", "flow", "status"]
SETTINGS = scenario.Settings(clients=10, malicious=0.3, fabrication="channel_roll", options={"channels": ["status"], "shift": 7}, window=10, alpha=0.05, least_rows=20)
STEP = rules.linear("value", {"k": 0.5}, 0.0, diff=True)
LABEL = "att_flag"


def records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The clean rows of the event record, numbered anew, and the whole labelled record. A flow follows the status, so that a coupling can be mined."""
    t = views.telemetry(spark, sf_dir, key=False)
    flow = F.when(F.col("status") == 2, 20 + F.col("value") / 200).otherwise(F.col("value") / 5000)
    whole = written(t.select("row_id", F.col("value").cast("double").alias("value"), F.col("k").cast("double").alias("k"), flow.alias("flow"), F.when(F.col("status") == 2, 2).otherwise(1).alias("status"), LABEL))
    clean = order.cumulative(whole.filter(f"{LABEL} = 0").withColumnRenamed("row_id", "at"), [], F.floor(F.col("at") / order.BLOCK), [F.col("at")]).drop("at")
    return written(clean), whole


def built(spark: SparkSession, sf_dir: str, settings: scenario.Settings = SETTINGS) -> scenario.Scenario:
    clean, whole = records(spark, sf_dir)
    return scenario.Scenario(clean, whole, settings, scenario.mined_couplings(["status"], ["flow", "value"], [STEP]), CHANNELS)


def scenario_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each client of the scenario: rows, spliced rows, windows drawn, drawn ones that touch the attack, and the verdict on its batch."""
    sc = built(spark, sf_dir)
    size = sc.batches.groupBy("client_id", "is_malicious").agg(F.count("*").alias("n_rows"), F.count_if("spliced").alias("n_laid"))
    # rolling moves the channels, not the mark of a spliced row
    drawn = sc.selection.groupBy("client_id").agg(F.count("*").alias("n_drawn"), F.sum("row_id").alias("drawn_sum"))
    v = sc.verdicts.select("client_id", tidy(F.col("violating_fraction")).alias("violating_fraction"), "admitted")
    out = size.join(drawn, "client_id", "left").join(v, "client_id")
    return out.select("client_id", "is_malicious", "n_rows", "n_laid", F.coalesce("n_drawn", F.lit(0)).alias("n_drawn"), F.coalesce("drawn_sum", F.lit(0)).alias("drawn_sum"), "violating_fraction", "admitted")


def scenario_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the sets that detection is tested on: how many there are, are labelled, touch the targets, and are labelled without touching them."""
    w = scenario.evaluation_windows(built(spark, sf_dir), SETTINGS.window)
    bad = F.col("label") == 1
    return w.groupBy("set").agg(F.count("*").alias("n_windows"), F.count_if(bad).alias("n_attack"), F.count_if(bad & F.col("targeted")).alias("n_targeted"), F.count_if(bad & ~F.col("targeted")).alias("n_untargeted"))


_S = SETTINGS
_BAD = round(_S.clients * _S.malicious)
_SHIFT = _S.options["shift"]
SQL_BUILT = f"""WITH {views.SQL_TELEMETRY},
rec AS (SELECT record_row AS row_id, value, k::DOUBLE AS k, CASE WHEN status = 2 THEN 20 + value / 200 ELSE value / 5000 END AS flow, CASE WHEN status = 2 THEN 2 ELSE 1 END AS status, att_flag FROM tel),
nor AS (SELECT row_number() OVER (ORDER BY row_id) AS r, value, k, flow, status FROM rec WHERE att_flag = 0),
cut AS (SELECT n, a, b, c, n - c AS pool FROM (SELECT count(*) AS n, floor(count(*) * {_S.mining})::BIGINT AS a, floor(count(*) * {_S.mining})::BIGINT + floor(count(*) * {_S.validation})::BIGINT AS b,
  floor(count(*) * {_S.mining})::BIGINT + floor(count(*) * {_S.validation})::BIGINT + floor(count(*) * {_S.root})::BIGINT AS c FROM nor)),
fit AS (SELECT *, status = lag(status) OVER (ORDER BY r) AS steady FROM nor, cut WHERE r <= a // 2),
nom AS (SELECT avg(flow) FILTER (steady AND status = 2) AS nominal FROM fit),
cal AS (SELECT CASE WHEN status = lag(status) OVER (ORDER BY r) THEN flow - (status - 1) * nominal END AS r0, value - lag(value) OVER (ORDER BY r) - 0.5 * k AS r1 FROM nor, cut, nom WHERE r > a // 2 AND r <= a),
eps AS (SELECT quantile_cont(abs(r0), 0.999) * 1.5 AS e0, quantile_cont(abs(r1), 0.999) * 1.5 AS e1 FROM cal),
edge AS (SELECT i AS client_id, floor(pool * i / {_S.clients})::BIGINT AS lo, floor(pool * (i + 1) / {_S.clients})::BIGINT AS hi, row_number() OVER (ORDER BY {UNIT.format(f"'{_S.seed}/' || i")}, i) <= {_BAD} AS is_malicious FROM range(0, {_S.clients}) AS x(i), cut),
shard AS (SELECT client_id, is_malicious, hi - lo AS n, r - c - lo AS row_id, value, k, flow, status FROM nor, cut JOIN edge ON r - c > lo AND r - c <= hi),
isl AS (SELECT row_id, row_id - row_number() OVER (ORDER BY row_id) AS g FROM rec WHERE att_flag = 1),
seg AS (SELECT row_number() OVER (ORDER BY min(row_id)) AS seg_id, min(row_id) AS start_row, count(*) AS n_rows FROM isl GROUP BY g),
bud AS (SELECT *, sum(n_rows) OVER (ORDER BY {UNIT.format(f"'{_S.seed + scenario.TARGETS}/0/' || seg_id")}, seg_id) AS upto FROM seg),
tgt AS (SELECT seg_id, start_row, least(n_rows, budget - (upto - n_rows))::BIGINT AS n_rows FROM bud, (SELECT round_even(pool // {_S.clients} * {_S.target}, 0)::BIGINT AS budget FROM cut) WHERE budget - (upto - n_rows) > 0),
pie AS (SELECT client_id, seg_id, start_row, least(n_rows, hi - lo) AS n_rows, floor({UNIT.format(f"'{_S.seed + scenario.PLACES}/' || client_id || '/' || seg_id")} * (hi - lo - least(n_rows, hi - lo) + 1))::BIGINT + 1 AS at_row FROM tgt, edge WHERE is_malicious),
lay AS (SELECT client_id, at_row + i AS row_id, arg_max(start_row + i, seg_id) AS src FROM (SELECT *, unnest(range(0, n_rows)) AS i FROM pie) GROUP BY ALL),
own AS (SELECT s.client_id, s.is_malicious, s.n, s.row_id, l.src IS NOT NULL AS spliced, CASE WHEN l.src IS NULL THEN s.value ELSE r.value END AS value, CASE WHEN l.src IS NULL THEN s.k ELSE r.k END AS k,
  CASE WHEN l.src IS NULL THEN s.flow ELSE r.flow END AS flow, CASE WHEN l.src IS NULL THEN s.status ELSE r.status END AS status FROM shard AS s LEFT JOIN lay AS l ON l.client_id = s.client_id AND l.row_id = s.row_id LEFT JOIN rec AS r ON r.row_id = l.src),
bat AS (SELECT a.client_id, a.is_malicious, a.n, a.row_id, a.spliced, a.value, a.k, a.flow, CASE WHEN a.is_malicious THEN b.status ELSE a.status END AS status FROM own AS a JOIN own AS b ON b.client_id = a.client_id AND b.row_id = ((a.row_id - 1 - {_SHIFT}) % a.n + a.n) % a.n + 1)"""
_W = _S.window
SQL_CLIENTS = f"""{SQL_BUILT},
win AS (SELECT client_id, row_id, hit FROM (SELECT client_id, row_id, max(spliced::INTEGER) OVER w AS hit, count(*) OVER w AS c FROM own WHERE is_malicious WINDOW w AS (PARTITION BY client_id ORDER BY row_id ROWS BETWEEN CURRENT ROW AND {_W - 1} FOLLOWING)) WHERE c = {_W}),
rk AS (SELECT *, row_number() OVER (PARTITION BY client_id, hit ORDER BY row_id) AS i, row_number() OVER (PARTITION BY client_id ORDER BY row_id) AS pos, count(*) OVER (PARTITION BY client_id) AS n, sum(hit) OVER (PARTITION BY client_id) AS h FROM win),
wa AS (SELECT client_id, pos, CASE WHEN h = 0 THEN 0 WHEN n = h THEN 1 ELSE (pos <= floor(n * {_S.poison}))::INTEGER END AS want, n, h FROM rk),
dr AS (SELECT client_id, want, floor({UNIT.format(f"'{_S.seed + scenario.DRAWS}/' || client_id || '/' || pos")} * (CASE WHEN want = 1 THEN h ELSE n - h END))::BIGINT + 1 AS i FROM wa),
sel AS (SELECT dr.client_id, count(*) AS n_drawn, sum(rk.row_id)::BIGINT AS drawn_sum FROM dr JOIN rk ON rk.client_id = dr.client_id AND rk.hit = dr.want AND rk.i = dr.i GROUP BY 1),
res AS (SELECT client_id, is_malicious, spliced, coalesce(abs(CASE WHEN status = lag(status) OVER w THEN flow - (status - 1) * nominal END) > e0, false) OR coalesce(abs(value - lag(value) OVER w - 0.5 * k) > e1, false) AS bad FROM bat, nom, eps WINDOW w AS (PARTITION BY client_id ORDER BY row_id)),
ver AS (SELECT client_id, is_malicious, count(*) AS n_rows, count(*) FILTER (spliced) AS n_laid, avg(bad::INTEGER) AS f FROM res GROUP BY ALL)
SELECT client_id::INTEGER AS client_id, is_malicious, n_rows, n_laid, coalesce(n_drawn, 0) AS n_drawn, coalesce(drawn_sum, 0) AS drawn_sum, round(f, 6) AS violating_fraction, f <= {_S.alpha} AS admitted FROM ver LEFT JOIN sel USING (client_id)"""
SQL_WINDOW_SETS = f"""{SQL_BUILT},
aim AS (SELECT start_row + i AS row_id FROM (SELECT *, unnest(range(0, n_rows)) AS i FROM tgt)),
lab AS (SELECT 'test' AS set, rec.row_id, att_flag AS hit, (aim.row_id IS NOT NULL)::INTEGER AS aim FROM rec LEFT JOIN aim USING (row_id) UNION ALL SELECT 'clean_val', r, 0, 0 FROM nor, cut WHERE r > a AND r <= b),
win AS (SELECT set, max(hit) OVER w AS hit, max(aim) OVER w AS aim, count(*) OVER w AS c FROM lab WINDOW w AS (PARTITION BY set ORDER BY row_id ROWS BETWEEN CURRENT ROW AND {_W - 1} FOLLOWING))
SELECT set, count(*) AS n_windows, count(*) FILTER (hit = 1) AS n_attack, count(*) FILTER (hit = 1 AND aim = 1) AS n_targeted, count(*) FILTER (hit = 1 AND aim = 0) AS n_untargeted FROM win WHERE c = {_W} GROUP BY 1"""

QUERIES = {
    "scenario_clients": (scenario_clients, SQL_CLIENTS),
    "scenario_windows": (scenario_windows, SQL_WINDOW_SETS),
}
