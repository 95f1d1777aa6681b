"""Queries that mine rules, train federated models and project batches."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.scalar import tidy
from tidegate.operators import federation, mining, order, projection, record, rules
from tidegate.operators.keep import written
from tidegate.sources import views

KEY = ["client_id"]
TEL = f"WITH {views.SQL_TELEMETRY}"
WIDTH, PROJECTED = 10, 512


def _statused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with a flow that follows the status, so that couplings exist: flow is 20 + value / 200 when on, value / 5000 else."""
    t = views.telemetry(spark, sf_dir)
    return t.withColumn("flow", F.when(F.col("status") == 2, 20 + F.col("value") / 200).otherwise(F.col("value") / 5000))


def mine_couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mining.coupling_table(_statused(spark, sf_dir).withColumn("status", F.when(F.col("status") == 0, 1).otherwise(F.col("status"))), KEY, ["status"], ["flow", "value"])
    return t.select("status", "flow", "off_value", "on_value", *[tidy(F.col(c)).alias(c) for c in ("nominal", "cv", "off_q", "support")])


SQL_COUPLINGS = f"""{TEL}, s AS (SELECT client_id, row_id, CASE WHEN status = 2 THEN 2.0 ELSE 1.0 END AS st, CASE WHEN status = 2 THEN 20 + value / 200 ELSE value / 5000 END AS flow, value FROM tel),
l AS (SELECT *, st = lag(st) OVER (PARTITION BY client_id ORDER BY row_id) AS steady FROM s), p AS (SELECT st, 'flow' AS flow, flow AS v FROM l WHERE steady UNION ALL SELECT st, 'value', value FROM l WHERE steady),
t AS (SELECT 'flow' AS flow, max(abs(flow)) AS top FROM s UNION ALL SELECT 'value', max(abs(value)) FROM s),
a AS (SELECT flow, avg(v) FILTER (st = 2) AS nominal, stddev_pop(v) FILTER (st = 2) AS sd, quantile_cont(abs(v), 0.99) FILTER (st = 1) AS off_q, least(count(*) FILTER (st = 2), count(*) FILTER (st = 1)) / (SELECT count(*) FROM s) AS support FROM p GROUP BY 1)
SELECT 'status' AS status, flow, 1.0::DOUBLE AS off_value, 2.0::DOUBLE AS on_value, round(nominal, 6) AS nominal, round(sd / abs(nominal), 6) AS cv, round(off_q, 6) AS off_q, round(support, 6) AS support
FROM a JOIN t USING (flow) WHERE support >= 0.02 AND off_q / top <= 0.05 AND nominal > 0 AND sd / abs(nominal) <= 0.35 AND nominal > 3 * off_q"""


def boundary_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of each client's level step on the inflow alone, and the spread of its outflow."""
    d = order.with_previous(views.shipments(spark, sf_dir), KEY, ["level"])
    y = F.col("level") - F.col("prev_level")
    return d.groupBy("client_id").agg(tidy(F.regr_r2(y, F.col("inflow"))).alias("r2"), tidy(F.regr_slope(y, F.col("inflow")), 4).alias("slope"), tidy(F.stddev_pop("outflow") / (F.abs(F.avg("outflow")) + 1e-12)).alias("outflow_cv"))


SQL_R2 = f"WITH {views.SQL_SHIPMENTS}, d AS (SELECT *, level - lag(level) OVER (PARTITION BY client_id ORDER BY row_id) AS y FROM ship) SELECT client_id, round(regr_r2(y, inflow), 6) AS r2, round(regr_slope(y, inflow), 4) AS slope, round(stddev_pop(outflow) / (abs(avg(outflow)) + 1e-12), 6) AS outflow_cv FROM d GROUP BY 1"


def mine_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per mined balance of the shipment record: its terms and fit."""
    found = mining.balances(views.shipments(spark, sf_dir), KEY, ["level"], ["inflow", "outflow"], alpha=1e-4)
    return spark.createDataFrame([(b.target, b.terms, b.const, b.r2, b.tightness) for b in found], "target string, terms map<string,double>, const double, r2 double, tightness double")


def mined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the rules that the wide setting mines from each client's status, flow and value."""
    t = _statused(spark, sf_dir).withColumn("status", F.when(F.col("status") == 0, 1).otherwise(F.col("status")))
    return mining.mined(t, KEY, ["value"], ["flow"], ["status"], "wide")[1]


def state_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of both sensors' mixtures that pin the status, however loosely."""
    t = mining.state_rules(_statused(spark, sf_dir), ["flow", "value"], ["status"], purity=0.3, rounds=MIXED)
    return t.select("sensor", "component", "actuator", "value", tidy(F.col("purity"), 4).alias("purity"), tidy(F.col("support"), 4).alias("support"))


def _mixed_sql() -> str:
    """The rounds of both mixtures, one after another."""
    log = lambda i: f"ln(w{i}) - ln(v{i}) / 2 - (x - m{i}) ** 2 / (2 * v{i})"
    out = ["p0 AS (SELECT sensor, greatest(var_pop(x) * 1e-6, 1e-12) AS lo, " + ", ".join(f"1.0::DOUBLE / 3 AS w{i}, avg(x) + {i - 1} * stddev_pop(x) AS m{i}, greatest(var_pop(x), 1e-12) AS v{i}" for i in range(3)) + " FROM s2 GROUP BY 1)"]
    for r in range(MIXED):
        out.append(f"l{r} AS (SELECT s2.*, p.lo, (m0 + m1 + m2) / 3 AS mid, {', '.join(f'{log(i)} AS l{i}' for i in range(3))} FROM s2 JOIN p{r} AS p USING (sensor))")
        out.append(f"e{r} AS (SELECT sensor, lo, mid, x - mid AS d, {', '.join(f'exp(l{i} - greatest(l0, l1, l2)) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))) AS r{i}' for i in range(3))} FROM l{r})")
        out.append(f"p{r + 1} AS (SELECT sensor, lo, " + ", ".join(f"greatest(sum(r{i}) / count(*), 1e-9) AS w{i}, mid + sum(r{i} * d) / sum(r{i}) AS m{i}, greatest(sum(r{i} * d * d) / sum(r{i}) - (sum(r{i} * d) / sum(r{i})) ** 2, lo) AS v{i}" for i in range(3)) + f" FROM e{r} GROUP BY sensor, lo, mid)")
    out.append(f"f AS (SELECT sensor, st, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS component FROM (SELECT s2.*, {', '.join(f'{log(i)} AS l{i}' for i in range(3))} FROM s2 JOIN p{MIXED} USING (sensor)))")
    return ", ".join(out)


MIXED = 6
_FLOW = "CASE WHEN status = 2 THEN 20 + value / 200 ELSE value / 5000 END"
SQL_STATES = f"""{TEL}, s2 AS (SELECT 'flow' AS sensor, {_FLOW} AS x, status AS st FROM tel UNION ALL SELECT 'value', value, status FROM tel), {_mixed_sql()},
c AS (SELECT sensor, component, st, count(*) AS c FROM f GROUP BY ALL), g AS (SELECT sensor, component, arg_max(st, {{'c': c, 'v': -st}}) AS st, max(c) AS c, sum(c) AS t FROM c GROUP BY ALL)
SELECT sensor, component::INTEGER AS component, 'status' AS actuator, st::DOUBLE AS value, round(c / t, 4) AS purity, round(t / (SELECT count(*) FROM tel), 4) AS support FROM g WHERE c / t >= 0.3 AND t / (SELECT count(*) FROM tel) >= 0.03"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.telemetry(spark, sf_dir)
    z = record.standardised(t, record.scaler(t, ["value", "k"]), ["value", "k"])
    return record.windows(z, KEY, ["z_value", "z_k"], "att_flag", WIDTH, WIDTH)


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federation.moments(_windows(spark, sf_dir), 2 * WIDTH, 2)


def local_train_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every client's update in the first round, from zero: two steps on all of its windows."""
    u = federation.local_updates(_moments(spark, sf_dir), [0.0] * (2 * WIDTH - 1))
    return u.select("client_id", "dim", tidy(F.col("value")).alias("value"))


_D = 2 * WIDTH - 1  # readings before the last row, and a constant
SQL_TRAIN_BASE = f"""{TEL}, st AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM tel),
z AS (SELECT client_id, row_id, att_flag, ((value - mv) / sv)::FLOAT::DOUBLE AS zv, ((k - mk) / sk)::FLOAT::DOUBLE AS zk FROM tel, st),
wf AS (SELECT client_id, (row_id - 1) // {WIDTH} AS window_id, flatten(list([zv, zk] ORDER BY row_id)) AS x, max(att_flag) AS label FROM z GROUP BY ALL HAVING count(*) = {WIDTH}),
fy AS (SELECT client_id, window_id, label, list_append(x[1:{2 * WIDTH - 2}], 1.0) AS f, x[{2 * WIDTH - 1}] AS y FROM wf),
fl AS (SELECT client_id, window_id, y, unnest(range(0, {_D})) AS i, unnest(f) AS v FROM fy),
mb AS (SELECT client_id, i, avg(v * y) AS b FROM fl GROUP BY ALL),
ma AS (SELECT p.client_id, p.i, q.i AS j, avg(p.v * q.v) AS a FROM fl AS p JOIN fl AS q ON p.client_id = q.client_id AND p.window_id = q.window_id GROUP BY ALL),
s1 AS (SELECT client_id, i, {2 * federation.RATE} * b AS w FROM mb),
s2 AS (SELECT mb.client_id, mb.i, any_value(own.w) + {2 * federation.RATE} * (any_value(b) - sum(a * s1.w)) AS w FROM mb JOIN ma ON ma.client_id = mb.client_id AND ma.i = mb.i JOIN s1 ON s1.client_id = mb.client_id AND s1.i = ma.j JOIN s1 AS own ON own.client_id = mb.client_id AND own.i = mb.i GROUP BY mb.client_id, mb.i)"""
SQL_TRAIN = f"{SQL_TRAIN_BASE} SELECT client_id, i::INTEGER AS dim, round(w, 6) + 0.0 AS value FROM s2"


def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of every window's prediction under the model of one federated round by medians."""
    w = _windows(spark, sf_dir)
    params = federation.run_rounds(federation.moments(w, 2 * WIDTH, 2), 1, "median")
    s = federation.score(w, params, ["client_id", "window_id", "label"], 2)
    return s.withColumn("score", tidy(F.col("score"), 5))


# the lower one of two middle values
SQL_SCORED = f"""{SQL_TRAIN_BASE}, md AS (SELECT i, list_sort(list(w))[(count(*) + 1) // 2] AS w FROM s2 GROUP BY 1)
SELECT fl.client_id, fl.window_id, any_value(fy.label) AS label, round(pow(any_value(fl.y) - sum(v * w), 2), 5) + 0.0 AS score FROM fl JOIN md USING (i) JOIN fy ON fy.client_id = fl.client_id AND fy.window_id = fl.window_id GROUP BY ALL"""


def project_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For batches of 512 rows of each client: rows that violate a rule before and after projection, and its mean change."""
    t = views.telemetry(spark, sf_dir).withColumn("batch_id", F.floor((F.col("row_id") - 1) / PROJECTED))
    rule_set = [replace(rules.linear("value", {"k": 0.5}, 0.0, diff=True), eps=100.0)]
    key = [*KEY, "batch_id"]
    x = t.select(*key, (F.col("row_id") - F.col("batch_id") * PROJECTED).alias("row_id"), F.col("value").cast("double"), F.col("k").cast("double"))
    p = projection.project(x, key, ["value", "k"], rule_set, protect=["k"])
    broken = lambda d: rules.residuals(order.with_previous(d, key, ["value"]), rule_set).groupBy(*key).agg(F.count_if(rules.violates(0, rule_set[0])).alias("n"))
    moved = p.groupBy(*key).agg(F.avg("moved").alias("mean_moved"))
    return broken(x).withColumnRenamed("n", "before").join(broken(p).withColumnRenamed("n", "after"), key).join(moved, key)


def projection_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's whole record as one batch: violating rows and verdict before and after projection, and the rows whose protected channel changed."""
    rule_set = [replace(rules.linear("value", {"k": 0.5}, 0.0, diff=True), eps=100.0)]
    x = written(views.telemetry(spark, sf_dir).select(*KEY, "row_id", F.col("value").cast("double"), F.col("k").cast("double")))
    p = written(projection.project(x, KEY, ["value", "k"], rule_set, protect=["k"]))
    side = lambda d, s: rules.verdicts(rules.residuals(order.with_previous(d, KEY, ["value"]), rule_set), KEY, rule_set).select(*KEY, F.col("n_rows").alias(f"n_{s}"), F.rint(F.col("violating_fraction") * F.col("n_rows")).cast("long").alias(f"violating_{s}"), F.col("admitted").alias(f"admitted_{s}"))
    kept = x.select(*KEY, "row_id", F.col("k").alias("was")).join(p, [*KEY, "row_id"]).groupBy(*KEY).agg(F.count_if(F.col("k") != F.col("was")).alias("n_protected_changed"))
    return side(x, "before").join(side(p, "after"), KEY).join(kept, KEY)


# what a projection must come to: every row is there, none violates, no protected value has changed
SQL_PROJECTION = f"""{TEL}, v AS (SELECT client_id, coalesce(abs(value - lag(value) OVER (PARTITION BY client_id ORDER BY row_id) - 0.5 * k) > 100, false) AS bad FROM tel)
SELECT client_id, count(*) AS n_before, count(*) FILTER (bad) AS violating_before, avg(bad::INTEGER) <= {rules.ALPHA} AS admitted_before, count(*) AS n_after, 0::BIGINT AS violating_after, true AS admitted_after, 0::BIGINT AS n_protected_changed FROM v GROUP BY 1"""


QUERIES = {
    "mine_couplings": (mine_couplings, SQL_COUPLINGS),
    "boundary_r2": (boundary_r2, SQL_R2),
    "mine_balances": (mine_balances, None),
    "mined_rules": (mined_rules, None),
    "state_rules": (state_rules, SQL_STATES),
    "local_train_round": (local_train_round, SQL_TRAIN),
    "window_scores": (window_scores, SQL_SCORED),
    "project_batch": (project_batch, None),
    "projection_verdicts": (projection_verdicts, SQL_PROJECTION),
}
