"""Admission of client batches: residuals, calibration, verdicts, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.scalar import tidy
from tidegate.operators import order, rules
from tidegate.sources import views

KEY = ["client_id"]
#: The rule set of the event record; every kind but balance, which the shipment record has.
RULES = [rules.coupling("status", "value", 50.0, off=1, on=2, steady=True), rules.linear("value", {"k": 0.5}, 0.0, diff=True), rules.bound("value", 0.0, 200.0)]
SHIPMENT_BALANCE = rules.balance("level", ["inflow"], ["outflow"], area=0.05)
ALPHAS = (0.0005, 0.001, 0.0015, 0.002, 0.005)
FIT = 0.3


def _sized(t: DataFrame) -> DataFrame:
    """With n, the rows of the client: 10 rows of counts, joined."""
    return t.join(t.groupBy("client_id").agg(F.count("*").alias("n")), "client_id")


def calibration_part(t: DataFrame) -> DataFrame:
    return _sized(t).filter(F.col("row_id") <= F.floor(F.col("n") * FIT)).drop("n")


def batch_part(t: DataFrame) -> DataFrame:
    """The rows after the calibration part, numbered anew: a batch forgets its predecessor."""
    s = _sized(t)
    return s.filter(F.col("row_id") > F.floor(F.col("n") * FIT)).withColumn("row_id", F.col("row_id") - F.floor(F.col("n") * FIT)).drop("n")


def looked_back(t: DataFrame, rule_set=RULES) -> DataFrame:
    return order.with_previous(t, KEY, rules.looking_back(rule_set))


def calibrated(t: DataFrame) -> list[rules.Rule]:
    return rules.calibrate(looked_back(calibration_part(t)), RULES)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.telemetry(spark, sf_dir)
    rule_set = calibrated(t)
    return rules.verdicts(rules.residuals(looked_back(batch_part(t)), rule_set), KEY, rule_set)


def admission_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir)
    share = lambda m, i, n: tidy(F.col(m)[RULES[i].name]).alias(n)
    return v.select("client_id", "n_rows", tidy(F.col("violating_fraction")).alias("violating_fraction"), "admitted", *[share("per_rule", i, f"violates_{i}") for i in range(3)], *[share("not_applicable", i, f"na_{i}") for i in range(3)], tidy(F.col("mean_row_score")).alias("mean_row_score"))


_PARTS = f"""{views.SQL_TELEMETRY},
n AS (SELECT client_id, count(*) AS n FROM tel GROUP BY 1),
cal0 AS (SELECT t.client_id, row_id, value, k, status FROM tel AS t JOIN n USING (client_id) WHERE row_id <= floor(n * {FIT})),
bat0 AS (SELECT t.client_id, row_id - floor(n * {FIT})::BIGINT AS row_id, value, k, status FROM tel AS t JOIN n USING (client_id) WHERE row_id > floor(n * {FIT}))"""


def _res(source: str) -> str:
    return f"""SELECT client_id, row_id,
  CASE WHEN status IN (1, 2) AND status = lag(status) OVER w THEN value - (status - 1) * 50.0 END AS r0,
  value - lag(value) OVER w - 0.5 * k AS r1, greatest(0.0 - value, value - 200.0, 0.0) AS r2
  FROM {source} WINDOW w AS (PARTITION BY client_id ORDER BY row_id)"""


_EPS = ", ".join(f"CASE WHEN count(r{i}) = 0 THEN 1e-6 WHEN quantile_cont(abs(r{i}), 0.999) * 1.5 <= 0 THEN 1e-9 ELSE quantile_cont(abs(r{i}), 0.999) * 1.5 END AS e{i}" for i in range(3))
_VIOL = [f"coalesce(abs(r{i}) > e{i}, false)" for i in range(3)]
_EXC = ", ".join(f"coalesce(greatest(abs(r{i}) / e{i} - 1, 0), 0)" for i in range(3))
SQL_VERDICTS = f"""{_PARTS}, calr AS ({_res('cal0')}), batr AS ({_res('bat0')}), eps AS (SELECT {_EPS} FROM calr),
ver AS (SELECT client_id, count(*) AS n_rows, avg(({' OR '.join(_VIOL)})::INTEGER) AS violating_fraction,
  {', '.join(f'avg(({v})::INTEGER) AS violates_{i}' for i, v in enumerate(_VIOL))}, {', '.join(f'avg((r{i} IS NULL)::INTEGER) AS na_{i}' for i in range(3))},
  avg(greatest(0.0, {_EXC})) AS mean_row_score FROM batr, eps GROUP BY client_id)"""
SQL_ADMISSION = f"""WITH {SQL_VERDICTS} SELECT client_id, n_rows, round(violating_fraction, 6) AS violating_fraction, violating_fraction <= 0.01 AS admitted,
  {', '.join(f'round(violates_{i}, 6) AS violates_{i}, round(na_{i}, 6) AS na_{i}' for i in range(3))}, round(mean_row_score, 6) AS mean_row_score FROM ver"""


def calibrate_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = looked_back(calibration_part(views.telemetry(spark, sf_dir)))
    r = rules.residuals(t, RULES).select(F.explode(F.array(*[F.struct(F.lit(x.name).alias("rule"), F.abs(f"r_{i}").alias("v")) for i, x in enumerate(RULES)])).alias("x")).select("x.*")
    q = order.exact_quantile(r, ["rule"], "v", rules.QUANTILE, "q")
    eps = F.col("q") * rules.SAFETY
    return q.select("rule", tidy(F.when(eps > 0, eps).otherwise(rules.EPS_ZERO)).alias("eps"))


SQL_EPS = f"""WITH {_PARTS}, calr AS ({_res('cal0')}), eps AS (SELECT {_EPS} FROM calr)
{' UNION ALL '.join(f"SELECT '{r.name}' AS rule, round(e{i}, 6) AS eps FROM eps" for i, r in enumerate(RULES))}"""


def _one(rule: rules.Rule, source):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = rules.residuals(looked_back(source(spark, sf_dir), [rule]), [rule])
        return d.select("client_id", "row_id", tidy(F.col("r_0")).alias("residual"))

    return run


residual_coupling = _one(rules.coupling("status", "value", 50.0, off=1, on=2), views.telemetry)
residual_coupling_steady = _one(RULES[0], views.telemetry)
residual_linear = _one(RULES[1], views.telemetry)
residual_bound = _one(rules.bound("value", 5.0, 60.0), views.telemetry)
residual_balance = _one(SHIPMENT_BALANCE, views.shipments)
_W = "WINDOW w AS (PARTITION BY client_id ORDER BY row_id)"
SQL_RESIDUALS = {
    "residual_coupling": f"WITH {views.SQL_TELEMETRY} SELECT client_id, row_id, round(CASE WHEN status IN (1, 2) THEN value - (status - 1) * 50.0 END, 6) + 0.0 AS residual FROM tel",
    "residual_coupling_steady": f"WITH {views.SQL_TELEMETRY} SELECT client_id, row_id, round(CASE WHEN status IN (1, 2) AND status = lag(status) OVER w THEN value - (status - 1) * 50.0 END, 6) + 0.0 AS residual FROM tel {_W}",
    "residual_linear": f"WITH {views.SQL_TELEMETRY} SELECT client_id, row_id, round(value - lag(value) OVER w - 0.5 * k, 6) + 0.0 AS residual FROM tel {_W}",
    "residual_bound": f"WITH {views.SQL_TELEMETRY} SELECT client_id, row_id, round(greatest(5.0 - value, value - 60.0, 0.0), 6) + 0.0 AS residual FROM tel",
    "residual_balance": f"WITH {views.SQL_SHIPMENTS} SELECT client_id, row_id, round(level - lag(level) OVER w - (inflow - outflow) / 0.05, 6) + 0.0 AS residual FROM ship {_W}",
}


def row_excess_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.telemetry(spark, sf_dir)
    rule_set = calibrated(t)
    d = rules.residuals(looked_back(batch_part(t)), rule_set)
    return d.select("client_id", "row_id", tidy(rules.row_score(rule_set)).alias("row_score"))


SQL_ROW_SCORE = f"WITH {_PARTS}, calr AS ({_res('cal0')}), batr AS ({_res('bat0')}), eps AS (SELECT {_EPS} FROM calr) SELECT client_id, row_id, round(greatest(0.0, {_EXC}), 6) + 0.0 AS row_score FROM batr, eps"


def gate_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clients that stay, at a threshold of 0.15 %."""
    v = verdicts(spark, sf_dir).withColumn("admitted", F.col("violating_fraction") <= 0.0015)
    return rules.gate(views.telemetry(spark, sf_dir).select("client_id").distinct(), v)


SQL_GATE = f"WITH {SQL_VERDICTS} SELECT DISTINCT client_id FROM tel ANTI JOIN (SELECT client_id FROM ver WHERE violating_fraction > 0.0015) USING (client_id)"


def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir).select((F.col("client_id") % 3 == 0).alias("is_malicious"), (F.col("violating_fraction") <= 0.0015).alias("admitted"))
    s = rules.summary(v)
    return s.select(tidy(F.col("malicious_admitted_rate")).alias("malicious_admitted_rate"), tidy(F.col("honest_admitted_rate")).alias("honest_admitted_rate"), "n_honest_rejected")


SQL_SUMMARY = f"""WITH {SQL_VERDICTS} SELECT round(avg((violating_fraction <= 0.0015)::INTEGER) FILTER (client_id % 3 = 0), 6) AS malicious_admitted_rate,
  round(avg((violating_fraction <= 0.0015)::INTEGER) FILTER (client_id % 3 <> 0), 6) AS honest_admitted_rate, count(*) FILTER (client_id % 3 <> 0 AND violating_fraction > 0.0015) AS n_honest_rejected FROM ver"""


def honest_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and mean value of the clients that are not malicious."""
    t = views.telemetry(spark, sf_dir).filter(F.col("client_id") % 3 != 0)
    return t.groupBy("client_id").agg(F.count("*").alias("n_rows"), tidy(F.avg("value")).alias("mean_value"))


SQL_HONEST = f"WITH {views.SQL_TELEMETRY} SELECT client_id, count(*) AS n_rows, round(avg(value), 6) AS mean_value FROM tel WHERE client_id % 3 <> 0 GROUP BY 1"


def alpha_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.alpha_sweep(verdicts(spark, sf_dir), ALPHAS)


SQL_ALPHA = f"""WITH {SQL_VERDICTS} SELECT alpha, count(*) FILTER (violating_fraction <= alpha) AS n_admitted, count(*) FILTER (violating_fraction > alpha) AS n_rejected
FROM ver, (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALPHAS)}) AS a(alpha) GROUP BY alpha"""


def coverage_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of attack rows: violating fraction, the rule that is violated most (first of equals), covered or not."""
    t = views.telemetry(spark, sf_dir)
    rule_set = calibrated(t)
    d = rules.residuals(looked_back(t), rule_set)
    seg = order.islands(t, KEY, "att_flag")
    rows = seg.select("client_id", "seg_id", "start_row", F.explode(F.sequence("start_row", F.col("start_row") + F.col("n_rows") - 1)).alias("row_id"))
    d = d.select("client_id", "row_id", rules.any_violation(rule_set).alias("any"), *[rules.violates(i, r).cast("int").alias(f"v{i}") for i, r in enumerate(rule_set)])
    g = d.join(rows, ["client_id", "row_id"]).groupBy("client_id", "seg_id").agg(F.count("*").alias("n_rows"), F.avg(F.col("any").cast("double")).alias("f"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(3)])
    worst = F.array_max(F.array(*[F.struct(F.col(f"m{i}").alias("m"), F.lit(-i).alias("i")) for i in range(3)]))
    return g.select("client_id", "seg_id", "n_rows", tidy(F.col("f")).alias("violating_fraction"), F.element_at(F.array(*[F.lit(r.name) for r in RULES]), 1 - worst["i"]).alias("worst_rule"), (F.col("f") > 0.01).alias("covered"))


SQL_ISLANDS = "isl AS (SELECT client_id, row_id, row_id - row_number() OVER (PARTITION BY client_id ORDER BY row_id) AS g FROM tel WHERE att_flag = 1), seg AS (SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY min(row_id)) AS seg_id, min(row_id) AS start_row, count(*) AS n_rows FROM isl GROUP BY client_id, g)"
SQL_COVERAGE = f"""WITH {_PARTS}, calr AS ({_res('cal0')}), eps AS (SELECT {_EPS} FROM calr), allr AS ({_res('tel')}), {SQL_ISLANDS},
m AS (SELECT a.client_id, s.seg_id, count(*) AS n_rows, avg(({' OR '.join(_VIOL)})::INTEGER) AS f, {', '.join(f'avg(({v})::INTEGER) AS m{i}' for i, v in enumerate(_VIOL))}
  FROM allr AS a JOIN seg AS s ON a.client_id = s.client_id AND a.row_id BETWEEN s.start_row AND s.start_row + s.n_rows - 1, eps GROUP BY ALL)
SELECT client_id, seg_id, n_rows, round(f, 6) AS violating_fraction, CASE WHEN m0 >= m1 AND m0 >= m2 THEN '{RULES[0].name}' WHEN m1 >= m2 THEN '{RULES[1].name}' ELSE '{RULES[2].name}' END AS worst_rule, f > 0.01 AS covered FROM m"""

def verdict_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts under rules that were calibrated, written as a table of JSON and read back."""
    t = views.telemetry(spark, sf_dir)
    rule_set = rules.from_table(rules.as_table(spark, calibrated(t)))
    v = rules.verdicts(rules.residuals(looked_back(batch_part(t), rule_set), rule_set), KEY, rule_set)
    return v.select("client_id", "n_rows", tidy(F.col("violating_fraction")).alias("violating_fraction"), "admitted")


SQL_FROM_TABLE = f"WITH {SQL_VERDICTS} SELECT client_id, n_rows, round(violating_fraction, 6) AS violating_fraction, violating_fraction <= 0.01 AS admitted FROM ver"


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each client: attack stretches, covered ones, and the share of attack rows that lie in covered ones."""
    c = coverage_by_segment(spark, sf_dir)
    covered = F.when(F.col("covered"), F.col("n_rows")).otherwise(0)
    return c.groupBy("client_id").agg(F.count("*").alias("n_segments"), F.count_if("covered").alias("n_covered"), tidy(F.sum(covered) / F.sum("n_rows")).alias("covered_row_share"))


SQL_COVERAGE_SUMMARY = f"SELECT client_id, count(*) AS n_segments, count(*) FILTER (covered) AS n_covered, round(coalesce(sum(n_rows) FILTER (covered), 0) / sum(n_rows), 6) AS covered_row_share FROM ({SQL_COVERAGE}) GROUP BY 1"


def clean_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the clean record: attack rows go before rows look back, so a step may span them."""
    t = views.telemetry(spark, sf_dir).filter("att_flag = 0")
    t = order.cumulative(t.withColumnRenamed("row_id", "at"), KEY, F.floor(F.col("at") / order.BLOCK), [F.col("at")])
    d = order.with_previous(t, KEY, ["value"])
    return d.select("client_id", "row_id", tidy(F.col("value") - F.col("prev_value")).alias("step"))


SQL_CLEAN_STEPS = f"WITH {views.SQL_TELEMETRY} SELECT client_id, row_number() OVER w AS row_id, round(value - lag(value) OVER w, 6) + 0.0 AS step FROM tel WHERE att_flag = 0 WINDOW w AS (PARTITION BY client_id ORDER BY row_id)"


QUERIES = {
    "admission_verdict": (admission_verdict, SQL_ADMISSION),
    "calibrate_eps": (calibrate_eps, SQL_EPS),
    "residual_coupling": (residual_coupling, SQL_RESIDUALS["residual_coupling"]),
    "residual_coupling_steady": (residual_coupling_steady, SQL_RESIDUALS["residual_coupling_steady"]),
    "residual_linear": (residual_linear, SQL_RESIDUALS["residual_linear"]),
    "residual_bound": (residual_bound, SQL_RESIDUALS["residual_bound"]),
    "residual_balance": (residual_balance, SQL_RESIDUALS["residual_balance"]),
    "row_excess_score": (row_excess_score, SQL_ROW_SCORE),
    "gate_exclusion": (gate_exclusion, SQL_GATE),
    "verdict_summary": (verdict_summary, SQL_SUMMARY),
    "honest_only": (honest_only, SQL_HONEST),
    "alpha_sensitivity": (alpha_sensitivity, SQL_ALPHA),
    "coverage_by_segment": (coverage_by_segment, SQL_COVERAGE),
    "verdict_from_table": (verdict_from_table, SQL_FROM_TABLE),
    "coverage_summary": (coverage_summary, SQL_COVERAGE_SUMMARY),
    "clean_steps": (clean_steps, SQL_CLEAN_STEPS),
}
