"""Queries that fit, pair, budget and judge: nested least squares, couplings by name, sampling budgets, exported batches, the separation's verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.functions.scalar import tidy, unit_hash
from tidegate.operators import fits, models, order, record
from tidegate.plans import evaluation, learning, studies
from tidegate.plans.record import UNIT
from tidegate.sources import views

KEY = ["client_id"]
TEL = f"WITH {views.SQL_TELEMETRY}"
SAMPLES, DRAWS, EXPORTED = (4, 8, 16), 10, 64


def boundary_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each client the level's step on the inflow alone and on inflow and outflow: fit, coefficients, and what the outflow adds."""
    d = order.with_previous(views.shipments(spark, sf_dir), KEY, ["level"]).withColumn("step", F.col("level") - F.col("prev_level")).filter("has_prev")
    one = fits.least_squares(d, KEY, "step", ["inflow"], "in_")
    two = fits.least_squares(d, KEY, "step", ["inflow", "outflow"], "both_")
    j = one.join(two, KEY)
    return j.select("client_id", F.col("both_n").alias("n"), tidy(F.col("in_r2")).alias("inflow_r2"), tidy(F.col("both_r2")).alias("boundary_r2"), tidy(F.col("both_r2") - F.col("in_r2")).alias("gain"), tidy(F.col("both_coef_inflow"), 3).alias("inflow"), tidy(F.col("both_coef_outflow"), 3).alias("outflow"), tidy(F.col("both_const"), 2).alias("const"))


SQL_FITS = f"""WITH {views.SQL_SHIPMENTS}, d AS (SELECT client_id, level - lag(level) OVER (PARTITION BY client_id ORDER BY row_id) AS y, inflow AS a, outflow AS b, row_id FROM ship),
c AS (SELECT client_id, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(y) AS yy, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM d WHERE row_id > 1 GROUP BY 1),
s AS (SELECT *, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS p, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS q FROM c)
SELECT client_id, n, round(ay * ay / (aa * yy), 6) + 0.0 AS inflow_r2, round((p * ay + q * byy) / yy, 6) + 0.0 AS boundary_r2, round((p * ay + q * byy) / yy - ay * ay / (aa * yy), 6) + 0.0 AS gain, round(p, 3) + 0.0 AS inflow, round(q, 3) + 0.0 AS outflow, round(my - p * ma - q * mb, 2) + 0.0 AS const FROM s"""


def paired_couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valve of the shipment record with flows of its name: one that stops with it, one that does not, one that varies too much."""
    s = views.shipments(spark, sf_dir)
    d = s.select(F.col("valve").alias("S_1"), F.col("valve").alias("S_2"), F.col("valve").alias("S_3"), (F.col("valve") * (200 + F.col("inflow") / 10)).alias("F_1"), (5 + F.col("outflow")).alias("F_2"), (F.col("valve") * F.col("inflow")).alias("F_3"))
    out = fits.paired_couplings(d, [(f"S_{i}", f"F_{i}") for i in (1, 2, 3)])
    return out.select("status", "flow", "n_on", *[tidy(F.col(c), 5).alias(c) for c in ("nominal", "cv", "off_top")], "kept")


_FLOWS = {1: "valve * (200 + inflow / 10)", 2: "5 + outflow", 3: "valve * inflow"}
SQL_PAIRED = f"""WITH {views.SQL_SHIPMENTS}, x AS ({' UNION ALL '.join(f"SELECT 'S_{i}' AS status, 'F_{i}' AS flow, valve, ({f})::DOUBLE AS v FROM ship" for i, f in _FLOWS.items())}),
e AS (SELECT min(valve) AS lo, max(valve) AS hi FROM ship), g AS (SELECT status, flow, count(*) FILTER (valve >= hi AND hi > 0) AS n_on, avg(v) FILTER (valve >= hi AND hi > 0) AS nominal, stddev_pop(v) FILTER (valve >= hi AND hi > 0) AS sd, max(abs(v)) FILTER (valve <= lo) AS off_top FROM x, e GROUP BY ALL)
SELECT status, flow, n_on, round(nominal, 5) + 0.0 AS nominal, round(sd / (abs(nominal) + 1e-9), 5) + 0.0 AS cv, round(off_top, 5) + 0.0 AS off_top, coalesce(n_on >= 20 AND coalesce(off_top, 0) < 1e-3 AND sd / (abs(nominal) + 1e-9) <= 0.1, false) AS kept FROM g"""


def budget_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each client and sample size: over seeded samples from every block of 64 rows, quantiles of the sums of violated and of inapplicable rules, and how often they are 0, 1 or 2 at most."""
    c = evaluation._counted(spark, sf_dir).withColumn("block", F.floor((F.col("row_id") - 1) / studies.HONEST))
    each = c.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("h", unit_hash(F.lit(29), F.col("client_id"), F.col("draw"), F.col("row_id")))
    # a draw ranks the 64 rows of one block; a larger sample of it holds the smaller ones
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("client_id", "block", "draw").orderBy("h", "row_id"))).filter(F.col("r") <= max(SAMPLES))
    s = ranked.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, SAMPLES)), lambda k: k >= F.col("r")))).groupBy("client_id", "k", "block", "draw").agg(F.sum("v").alias("v"), F.sum("u").alias("u"))
    # sums are at most twice the sample, so a quantile holds few counts
    share = lambda x, m: tidy(F.avg((F.col(x) <= m).cast("double"))).alias(f"p_{x}_{m}")
    return s.groupBy("client_id", "k").agg(F.count("*").alias("n_draws"), *[share(x, m) for x in "vu" for m in range(3)], *[tidy(F.percentile(x, q)).alias(f"q_{x}_{int(100 * q)}") for x in "vu" for q in (0.5, 0.95, 0.99)])


SQL_BUDGETS = f"""{TEL}, {evaluation._QR}, e AS (SELECT client_id, v, u, d, (row_id - 1) // {studies.HONEST} AS block, row_number() OVER (PARTITION BY client_id, (row_id - 1) // {studies.HONEST}, d ORDER BY {UNIT.format("'29/' || client_id || '/' || d || '/' || row_id")}, row_id) AS r FROM vu, range(0, {DRAWS}) AS x(d)),
s AS (SELECT client_id, k, block, d, sum(v) AS v, sum(u) AS u FROM e, (VALUES {', '.join(f'({k})' for k in SAMPLES)}) AS t(k) WHERE r <= k GROUP BY ALL)
SELECT client_id, k, count(*) AS n_draws, {', '.join(f'round(avg(({x} <= {m})::INTEGER), 6) AS p_{x}_{m}' for x in 'vu' for m in range(3))}, {', '.join(f'round(quantile_cont({x}::DOUBLE, {q}), 6) AS q_{x}_{int(100 * q)}' for x in 'vu' for q in (0.5, 0.95, 0.99))} FROM s GROUP BY ALL"""


def exported_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each client the batches that are exported for a check: its first rows, its last ones, and the stretch with most attack rows; with their integer values' sums and counts of rules."""
    c = evaluation._counted(spark, sf_dir)
    n = c.groupBy("client_id").agg(F.count("*").alias("n")).filter(F.col("n") >= EXPORTED)
    starts = n.select("client_id", F.explode(F.array(F.struct(F.lit("first").alias("batch_id"), F.lit(1).cast("long").alias("start")), F.struct(F.lit("last").alias("batch_id"), (F.col("n") - EXPORTED + 1).alias("start")))).alias("s")).select("client_id", "s.*")
    hot = record.densest(c, KEY, "att_flag", EXPORTED).select("client_id", F.lit("densest").alias("batch_id"), F.col("start_row").cast("long").alias("start"))
    b = record.batches(c, KEY, starts.unionByName(hot), EXPORTED)
    return b.groupBy("client_id", "batch_id").agg(F.count("*").alias("n_rows"), F.sum("x_value").alias("value_sum"), F.sum("x_k").alias("k_sum"), F.sum("v").alias("v"), F.sum("u").alias("u"), F.sum("att_flag").alias("n_attack"))


SQL_EXPORTED = f"""{TEL}, {evaluation._QR}, d AS (SELECT client_id, row_id, sum(att_flag) OVER w AS s, count(*) OVER w AS n FROM tel WINDOW w AS (PARTITION BY client_id ORDER BY row_id ROWS BETWEEN CURRENT ROW AND {EXPORTED - 1} FOLLOWING)),
st AS (SELECT client_id, 'densest' AS batch_id, arg_min(row_id, {{'a': -s, 'b': row_id}}) AS st FROM d WHERE n = {EXPORTED} GROUP BY 1 UNION ALL SELECT client_id, 'first', 1 FROM tel GROUP BY 1 HAVING count(*) >= {EXPORTED} UNION ALL SELECT client_id, 'last', count(*) - {EXPORTED} + 1 FROM tel GROUP BY 1 HAVING count(*) >= {EXPORTED})
SELECT st.client_id, batch_id, count(*) AS n_rows, sum(x)::BIGINT AS value_sum, sum(q.k)::BIGINT AS k_sum, sum(v)::BIGINT AS v, sum(u)::BIGINT AS u, sum(att_flag)::BIGINT AS n_attack
FROM st JOIN q ON q.client_id = st.client_id AND q.row_id BETWEEN st AND st + {EXPORTED - 1} JOIN vu ON vu.client_id = q.client_id AND vu.row_id = q.row_id JOIN tel ON tel.client_id = q.client_id AND tel.row_id = q.row_id GROUP BY ALL"""


def separation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fabrications the check separates (overlap and admitted share under 5 %), and the criterion: two at least, with under 5 % of honest batches rejected."""
    t = studies.separation_table(spark, sf_dir)
    made = F.col("fabrication") != "splice_only"
    t = t.withColumn("separated", made & (F.col("overlap") < 0.05) & (F.col("admitted_rate") < 0.05))
    # a row a fabrication
    whole = t.agg(F.count_if("separated").alias("n_separated"), tidy(1 - F.max(F.when(~made, F.col("admitted_rate")))).alias("honest_rejected"))
    out = t.filter(made).select("fabrication", "separated").crossJoin(F.broadcast(whole))
    return out.withColumn("passed", (F.col("n_separated") >= 2) & (F.col("honest_rejected") < 0.05))


SQL_VERDICT = f"""WITH t AS ({studies.SQL_SEPARATION}), s AS (SELECT *, fabrication <> 'splice_only' AND overlap < 0.05 AND admitted_rate < 0.05 AS separated FROM t),
w AS (SELECT count(*) FILTER (separated) AS n_separated, round(1 - max(admitted_rate) FILTER (fabrication = 'splice_only'), 6) + 0.0 AS honest_rejected FROM s)
SELECT fabrication, separated, n_separated, honest_rejected, n_separated >= 2 AND honest_rejected < 0.05 AS passed FROM s, w WHERE fabrication <> 'splice_only'"""


def autoencoder_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each client: windows, and the mean loss of the layered window model on them before and after two median rounds of minibatch steps on all of them."""
    w = learning._windows(spark, sf_dir)
    model = models.build("window_ae", 2 * learning.WIDTH)
    flat, _ = models.run_rounds(models.dealt(w, 2), model, 2, "median", epochs=2, parts=2)
    loss = lambda p, name: models.score(w, model, p, KEY).groupBy("client_id").agg(F.count("*").alias("n_windows"), F.avg("score").alias(name))
    j = loss(model.start(0), "before").join(loss(flat, "after").drop("n_windows"), KEY)
    return j.select("client_id", "n_windows", tidy(F.col("before"), 4).alias("before"), tidy(F.col("after"), 4).alias("after"), (F.col("after") < F.col("before")).alias("learned"))


QUERIES = {
    "boundary_fits": (boundary_fits, SQL_FITS),
    "paired_couplings": (paired_couplings, SQL_PAIRED),
    "budget_quantiles": (budget_quantiles, SQL_BUDGETS),
    "exported_batches": (exported_batches, SQL_EXPORTED),
    "separation_verdict": (separation_verdict, SQL_VERDICT),
    "autoencoder_training": (autoencoder_training, None),
}
