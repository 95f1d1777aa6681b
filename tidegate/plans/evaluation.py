"""Queries over scores, fixed-point rules, commitments and result cells."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import trees
from tidegate.functions.scalar import miss_probability, tidy
from tidegate.operators import aggregation, attestation, fixedpoint, metrics, order, record, rules, stats
from tidegate.plans import record as record_plans
from tidegate.sources import views

KEY = ["client_id"]
TEL = f"WITH {views.SQL_TELEMETRY}"
SC = f"WITH {views.SQL_SCORES}"
CELLS = f"WITH {views.SQL_CELLS}"
CLEAN, DEPTH, K, TRIES = 0.15, 6, 8, 64
RULES = [rules.coupling("status", "value", 50.0, off=1, on=2, steady=True), rules.linear("value", {"k": 0.5}, 0.0, diff=True)]
EPS = (150.0, 120.0)


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.telemetry(spark, sf_dir, key=False)
    n = t.agg(F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(n)).filter(F.col("row_id") <= F.floor(F.col("n") * CLEAN)).select(F.col("value").alias("score"))


def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold(_clean(spark, sf_dir)).select(tidy(F.col("threshold")).alias("threshold"))


_THR = f"thr AS (SELECT quantile_cont(value, 0.995) AS threshold FROM tel, (SELECT count(*) AS n FROM tel) WHERE record_row <= floor(n * {CLEAN}))"
SQL_THRESHOLD = f"{TEL}, {_THR} SELECT round(threshold, 6) AS threshold FROM thr"


def detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.telemetry(spark, sf_dir, key=False).select(F.col("value").alias("score"), F.col("att_flag").alias("label"))
    r = metrics.report(s, metrics.threshold(_clean(spark, sf_dir)))
    return r.select("tp", "fp", "fn", "tn", *[tidy(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "fpr")])


SQL_REPORT = f"""{TEL}, {_THR}, c AS (SELECT count(*) FILTER (att_flag = 1 AND value > threshold) AS tp, count(*) FILTER (att_flag = 0 AND value > threshold) AS fp, count(*) FILTER (att_flag = 1 AND value <= threshold) AS fn, count(*) FILTER (att_flag = 0 AND value <= threshold) AS tn FROM tel, thr),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)
SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr FROM p"""


def f1_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.f1_best(views.scores(spark, sf_dir)).select(tidy(F.col("f1_best")).alias("f1_best"), "threshold")


SQL_F1 = f"{SC}, x AS (SELECT score, rank, 2.0 * tp / (rank + (SELECT sum(label) FROM sc)) AS f1 FROM sc) SELECT round(max(f1), 6) AS f1_best, arg_max(score, {{'f': f1, 'r': -rank}}) AS threshold FROM x"


def auc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc_pr(views.scores(spark, sf_dir)).select(tidy(F.col("auc_pr")).alias("auc_pr"))


SQL_AUC = f"{SC} SELECT round(sum(label * tp / rank) / sum(label), 6) AS auc_pr FROM sc"


def detection_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each client: segments, missed ones, mean and median delay of the others, with an alarm over 60."""
    t = views.telemetry(spark, sf_dir)
    d = metrics.delays(order.islands(t, KEY, "att_flag"), t.filter("value > 60"), KEY)
    return d.groupBy("client_id").agg(F.count("*").alias("n_segments"), F.count_if(F.col("delay").isNull()).alias("missed"), tidy(F.avg("delay")).alias("mean_delay"), tidy(F.percentile("delay", 0.5)).alias("median_delay"))


SQL_DELAY = f"""{TEL}, {record_plans._ISL}, d AS (SELECT seg.client_id, seg_id, min(t.row_id - start_row) AS delay FROM seg LEFT JOIN tel AS t ON t.client_id = seg.client_id AND t.row_id BETWEEN start_row AND start_row + n_rows - 1 AND value > 60 GROUP BY ALL)
SELECT client_id, count(*) AS n_segments, count(*) FILTER (delay IS NULL) AS missed, round(avg(delay), 6) AS mean_delay, round(quantile_cont(delay::DOUBLE, 0.5), 6) AS median_delay FROM d GROUP BY 1"""


def overlap_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.telemetry(spark, sf_dir).select(F.when(F.col("att_flag") == 1, "a").otherwise("b").alias("side"), "value")
    return metrics.overlap(t).select(tidy(F.col("overlap")).alias("overlap"))


SQL_OVERLAP = f"""{TEL}, s AS (SELECT min(value) AS lo, max(value) AS hi FROM tel), b AS (SELECT least(floor((value - lo) * 200 / (hi - lo)), 199) AS bin, count(*) FILTER (att_flag = 1) AS a, count(*) FILTER (att_flag = 0) AS b FROM tel, s GROUP BY 1)
SELECT round(sum(least(a / na, b / nb)), 6) AS overlap FROM b, (SELECT sum(a) AS na, sum(b) AS nb FROM b)"""


def attack_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.by_mode(views.cells(spark, sf_dir))
    s = metrics.attack_success(F.col("reference"), F.col("naive"))
    return d.select("seed", "defence", *[tidy(c).alias(n) for n, c in s.items()])


_PIV = "pv AS (SELECT seed, defence, max(f1) FILTER (mode = 'reference') AS reference, max(f1) FILTER (mode = 'naive') AS naive, max(f1) FILTER (mode = 'gated') AS gated FROM cells GROUP BY ALL)"
SQL_SUCCESS = f'{CELLS}, {_PIV} SELECT seed, defence, round(reference - naive, 6) + 0.0 AS "drop", round((reference - naive) / reference, 6) + 0.0 AS relative_drop FROM pv'


def _fixed() -> list[fixedpoint.FixedRule]:
    from dataclasses import replace

    return fixedpoint.quantise([replace(r, eps=e) for r, e in zip(RULES, EPS, strict=True)], ["status", "value", "k"])


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule_set = _fixed()
    q = fixedpoint.quantised_rows(views.telemetry(spark, sf_dir), ["status", "value", "k"])
    return fixedpoint.row_counts(order.with_previous(q, KEY, [f"x_{c}" for c in fixedpoint.needed(rule_set)]), rule_set)


def quantised_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _counted(spark, sf_dir)
    return d.select("client_id", "row_id", *[fixedpoint.integer_residual(r).alias(f"r{i}") for i, r in enumerate(_fixed())], "v", "u")


_S = fixedpoint.SCALE
_E = [round(_S * _S * e) + _S for e in EPS]
_QR = f"""q AS (SELECT client_id, row_id, round_even(status * {_S}, 0)::BIGINT AS s, round_even(value * {_S}, 0)::BIGINT AS x, round_even(k * {_S}, 0)::BIGINT AS k FROM tel),
l AS (SELECT *, lag(s) OVER w AS ps, lag(x) OVER w AS px FROM q WINDOW w AS (PARTITION BY client_id ORDER BY row_id)),
g AS (SELECT client_id, row_id, px IS NOT NULL AND round_even(s / {_S}, 0) IN (1, 2) AND round_even(s / {_S}, 0) = round_even(ps / {_S}, 0) AS a0, px IS NOT NULL AS a1,
  CASE WHEN px IS NULL THEN 0 ELSE {_S} * x - {round(_S * 50.0)} * s + {round(_S * _S * 50.0)} END AS r0, CASE WHEN px IS NULL THEN 0 ELSE {_S} * x - {round(_S * 0.5)} * k - {_S} * px END AS r1 FROM l),
vu AS (SELECT client_id, row_id, r0, r1, (a0 AND abs(r0) > {_E[0]})::INTEGER + (a1 AND abs(r1) > {_E[1]})::INTEGER AS v, (NOT a0)::INTEGER + (NOT a1)::INTEGER AS u FROM g)"""
SQL_QUANTISED = f"{TEL}, {_QR} SELECT client_id, row_id, r0::BIGINT AS r0, r1::BIGINT AS r1, v, u FROM vu"


def integer_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixedpoint.verdict(_counted(spark, sf_dir), KEY)
    return v.withColumn("violating_fraction", tidy(F.col("violating_fraction")))


SQL_INTEGER = f"{TEL}, {_QR} SELECT client_id, count(*) AS n_rows, round(avg((v > 0)::INTEGER), 6) AS violating_fraction, avg((v > 0)::INTEGER) <= 0.01 AS admitted FROM vu GROUP BY 1"


def fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule, over rows after the first: the largest |integer - float| residual in shares of eps, and disagreements."""
    rule_set = _fixed()
    q = fixedpoint.quantised_rows(views.telemetry(spark, sf_dir), ["status", "value", "k"])
    # the float model reads the previous row as recorded, not as quantised
    seen = order.with_previous(q, KEY, [*[f"x_{c}" for c in fixedpoint.needed(rule_set)], *rules.looking_back(RULES)])
    d = rules.residuals(seen, RULES).filter("has_prev")
    found = []
    for i, (r, q, e) in enumerate(zip(RULES, rule_set, EPS, strict=True)):
        gap = F.abs(fixedpoint.integer_residual(q) / float(_S * _S) - F.col(f"r_{i}")) / e
        differ = fixedpoint.integer_violates(q) != F.coalesce(F.abs(F.col(f"r_{i}")) > e, F.lit(False))
        found.append(F.struct(F.lit(r.name).alias("rule"), F.round(F.max(gap), 5).alias("worst_gap"), F.count_if(differ).alias("disagreements"), F.count_if(fixedpoint.integer_applies(q) != F.col(f"r_{i}").isNotNull()).alias("applicability_disagreements")))
    return d.agg(F.array(*found).alias("x")).select(F.explode("x").alias("x")).select("x.*")


SQL_FIDELITY = f"""{TEL}, {_QR}, f AS (SELECT t.client_id, t.row_id, CASE WHEN status IN (1, 2) AND status = lag(status) OVER w THEN value - (status - 1) * 50.0 END AS f0, value - lag(value) OVER w - 0.5 * k AS f1 FROM tel AS t WINDOW w AS (PARTITION BY client_id ORDER BY row_id)),
j AS (SELECT * FROM f JOIN g USING (client_id, row_id) WHERE row_id > 1)
{' UNION ALL '.join(f"SELECT '{r.name}' AS rule, round(max(abs(r{i} / {float(_S * _S)} - f{i}) / {e}), 5) AS worst_gap, count(*) FILTER ((a{i} AND abs(r{i}) > {_E[i]}) <> coalesce(abs(f{i}) > {e}, false)) AS disagreements, count(*) FILTER (a{i} <> (f{i} IS NOT NULL)) AS applicability_disagreements FROM j" for i, (r, e) in enumerate(zip(RULES, EPS)))}"""


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every block of 2^DEPTH rows of a client, the last one padded, with v and u: client_id, block, pos, hash, v, u."""
    d = _counted(spark, sf_dir).withColumns({"block": F.floor((F.col("row_id") - 1) / 2**DEPTH), "pos": (F.col("row_id") - 1) % 2**DEPTH})
    h = attestation.leaf([fixedpoint.biased(F.col(f"x_{c}")) for c in ("status", "value", "k")], [F.col("att_flag"), F.col("event_id")])
    return attestation.padded(d.select("client_id", "block", "pos", h.alias("hash"), "v", "u"), ["client_id", "block"], DEPTH)


def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attestation.roots(_leaves(spark, sf_dir), ["client_id", "block"], DEPTH)


_LEAF = f"""l0 AS (SELECT q.client_id, (q.row_id - 1) // {2**DEPTH} AS block, (q.row_id - 1) % {2**DEPTH} AS pos, sha256(sha256((s + {fixedpoint.BIAS}) || ',' || (x + {fixedpoint.BIAS}) || ',' || (q.k + {fixedpoint.BIAS})) || sha256(sha256(att_flag || ',' || event_id))) AS h, v, u
  FROM q JOIN tel AS t ON t.client_id = q.client_id AND t.row_id = q.row_id JOIN vu ON vu.client_id = q.client_id AND vu.row_id = q.row_id),
lf AS (SELECT * FROM l0 UNION ALL SELECT client_id, block, unnest(range(n, {2**DEPTH})), repeat('0', 64), 0, 0 FROM (SELECT client_id, block, count(*) AS n FROM l0 GROUP BY ALL))"""
_UP = ", ".join(f"m{d} AS (SELECT client_id, block, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {'lf' if d == 1 else f'm{d - 1}'} GROUP BY client_id, block, pos // 2)" for d in range(1, DEPTH + 1))
SQL_ROOT = f"{TEL}, {_QR}, {_LEAF}, {_UP} SELECT client_id, block, h AS root FROM m{DEPTH}"


def _challenged(spark: SparkSession, sf_dir: str, leaves: DataFrame) -> DataFrame:
    return attestation.challenges(attestation.roots(leaves, ["client_id", "block"], DEPTH).withColumn("nonce", F.lit(7)), ["client_id", "block"], 2**DEPTH, K, TRIES)


def challenge_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _challenged(spark, sf_dir, _leaves(spark, sf_dir))


_CH = f"""c0 AS (SELECT client_id, block, ctr, ('0x' || substr(sha256(h || '/7/' || ctr), 1, 15))::BIGINT % {2**DEPTH - 1} + 1 AS idx FROM m{DEPTH}, range(0, {TRIES}) AS r(ctr)), c1 AS (SELECT client_id, block, idx, min(ctr) AS ctr FROM c0 GROUP BY ALL),
ch AS (SELECT client_id, block, idx, ctr::INTEGER AS ctr FROM c1 QUALIFY row_number() OVER (PARTITION BY client_id, block ORDER BY ctr) <= {K})"""
SQL_CHALLENGE = f"{TEL}, {_QR}, {_LEAF}, {_UP}, {_CH} SELECT * FROM ch"


def sample_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _leaves(spark, sf_dir)
    return attestation.sampled_check(leaves.withColumnRenamed("pos", "idx"), _challenged(spark, sf_dir, leaves), ["client_id", "block"])


SQL_BUDGET = f"{TEL}, {_QR}, {_LEAF}, {_UP}, {_CH} SELECT client_id, block, sum(v)::BIGINT AS v, sum(u)::BIGINT AS u, sum(v) <= 1 AND sum(u) <= 8 AS accepted FROM lf JOIN ch USING (client_id, block) WHERE lf.pos = ch.idx GROUP BY ALL"


def opening_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each block: its leaves whose path of siblings folds to the block's root, and all its leaves."""
    key = ["client_id", "block"]
    opened = attestation.openings(_leaves(spark, sf_dir), key, DEPTH)
    return opened.groupBy(*key).agg(F.count_if(attestation.folded(F.col("hash"), F.col("leaf"), F.col("siblings"), DEPTH) == F.col("root")).alias("opened"), F.count("*").alias("n_leaves"))


_FOLD = ", ".join(
    f"o{d} AS (SELECT a.client_id, a.block, a.leaf, sha256(CASE WHEN (a.leaf >> {d - 1}) % 2 = 0 THEN a.h || b.h ELSE b.h || a.h END) AS h FROM {'(SELECT *, pos AS leaf FROM lf)' if d == 1 else f'o{d - 1}'} AS a JOIN {'lf' if d == 1 else f'm{d - 1}'} AS b ON a.client_id = b.client_id AND a.block = b.block AND b.pos = xor(a.leaf >> {d - 1}, 1))"
    for d in range(1, DEPTH + 1)
)
SQL_OPENING = f"{TEL}, {_QR}, {_LEAF}, {_UP}, {_FOLD} SELECT o.client_id, o.block, count(*) FILTER (o.h = m.h) AS opened, count(*) AS n_leaves FROM o{DEPTH} AS o JOIN m{DEPTH} AS m ON m.client_id = o.client_id AND m.block = o.block GROUP BY ALL"


def hypergeometric_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each client and sample size: the chance to meet a violating row, exactly and as 1 - (1 - share)^k."""
    c = _counted(spark, sf_dir).groupBy("client_id").agg(F.count("*").alias("n"), F.count_if(F.col("v") > 0).alias("bad"))
    c = c.withColumn("k", F.explode(F.array(*map(F.lit, (8, 16, 32, 64)))))
    return c.select("client_id", "k", tidy(1 - miss_probability(F.col("n"), F.col("bad"), F.col("k"))).alias("detected"), tidy(1 - F.pow(1 - F.col("bad") / F.col("n"), F.col("k"))).alias("approximate"))


SQL_HYPER = f"""{TEL}, {_QR}, c AS (SELECT client_id, count(*) AS n, count(*) FILTER (v > 0) AS bad FROM vu GROUP BY 1), e AS (SELECT c.*, k FROM c, (VALUES (8), (16), (32), (64)) AS v(k)), m AS (SELECT client_id, k, product(greatest(n - bad - i, 0)::DOUBLE / (n - i)) AS miss FROM e, range(0, 64) AS r(i) WHERE i < least(k, n) GROUP BY ALL)
SELECT e.client_id, e.k, round(1 - miss, 6) + 0.0 AS detected, round(1 - pow(1 - bad / n, e.k), 6) + 0.0 AS approximate FROM e JOIN m USING (client_id, k)"""


def damage_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.removal(views.cells(spark, sf_dir), 0.0).select("defence", "n", tidy(F.col("removal"), 4).alias("removal"))


SQL_REMOVAL = f"{CELLS}, {_PIV} SELECT defence, count(*) AS n, round(1 - sum(reference - gated) / sum(reference - naive), 4) + 0.0 AS removal FROM pv WHERE reference - naive >= 0 GROUP BY 1"


def rule_mode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rule_mode(views.cells(spark, sf_dir)).select("defence", "mode", "n", tidy(F.col("mean")).alias("mean"), tidy(F.col("sd")).alias("sd"))


SQL_RULE_MODE = f"{CELLS} SELECT defence, mode, count(*) AS n, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS sd FROM cells GROUP BY ALL"


def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.sign_test(views.cells(spark, sf_dir))
    return s.withColumn("p", tidy(F.col("p")))


SQL_SIGN = f"""{CELLS}, {_PIV}, s AS (SELECT defence, count(*) FILTER (gated > naive) AS better, count(*) FILTER (gated < naive) AS worse, count(*) FILTER (gated = naive) AS tied FROM pv GROUP BY 1)
SELECT defence, better, worse, tied, (SELECT round(sum(factorial((better + worse)::INTEGER)::DOUBLE / factorial(i::INTEGER)::DOUBLE / factorial((better + worse - i)::INTEGER)::DOUBLE) / pow(2, better + worse), 6) FROM range(0, 100) AS r(i) WHERE i >= better AND i <= better + worse) AS p FROM s"""


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stats.bootstrap(views.cells(spark, sf_dir), ["defence", "mode"], "f1", 2000)
    return b.select("defence", "mode", tidy(F.col("low")).alias("low"), tidy(F.col("high")).alias("high"))


SQL_BOOTSTRAP = f"""{CELLS}, v AS (SELECT defence, mode, list(f1 ORDER BY f1) AS vs FROM cells GROUP BY ALL),
e AS (SELECT defence, mode, d, avg(vs[floor((('0x' || substr(md5('0/' || d || '/' || i), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0 * len(vs))::INTEGER + 1]) AS m FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM v WHERE len(vs) >= 2), range(0, 2000) AS r(d) GROUP BY ALL),
q AS (SELECT defence, mode, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM e GROUP BY ALL)
SELECT defence, mode, round(low, 6) AS low, round(high, 6) AS high FROM v LEFT JOIN q USING (defence, mode)"""


def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = stats.wilcoxon_less(stats.by_mode(views.cells(spark, sf_dir)), ["defence"], "naive", "gated")
    return w.select("defence", "n", "w", tidy(F.col("p")).alias("p"))


# every choice of signs is a number of n bits
SQL_WILCOXON = f"""{CELLS}, {_PIV}, d AS (SELECT defence, naive - gated AS d FROM pv WHERE naive - gated <> 0),
r AS (SELECT defence, d, 2 * rank() OVER (PARTITION BY defence ORDER BY abs(d)) + count(*) OVER (PARTITION BY defence, abs(d)) - 1 AS r, row_number() OVER (PARTITION BY defence ORDER BY abs(d)) - 1 AS i, count(*) OVER (PARTITION BY defence) AS n FROM d),
w AS (SELECT defence, any_value(n) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w FROM r GROUP BY 1),
s AS (SELECT r.defence, x, sum(CASE WHEN (x >> i) % 2 = 1 THEN r ELSE 0 END) AS s FROM r, range(0, 4096) AS t(x) WHERE x < (1 << n) GROUP BY ALL),
p AS (SELECT defence, count(*) FILTER (s <= w) / count(*) AS p FROM s JOIN w USING (defence) GROUP BY 1)
SELECT defence, coalesce(n, 0) AS n, coalesce(w, 0) / 2 AS w, round(coalesce(p, 1), 6) AS p FROM (SELECT DISTINCT defence FROM pv) LEFT JOIN w USING (defence) LEFT JOIN p USING (defence)"""


def trust_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust by likeness to the server's update that clients 0, 3, 6, ... get: its mean in each round, then over the rounds, beside the others'."""
    u = views.round_updates(spark, sf_dir).withColumn("client_id", F.struct("round", "client_id"))
    w = aggregation.fltrust_weights(u, views.server_update(spark, sf_dir)).select("client_id.*", "trust")
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("trust"))), F.lit(0.0))
    bad = F.col("client_id") % 3 == 0
    r = w.groupBy("round").agg(mean(bad).alias("m"), mean(~bad).alias("h"))
    return r.agg(F.count("*").alias("n_rounds"), tidy(F.avg("m"), 5).alias("malicious_trust"), tidy(F.avg("h"), 5).alias("honest_trust"))


SQL_TRUST = f"""WITH {views.SQL_UPDATES}, rnd AS (SELECT vec_id % 5 AS round, client_id, dim, avg(v) AS value FROM long GROUP BY ALL),
t AS (SELECT round, client_id, greatest(sum(u.value * s.value) / (sqrt(sum(u.value * u.value)) * sqrt(sum(s.value * s.value)) + 1e-12), 0) AS trust FROM rnd AS u JOIN srv AS s USING (dim) GROUP BY ALL),
m AS (SELECT round, coalesce(avg(trust) FILTER (client_id % 3 = 0), 0) AS m, coalesce(avg(trust) FILTER (client_id % 3 <> 0), 0) AS h FROM t GROUP BY 1)
SELECT count(*) AS n_rounds, round(avg(m), 5) + 0.0 AS malicious_trust, round(avg(h), 5) + 0.0 AS honest_trust FROM m"""

def integer_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each client: rows, rules that apply and that are violated over its rows, and how many of these answers the integer and the decimal model do not share."""
    from dataclasses import replace

    sized = [replace(r, eps=e) for r, e in zip(RULES, EPS, strict=True)]
    c = _counted(spark, sf_dir)
    long = lambda answers: c.select("client_id", "row_id", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), a.alias("applies"), v.alias("violates")) for r, (a, v) in zip(sized, answers, strict=True)])).alias("x")).select("client_id", "row_id", "x.*")
    first = long([(F.coalesce(fixedpoint.integer_applies(q), F.lit(False)), F.coalesce(fixedpoint.integer_violates(q), F.lit(False))) for q in _fixed()])
    second = long(fixedpoint.decimal_model(c, sized))
    apart = stats.two_way(first, second).groupBy("client_id").agg(F.count_if(F.col("side") == "a").alias("integer_only"), F.count_if(F.col("side") == "b").alias("decimal_only"))
    n = first.groupBy("client_id").agg(F.countDistinct("row_id").alias("n_rows"), F.count_if("applies").alias("n_applies"), F.count_if("violates").alias("n_violates"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return n.join(apart, "client_id", "left").select("client_id", "n_rows", "n_applies", "n_violates", zero("integer_only"), zero("decimal_only"))


SQL_CROSS = f"{TEL}, {_QR} SELECT client_id, count(*) AS n_rows, sum(2 - u)::BIGINT AS n_applies, sum(v)::BIGINT AS n_violates, 0::BIGINT AS integer_only, 0::BIGINT AS decimal_only FROM vu GROUP BY 1"


def _result_tree(t: DataFrame) -> DataFrame:
    """One JSON document over the record: for each client its rows, its mean value and its rows by status."""
    c = t.groupBy("client_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), *[F.count_if(F.col("status") == i).alias(f"s{i}") for i in range(3)])
    entry = F.struct(F.concat(F.lit("c"), F.col("client_id").cast("string")).alias("k"), F.struct("n", F.struct("mean").alias("value"), F.array("s0", "s1", "s2").alias("by_status")).alias("v"))
    return c.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("j"))  # an entry a client


def result_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two results, kept as JSON, differ: the whole record's and that of its rows without attacks."""
    t = views.telemetry(spark, sf_dir)
    a, b = (trees.flattened(_result_tree(x), [], "j") for x in (t, t.filter("att_flag = 0")))
    d = stats.tree_diff(a, b)
    return d.select("path", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))


def _leaf_sql(name: str, where: str) -> str:
    parts = ["'.n' AS leaf, count(*)::DOUBLE AS v", "'.value.mean', round(avg(value), 6)", *[f"'.by_status[{i}]', count(*) FILTER (status = {i})::DOUBLE" for i in range(3)]]
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT '$.c' || client_id || {p.replace(' AS leaf', ' AS path', 1)} FROM tel WHERE {where} GROUP BY client_id" for p in parts) + ")"


SQL_DIFF = f"{TEL}, {_leaf_sql('wa', 'true')}, {_leaf_sql('wb', 'att_flag = 0')} SELECT coalesce(wa.path, wb.path) AS path, wa.v AS a, wb.v AS b FROM wa FULL OUTER JOIN wb ON wa.path = wb.path WHERE coalesce(abs(wa.v - wb.v) > 1e-9, true)"


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each client: attack rows, and those left when a seeded 40 % of them are called normal."""
    t = views.telemetry(spark, sf_dir)
    d = record.relabel(t.withColumn("was", F.col("att_flag")), "att_flag", 0.4, 13, "event_id")
    return d.groupBy("client_id").agg(F.sum("was").alias("n_before"), F.sum("att_flag").alias("n_after"))


SQL_RELABEL = f"{TEL} SELECT client_id, sum(att_flag)::BIGINT AS n_before, (count(*) FILTER (att_flag = 1 AND {record_plans.UNIT.format("'13/' || event_id")} >= 0.4))::BIGINT AS n_after FROM tel GROUP BY 1"


QUERIES = {
    "threshold": (threshold, SQL_THRESHOLD),
    "detection_report": (detection_report, SQL_REPORT),
    "f1_best": (f1_best, SQL_F1),
    "auc_pr": (auc_pr, SQL_AUC),
    "detection_delay": (detection_delay, SQL_DELAY),
    "overlap_coefficient": (overlap_coefficient, SQL_OVERLAP),
    "attack_success": (attack_success, SQL_SUCCESS),
    "quantised_residual": (quantised_residual, SQL_QUANTISED),
    "integer_verdict": (integer_verdict, SQL_INTEGER),
    "fidelity": (fidelity, SQL_FIDELITY),
    "merkle_root": (merkle_root, SQL_ROOT),
    "challenge_indices": (challenge_indices, SQL_CHALLENGE),
    "sample_budget": (sample_budget, SQL_BUDGET),
    "opening_check": (opening_check, SQL_OPENING),
    "hypergeometric_detection": (hypergeometric_detection, SQL_HYPER),
    "damage_removal": (damage_removal, SQL_REMOVAL),
    "rule_mode_stats": (rule_mode_stats, SQL_RULE_MODE),
    "sign_test": (sign_test, SQL_SIGN),
    "bootstrap_ci": (bootstrap_ci, SQL_BOOTSTRAP),
    "wilcoxon": (wilcoxon, SQL_WILCOXON),
    "trust_summary": (trust_summary, SQL_TRUST),
    "integer_cross_check": (integer_cross_check, SQL_CROSS),
    "result_diff": (result_diff, SQL_DIFF),
    "relabelled": (relabelled, SQL_RELABEL),
}
