"""Queries over client updates: aggregation rules, trust and attacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.scalar import tidy
from tidegate.operators import aggregation as A
from tidegate.sources import views

BAD_EVERY = 4
F_BAD, MULTI = 3, 3
UPD = f"WITH {views.SQL_UPDATES}"
PAIRS = "pr AS (SELECT x.client_id AS a, y.client_id AS b, sum((x.value - y.value) * (x.value - y.value)) AS dist2, sum(x.value * y.value) AS dot FROM {0} AS x JOIN {0} AS y ON x.dim = y.dim AND x.client_id <> y.client_id GROUP BY ALL)"


def _shown(d: DataFrame) -> DataFrame:
    return d.select("dim", tidy(F.col("value")).alias("value"))


def _rule(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = views.updates(spark, sf_dir)
        return _shown(A.aggregate(name, u, weights=views.client_weights(spark, sf_dir), f=F_BAD, multi=MULTI, server=views.server_update(spark, sf_dir), h=_summed(spark, sf_dir) if name == "foolsgold" else None))

    return run


def _summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history after the last round: the sums over all rounds."""
    r = views.round_updates(spark, sf_dir)
    return r.groupBy("client_id", "dim").agg(F.sum("value").alias("value"))


_KRUM = f"{PAIRS.format('upd')}, kn AS (SELECT a, dist2, row_number() OVER (PARTITION BY a ORDER BY dist2, b) AS r, (SELECT count(DISTINCT client_id) FROM upd) AS n FROM pr), ks AS (SELECT a AS client_id, sum(dist2) AS score FROM kn WHERE r <= greatest(n - {F_BAD} - 2, 1) GROUP BY 1), kr AS (SELECT client_id, row_number() OVER (ORDER BY score, client_id) AS rank FROM ks)"
_TRIM = "tr AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY value, client_id) AS r, count(*) OVER (PARTITION BY dim) AS n FROM upd)"
_NORM = "nm AS (SELECT client_id, sqrt(sum(value * value)) AS norm FROM upd GROUP BY 1)"
_TRUST = "ft AS (SELECT u.client_id, sum(u.value * s.value) / (sqrt(sum(u.value * u.value)) * sqrt(sum(s.value * s.value)) + 1e-12) AS cosine, sqrt(sum(s.value * s.value)) / (sqrt(sum(u.value * u.value)) + 1e-12) AS factor FROM upd AS u JOIN srv AS s USING (dim) GROUP BY 1)"
_GOLD = f"""rnd AS (SELECT vec_id % 5 AS round, client_id, dim, avg(v) AS value FROM long GROUP BY ALL), hist AS (SELECT client_id, dim, sum(value) AS value FROM rnd GROUP BY ALL), {PAIRS.format('hist')},
hn AS (SELECT client_id, sqrt(sum(value * value)) AS norm FROM hist GROUP BY 1),
cs AS (SELECT a, b, greatest(0.0, least(1.0, dot / (x.norm * y.norm + 1e-12))) AS cs FROM pr JOIN hn AS x ON x.client_id = a JOIN hn AS y ON y.client_id = b),
fv AS (SELECT a, max(cs) AS v FROM cs GROUP BY 1),
fw AS (SELECT cs.a AS client_id, greatest(0.0, least(1.0, 1 - max(CASE WHEN y.v > x.v AND y.v > 1e-12 THEN cs * x.v / y.v ELSE cs END))) AS w FROM cs JOIN fv AS x ON x.a = cs.a JOIN fv AS y ON y.a = cs.b GROUP BY 1),
fx AS (SELECT client_id, greatest(1e-6, least(1.0, CASE WHEN max(w) OVER () = 0 THEN 0 ELSE w / max(w) OVER () END)) AS w FROM fw),
fy AS (SELECT client_id, greatest(0.0, least(1.0, ln(w / (1 - w + 1e-12) + 1e-12) + 0.5)) AS w FROM fx),
fg AS (SELECT client_id, CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () ELSE 1.0 / count(*) OVER () END AS weight FROM fy)"""
SQL_RULES = {
    "fedavg": f"{UPD} SELECT dim, round(sum(value * weight) / sum(weight), 6) + 0.0 AS value FROM upd JOIN wt USING (client_id) GROUP BY dim",
    "krum": f"{UPD}, {_KRUM} SELECT dim, round(avg(value), 6) + 0.0 AS value FROM upd JOIN kr USING (client_id) WHERE rank <= {MULTI} GROUP BY dim",
    "median": f"{UPD} SELECT dim, round(quantile_disc(value, 0.5), 6) + 0.0 AS value FROM upd GROUP BY dim",
    "trimmed_mean": f"{UPD}, {_TRIM} SELECT dim, round(avg(value), 6) + 0.0 AS value FROM tr WHERE floor(n * 0.2) = 0 OR 2 * floor(n * 0.2) >= n OR (r > floor(n * 0.2) AND r <= n - floor(n * 0.2)) GROUP BY dim",
    "norm_clip": f"{UPD}, {_NORM}, c AS (SELECT quantile_disc(norm, 0.5) AS clip FROM nm) SELECT dim, round(avg(value * least(1.0, clip / (norm + 1e-12))), 6) + 0.0 AS value FROM upd JOIN nm USING (client_id), c GROUP BY dim",
    "fltrust": f"{UPD}, {_TRUST} SELECT dim, round(coalesce(sum(value * factor * greatest(cosine, 0)) / nullif(sum(greatest(cosine, 0)), 0), 0), 6) + 0.0 AS value FROM upd JOIN ft USING (client_id) GROUP BY dim",
    "foolsgold": f"{UPD}, {_GOLD} SELECT dim, round(sum(value * weight), 6) + 0.0 AS value FROM upd JOIN fg USING (client_id) GROUP BY dim",
}


def trust_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = views.updates(spark, sf_dir)
    a = A.fltrust_weights(u, views.server_update(spark, sf_dir)).select("client_id", tidy(F.col("trust"), 5).alias("fltrust"))
    b = A.foolsgold_weights(_summed(spark, sf_dir)).select("client_id", tidy(F.col("weight"), 5).alias("foolsgold"))
    return a.join(b, "client_id")


SQL_TRUST = f"{UPD}, {_TRUST}, {_GOLD} SELECT client_id, round(greatest(cosine, 0), 5) + 0.0 AS fltrust, round(weight, 5) + 0.0 AS foolsgold FROM ft JOIN fg USING (client_id)"


def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = views.updates(spark, sf_dir)
    each = [A.acceptance(n, u, f=F_BAD, multi=MULTI, server=views.server_update(spark, sf_dir), h=_summed(spark, sf_dir) if n == "foolsgold" else None).withColumn("defence", F.lit(n)) for n in A.DEFENCES]
    return reduce(DataFrame.unionByName, each)


SQL_ACCEPT = f"""{UPD}, {_KRUM.replace(PAIRS.format('upd') + ',', PAIRS.format('upd').replace('pr AS', 'kp AS') + ',').replace('FROM pr)', 'FROM kp)')}, {_NORM}, {_TRUST}, {_GOLD},
nr AS (SELECT client_id, row_number() OVER (ORDER BY norm, client_id) AS r, count(*) OVER () AS n FROM nm)
SELECT client_id, true AS accepted, d AS defence FROM nm, (VALUES ('fedavg'), ('median'), ('norm_clip')) AS v(d)
UNION ALL SELECT client_id, rank <= {MULTI}, 'krum' FROM kr
UNION ALL SELECT client_id, floor(n * 0.2) = 0 OR (r > floor(n * 0.2) AND r <= n - floor(n * 0.2)), 'trimmed_mean' FROM nr
UNION ALL SELECT client_id, cosine > 0.05, 'fltrust' FROM ft
UNION ALL SELECT client_id, weight > 0.5 / count(*) OVER (), 'foolsgold' FROM fg"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = A.history(views.round_updates(spark, sf_dir))
    return h.groupBy("round", "client_id").agg(tidy(F.sum(F.abs("value")), 5).alias("size"))


SQL_HISTORY = f"{UPD}, rnd AS (SELECT vec_id % 5 AS round, client_id, dim, avg(v) AS value FROM long GROUP BY ALL), h AS (SELECT round, client_id, sum(value) OVER (PARTITION BY client_id, dim ORDER BY round) AS value FROM rnd) SELECT round, client_id, round(sum(abs(value)), 5) AS size FROM h GROUP BY ALL"


def _attack(f, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(views.updates(spark, sf_dir), F.col("client_id") % BAD_EVERY == 1, **options).select("client_id", "dim", tidy(F.col("value"), 5).alias("value"))

    return run


_BAD = "client_id % 4 = 1"
SQL_ATTACKS = {
    "attack_sign_flip": f"{UPD} SELECT client_id, dim, round(CASE WHEN {_BAD} THEN -value ELSE value END, 5) + 0.0 AS value FROM upd",
    "attack_scaling": f"{UPD} SELECT client_id, dim, round(CASE WHEN {_BAD} THEN 10 * value ELSE value END, 5) + 0.0 AS value FROM upd",
    "attack_alie": f"{UPD}, s AS (SELECT dim, avg(value) AS m, stddev_samp(value) AS sd FROM upd WHERE NOT {_BAD} GROUP BY 1) SELECT client_id, dim, round(CASE WHEN {_BAD} THEN m - 1.5 * sd ELSE value END, 5) + 0.0 AS value FROM upd JOIN s USING (dim)",
    "attack_min_max": f"""{UPD}, hon AS (SELECT * FROM upd WHERE NOT {_BAD}), {PAIRS.format('hon')}, mu AS (SELECT dim, avg(value) AS m FROM hon GROUP BY 1), z AS (SELECT sqrt(sum(m * m)) AS n FROM mu), wd AS (SELECT max(dist2) AS d2 FROM pr),
q AS (SELECT client_id, sum((m - value) * (m - value)) AS c, sum((m - value) * m / (n + 1e-12)) AS b FROM hon JOIN mu USING (dim), z GROUP BY 1), t AS (SELECT greatest(min(b + sqrt(greatest(b * b + d2 - c, 0))), 0) AS t FROM q, wd)
SELECT client_id, dim, round(CASE WHEN {_BAD} THEN m - t * m / (n + 1e-12) ELSE value END, 5) + 0.0 AS value FROM upd JOIN mu USING (dim), z, t""",
}

_NORMAL = "sqrt(-2 * ln(1 - {})) * cos(2 * pi() * {})".format(*(f"(('0x' || substr(md5('3/' || client_id || '/' || dim || '/{x}'), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0" for x in "ab"))
SQL_NOISE = {
    n: f"{UPD}, s AS (SELECT stddev_samp(value) AS sd FROM upd WHERE NOT {_BAD}) SELECT client_id, dim, round(CASE WHEN {_BAD} THEN {keep} * value + {size} * sd * {_NORMAL} ELSE value END, 5) + 0.0 AS value FROM upd, s"
    for n, keep, size in (("attack_noise", 1.0, 1.0), ("attack_free_rider", 0.0, 0.01))
}

QUERIES = {
    **{("coordinate_median" if n == "median" else n): (_rule(n), SQL_RULES[n]) for n in A.DEFENCES},
    "trust_weights": (trust_weights, SQL_TRUST),
    "acceptance": (acceptance, SQL_ACCEPT),
    "update_history": (history, SQL_HISTORY),
    "attack_sign_flip": (_attack(A.sign_flip), SQL_ATTACKS["attack_sign_flip"]),
    "attack_scaling": (_attack(A.scaling), SQL_ATTACKS["attack_scaling"]),
    "attack_alie": (_attack(A.alie), SQL_ATTACKS["attack_alie"]),
    "attack_min_max": (_attack(A.min_max), SQL_ATTACKS["attack_min_max"]),
    "attack_noise": (_attack(A.additive_noise, sigma=1.0, seed=3), SQL_NOISE["attack_noise"]),
    "attack_free_rider": (_attack(A.free_rider, jitter=0.01, seed=3), SQL_NOISE["attack_free_rider"]),
}
