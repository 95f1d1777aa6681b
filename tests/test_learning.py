"""Aggregation rules, training, projection and mining."""

from __future__ import annotations


import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import aggregation as A
from tidegate.operators import attestation, federation, mining, rules, stats


def frame(spark, u):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(u) for j, v in enumerate(row)], "client_id int, dim int, value double")


def vector(d):
    return np.array([r.value for r in d.orderBy("dim").collect()])


@pytest.fixture(scope="module")
def u():
    return np.random.default_rng(0).normal(size=(10, 20))


def test_rules_against_numpy(spark, u):
    d = frame(spark, u)
    assert vector(A.aggregate("fedavg", d)) == pytest.approx(u.mean(axis=0))
    assert vector(A.aggregate("median", d)) == pytest.approx(np.sort(u, axis=0)[4])
    assert vector(A.aggregate("trimmed_mean", d)) == pytest.approx(np.sort(u, axis=0)[2:8].mean(axis=0))
    n = np.linalg.norm(u, axis=1)
    clip = np.sort(n)[4]
    assert vector(A.aggregate("norm_clip", d)) == pytest.approx((u * np.minimum(1, clip / n)[:, None]).mean(axis=0))
    g = u[0] + 0.1
    cos = np.maximum(u @ g / n / np.linalg.norm(g), 0)
    want = (u * (np.linalg.norm(g) / n * cos)[:, None]).sum(axis=0) / cos.sum()
    server = spark.createDataFrame([(j, float(v)) for j, v in enumerate(g)], "dim int, value double")
    assert vector(A.aggregate("fltrust", d, server=server)) == pytest.approx(want)
    d2 = ((u[:, None] - u[None]) ** 2).sum(axis=2)
    scores = [np.sort(np.delete(d2[i], i))[:6].sum() for i in range(10)]
    assert vector(A.aggregate("krum", d, f=2)) == pytest.approx(u[int(np.argmin(scores))])


def test_outlier_is_rejected(spark, u):
    d = frame(spark, np.vstack([u[:1] * 25, u[1:]]))
    for name in ("krum", "trimmed_mean"):
        assert not next(r.accepted for r in A.acceptance(name, d, f=1).collect() if r.client_id == 0)


def test_sybils_lose_weight(spark):
    rng = np.random.default_rng(2)
    twin = rng.normal(size=50)
    d = frame(spark, np.vstack([rng.normal(size=(6, 50)), twin + rng.normal(scale=1e-3, size=(3, 50))]))
    w = {r.client_id: r.weight for r in A.foolsgold_weights(d).collect()}
    assert sum(w.values()) == pytest.approx(1) and np.mean([w[i] for i in (6, 7, 8)]) < np.mean([w[i] for i in range(6)])


def test_attacks(spark, u):
    d, bad = frame(spark, u), F.col("client_id") == 3
    got = lambda x: np.array([r.value for r in x.filter("client_id = 3").orderBy("dim").collect()])
    assert got(A.sign_flip(d, bad)) == pytest.approx(-u[3])
    assert got(A.scaling(d, bad)) == pytest.approx(10 * u[3])
    rest = np.delete(u, 3, axis=0)
    assert got(A.alie(d, bad)) == pytest.approx(rest.mean(axis=0) - 1.5 * rest.std(axis=0, ddof=1))
    put = got(A.min_max(d, bad))
    widest = max(np.linalg.norm(a - b) for a in rest for b in rest)
    assert max(np.linalg.norm(put - a) for a in rest) == pytest.approx(widest)
    assert set(A.UPDATE_ATTACKS) == {"sign_flip", "scaling", "additive_noise", "free_rider", "alie", "min_max"}


def windows_of(spark, x):
    return spark.createDataFrame([(i % 3, i, [float(v) for v in row]) for i, row in enumerate(x)], "client_id long, window_id long, x array<float>")


def test_steps_follow_the_gradient(spark):
    """Two local steps on the moments are two full-batch steps on the windows."""
    x = np.random.default_rng(0).normal(size=(90, 8)).astype(np.float32).astype(float)
    held = federation.moments(windows_of(spark, x), 8, 2)
    start = np.random.default_rng(1).normal(size=7)
    got = {(r.client_id, r.dim): r.value for r in federation.local_updates(held, start.tolist()).collect()}
    for c in range(3):
        f, y, w = np.c_[x[c::3, :6], np.ones(30)], x[c::3, 6], start.copy()
        for _ in range(federation.EPOCHS):
            w += 2 * federation.RATE * f.T @ (y - f @ w) / len(f)
        assert [got[c, i] for i in range(7)] == pytest.approx((w - start).tolist())


def test_rounds_learn_and_resist(spark):
    x = np.random.default_rng(0).normal(size=(300, 8))
    x[:, 6] = 0.7 * x[:, 4] - 0.3 * x[:, 0] + 0.2
    w = windows_of(spark, x)
    held = federation.moments(w, 8, 2)
    error = lambda p: federation.score(w, p, ["window_id"], 2).agg(F.avg("score")).first()[0]
    flip = lambda u: A.scaling(A.sign_flip(u, F.col("client_id") == 1), F.col("client_id") == 1)
    plain = error([0.0] * 7)
    assert error(federation.run_rounds(held, 8)) < 0.2 * plain
    assert error(federation.run_rounds(held, 8, "median", flip)) < 0.2 * plain < error(federation.run_rounds(held, 8, "fedavg", flip))


def plant(n, seed):
    """A small record of three tanks whose first pump follows its status."""
    rng = np.random.default_rng(seed)
    on = (np.arange(n) // 50 % 2).astype(int)
    f = np.stack([2.2 * on + 0.02 * rng.normal(size=n) * on, np.abs(2 + 0.3 * rng.normal(size=n)), np.abs(2 + 0.3 * rng.normal(size=n))])
    level = 3 + np.cumsum((f[0] - f[1]) / 12.0) + 0.004 * rng.normal(size=n)
    return [(1, i + 1, float(level[i]), *map(float, f[:, i]), int(on[i])) for i in range(n)]


def test_miners_find_the_plant(spark):
    d = spark.createDataFrame(plant(2000, 2), "site long, row_id long, L_T1 double, F_PU1 double, F_PU2 double, F_PU3 double, S_PU1 int")
    b = mining.balances(d, ["site"], ["L_T1"], ["F_PU1", "F_PU2"])[0]
    assert b.r2 > 0.98 and b.terms["F_PU1"] == pytest.approx(1 / 12, rel=0.05) and b.terms["F_PU2"] == pytest.approx(-1 / 12, rel=0.05)
    c = mining.couplings(mining.coupling_table(d, ["site"], ["S_PU1"], ["F_PU1", "F_PU3"]), one_each=True)
    assert [x.name for x in c] == ["coupling::S_PU1~F_PU1"] and c[0].params["nominal"] == pytest.approx(2.2, rel=0.03)
    assert len(mining.build([b], c, limit=1)) == 1


def test_settings_choose_rules(spark):
    d = spark.createDataFrame(plant(2000, 3), "site long, row_id long, L_T1 double, F_PU1 double, F_PU2 double, F_PU3 double, S_PU1 int")
    chosen, report = mining.mined(d, ["site"], ["L_T1"], ["F_PU1", "F_PU2"], ["S_PU1"], "narrow")
    assert [r.kind for r in chosen] == ["coupling", "linear"] and report.filter("used").count() == 2
    assert rules.from_table(rules.as_table(spark, rules.calibrate(mining.with_previous(d, ["site"], ["L_T1", "S_PU1"]), chosen)))[0].eps > 0
    assert mining.mined(d, ["site"], ["L_T1"], ["F_PU1", "F_PU2"], ["S_PU1"], "wide", limit=1)[1].filter("used").count() == 1
    with pytest.raises(KeyError):
        mining.mined(d, ["site"], ["L_T1"], ["F_PU1"], ["S_PU1"], "other")
    with pytest.raises(ValueError, match="unknown kinds"):
        rules.from_table(spark.createDataFrame([("x", "odd", "{}", 1.0)], rules.RULE))


def test_sign_and_rank_tests(spark):
    rows = [(s, "a", m, {"reference": 1.0, "naive": 0.1 * s, "gated": 0.1 * s + 0.05 * (1 if s < 9 else -1)}[m]) for s in range(1, 11) for m in ("reference", "naive", "gated")]
    cells = spark.createDataFrame(rows, "seed int, defence string, mode string, f1 double")
    s = stats.sign_test(cells).first()
    assert (s.better, s.worse, s.tied) == (8, 2, 0) and s.p == pytest.approx(56 / 1024)
    w = stats.wilcoxon_less(stats.by_mode(cells), ["defence"], "naive", "gated").first()
    assert w.n == 10 and 0 < w.p < 0.2
    d = spark.createDataFrame([("x", 0.0, v) for v in (1.0, 2.0, 3.0)] + [("y", 1.0, 1.0), ("z", 2.0, 1.0), ("z", 1.0, 2.0)], "k string, a double, b double")
    got = {r.k: (r.n, r.w, r.p) for r in stats.wilcoxon_less(d, ["k"], "a", "b").collect()}
    assert got == {"x": (3, 0.0, 1 / 8), "y": (0, 0.0, 1.0), "z": (2, 1.5, 0.75)}


def test_bootstrap_needs_two(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, v double")
    got = {r.k: (r.low, r.high) for r in stats.bootstrap(d, ["k"], "v", 500).collect()}
    assert got["b"][0] == 1.0 and got["b"][1] == 3.0 and (got["a"][0] is None or np.isnan(got["a"][0]))


def test_noise_does_not_depend_on_partitions(spark, u):
    d, bad = frame(spark, u), F.col("client_id") == 3
    rows = lambda x: {(r.client_id, r.dim): r.value for r in A.additive_noise(x, bad).collect()}
    assert rows(d.repartition(7)) == pytest.approx(rows(d.coalesce(1)))


def test_challenges_need_enough_tries(spark):
    d = spark.createDataFrame([(1, "ab", 7)], "b int, root string, nonce int")
    assert attestation.challenges(d, ["b"], 64, 8, 64).count() == 8
    with pytest.raises(Exception, match="too few tries"):
        attestation.challenges(d, ["b"], 64, 8, 3).collect()


def test_merkle_paths(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = [h(str(i)) for i in range(8)]
    level = leaves
    while len(level) > 1:
        level = [h(level[i] + level[i + 1]) for i in range(0, len(level), 2)]
    d = spark.createDataFrame([(0, i, x) for i, x in enumerate(leaves)], "b int, pos int, hash string")
    assert attestation.roots(d, ["b"], 3).first().root == level[0]
    nodes = {(r.level, r.pos): r.hash for r in attestation.levels(d, ["b"], 3).collect()}
    assert nodes[3, 0] == level[0]
    path = [nodes[0, 4], nodes[1, 3], nodes[2, 0]]
    one = spark.createDataFrame([(leaves[5], 5, path)], "leaf string, pos int, path array<string>")
    assert one.select(attestation.folded(F.col("leaf"), F.col("pos"), F.col("path"), 3).alias("r")).first().r == level[0]
    assert attestation.chunks(18) == (2, 9)
