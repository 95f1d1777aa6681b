"""The grid of federations: rounds against numpy, resuming, the summary."""

from __future__ import annotations

import numpy as np
import pytest

from tidegate.operators import aggregation, federation, grid
from tidegate.operators.keep import Ledger

D, CLIENTS, RULES = 4, 7, tuple(aggregation.DEFENCES)
MOMENTS = "seed int, mode string, client_id long, is_malicious boolean, n long, a array<array<double>>, b array<double>"


def spd(rng):
    x = rng.normal(size=(30, D))
    return x.T @ x / 30


@pytest.fixture(scope="module")
def data(spark):
    """Moments of two seeds and two modes, and of the server."""
    rng, held, root = np.random.default_rng(4), {}, {}
    for seed in (0, 1):
        root[seed] = (spd(rng), rng.normal(size=D), 20)
        for mode in ("clean", "fabricated"):
            for c in range(CLIENTS):
                b = root[seed][1] + 0.2 * rng.normal(size=D)
                held[seed, mode, c] = (spd(rng), -3 * b if mode == "fabricated" and c < 2 else b, 50 + 10 * c)
    rows = [(s, m, c, m == "fabricated" and c < 2, n, a.tolist(), b.tolist()) for (s, m, c), (a, b, n) in held.items()]
    server = spark.createDataFrame([(s, n, a.tolist(), b.tolist()) for s, (a, b, n) in root.items()], "seed int, n long, a array<array<double>>, b array<double>")
    return held, root, spark.createDataFrame(rows, MOMENTS), server


def step(w, a, b):
    out = w.copy()
    for _ in range(federation.EPOCHS):
        out = out + 2 * federation.RATE * (b - a @ out)
    return out - w


def foolsgold(h):
    """Weights from summed updates, as published."""
    cs = h @ h.T / np.outer(np.linalg.norm(h, axis=1), np.linalg.norm(h, axis=1))
    cs = np.clip(cs - np.eye(len(h)) * 9, 0, 1)
    v = cs.max(axis=1)
    q = np.where((v[None] > v[:, None]) & (v[None] > 1e-12), cs * v[:, None] / np.maximum(v[None], 1e-12), cs)
    w = np.clip(1 - q.max(axis=1), 0, 1)
    w = np.clip(w / w.max(), 1e-6, 1)
    w = np.clip(np.log(w / (1 - w + 1e-12) + 1e-12) + 0.5, 0, 1)
    return w / w.sum() if w.sum() else np.full(len(w), 1 / len(w))


def trained(held, root, seed, mode, rule, rounds):
    w, h = np.zeros(D), np.zeros((CLIENTS, D))
    bad = 2 if mode == "fabricated" else 1
    for _ in range(rounds):
        u = np.stack([step(w, *held[seed, mode, c][:2]) for c in range(CLIENTS)])
        h = h + u
        norm = np.linalg.norm(u, axis=1)
        if rule == "fedavg":
            n = np.array([held[seed, mode, c][2] for c in range(CLIENTS)])
            d = (u * n[:, None]).sum(axis=0) / n.sum()
        elif rule == "krum":
            gap = ((u[:, None] - u[None]) ** 2).sum(axis=2)
            d = u[np.argmin([np.sort(np.delete(gap[i], i))[: max(CLIENTS - bad - 2, 1)].sum() for i in range(CLIENTS)])]
        elif rule == "median":
            d = np.sort(u, axis=0)[(CLIENTS - 1) // 2]
        elif rule == "trimmed_mean":
            d = np.sort(u, axis=0)[1:-1].mean(axis=0)
        elif rule == "norm_clip":
            d = (u * np.minimum(1, np.sort(norm)[(CLIENTS - 1) // 2] / norm)[:, None]).mean(axis=0)
        elif rule == "fltrust":
            g = step(w, *root[seed][:2])
            trust = np.maximum(u @ g / norm / np.linalg.norm(g), 0)
            d = (u * (np.linalg.norm(g) / norm * trust)[:, None]).sum(axis=0) / trust.sum()
        else:
            d = foolsgold(h) @ u
        w = w + d
    return w


def params(df):
    return {(r.seed, r.mode, r.defence): r.w for r in df.collect()}


def test_rounds_of_all_rules_and_resuming(spark, data, tmp_path):
    held, root, moments, server = data
    cells = grid.wanted((0, 1), ("clean", "fabricated"), RULES, spark)
    whole = params(grid.train(moments, server, cells, 2, Ledger(spark, str(tmp_path / "a"), "x")))
    assert len(whole) == 2 * 2 * 7
    for (seed, mode, rule), w in whole.items():
        assert w == pytest.approx(trained(held, root, seed, mode, rule, 2).tolist(), rel=1e-6, abs=1e-9), (seed, mode, rule)
    # killed after the first round, in the middle of writing the second
    ledger = Ledger(spark, str(tmp_path / "b"), "x")
    grid.train(moments, server, cells, 1, ledger)
    spark.range(3).write.parquet(ledger._path("round-00001"))
    before = (tmp_path / "b/x/round-00000/_SUCCESS").stat().st_mtime_ns
    assert params(grid.train(moments, server, cells, 2, ledger)) == whole
    assert (tmp_path / "b/x/round-00000/_SUCCESS").stat().st_mtime_ns == before
    assert ledger.done() >= {"round-00000", "round-00001"} and Ledger(spark, str(tmp_path / "b"), "y").done() == set()
    h = {(r.seed, r.mode, r.defence, r.round): r for r in grid.history(ledger, 2).collect()}
    assert len(h) == 56 and h[0, "fabricated", "krum", 1].malicious_accepted == 0 and h[0, "fabricated", "fedavg", 1].malicious_accepted == 1
    assert h[0, "clean", "median", 0].norm_malicious == 0 < h[0, "clean", "median", 0].norm_mean


def test_unknown_cells(spark):
    with pytest.raises(ValueError, match="unknown"):
        grid.wanted((0,), ("clean", "other"), ("fedavg",), spark)


def test_reports_and_summary(spark):
    rng = np.random.default_rng(0)
    w = {"clean": [1.0, 0.0], "fabricated": [0.0, 0.0]}
    rows, x = [], rng.normal(size=400)
    for i, v in enumerate(x):
        y = v + 0.01 * rng.normal() + (3.0 if i % 10 == 0 else 0.0)
        rows.append((0, "test" if i >= 150 else "clean_val", [float(v), float(y)], int(i % 10 == 0 and i >= 150), i % 20 == 0))
    windows = spark.createDataFrame([r for r in rows if r[1] == "test" or r[2][1] - r[2][0] < 1], "seed int, set string, x array<float>, label int, targeted boolean")
    cells = spark.createDataFrame([(0, m, "fedavg", p) for m, p in w.items()], "seed int, mode string, defence string, w array<double>")
    got = {r.mode: r for r in grid.evaluated(windows, cells, 1, 0.995).collect()}
    clean = [(np.float64(np.float32(r[2][1])) - np.float32(r[2][0])) ** 2 for r in rows if r[1] == "clean_val" and r[2][1] - r[2][0] < 1]
    assert got["clean"].threshold == pytest.approx(np.quantile(clean, 0.995)) and got["clean"].recall == got["clean"].targeted_recall == got["clean"].untargeted_recall == 1
    assert got["fabricated"].f1 < got["clean"].f1
    import duckdb

    table = [(s, d, m, 0.1 * s + 0.02 * i + (0.3 if d == "a" else 0.0) * (m in ("fabricated", "projected")) * -1) for s in range(3) for d in "ab" for i, m in enumerate(grid.MODES)]
    con = duckdb.connect()
    con.execute("CREATE TABLE c (seed INT, defence VARCHAR, mode VARCHAR, f1 DOUBLE)")
    con.executemany("INSERT INTO c VALUES (?, ?, ?, ?)", table)
    sql = """WITH m AS (SELECT defence, avg(f1) FILTER (mode = 'clean') AS c, avg(f1) FILTER (mode = 'fabricated') AS f, avg(f1) FILTER (mode = 'projected') AS p FROM c GROUP BY 1)
    SELECT defence, c - f, c - p, CASE WHEN c - f > 1e-9 THEN 1 - (c - p) / (c - f) END, c - f >= 0.03, coalesce(CASE WHEN c - f > 1e-9 THEN 1 - (c - p) / (c - f) END < 0, false) AND c - f >= 0.01 FROM m ORDER BY 1"""
    s = grid.summary(spark.createDataFrame(table, "seed int, defence string, mode string, f1 double")).orderBy("defence").collect()
    for r, want in zip(s, con.execute(sql).fetchall(), strict=True):
        assert (r.defence, r.damaged, r.helped) == (want[0], want[4], want[5])
        assert [r.damage, r.damage_projected, r.removed] == pytest.approx(list(want[1:4]), nan_ok=True) if want[3] is not None else r.removed is None


def test_one_call_resumes(spark, tmp_path):
    """Rules, modes and a seed in one call over the event record; a second call with more rounds starts from the first one's."""
    from tidegate.plans import grids

    kinds = {"modes": ("honest_only", "fabricated", "gated"), "defences": ("median", "fltrust")}
    first = grids.run(spark, "/root/testdata/sf0.001", str(tmp_path), rounds=1, **kinds)
    one = {(r.mode, r.defence): r for r in first.collect()}
    assert len(one) == 6 and all(0 <= r.f1 <= 1 and 0 <= r.malicious_accepted <= 1 for r in one.values())
    folder = next(p for p in tmp_path.iterdir() if p.name != "log")
    stamps = {p.name: (p / "_SUCCESS").stat().st_mtime_ns for p in folder.iterdir()}
    assert {"moments", "server", "windows", "verdicts", "round-00000"} <= set(stamps)
    grids.run(spark, "/root/testdata/sf0.001", str(tmp_path), rounds=2, **kinds).collect()
    assert all((folder / n / "_SUCCESS").stat().st_mtime_ns == t for n, t in stamps.items()) and (folder / "round-00001").exists()
