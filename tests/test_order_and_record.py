"""Numbering, blocks, segments and rewriting against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import order, record


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(k, i + 1, rng.choice([None, 0.5, 1.5, 2.5]), int(rng.random() < 0.4)) for k in (0, 1) for i in range(150)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k int, row_id long, v double, flag int").repartition(5)


def test_numbered_over_many_buckets(spark):
    d = spark.sql("SELECT id, timestampadd(HOUR, CAST(id * 7 % 100 AS INT), timestamp '2024-01-01') AS ts, id % 3 AS k FROM range(100)")
    got = sorted((r.k, r.row_id, r.ts, r.id) for r in order.numbered(d, ["k"], "ts", ["id"]).collect())
    assert [g[1] for g in got] == [*range(1, 35), *range(1, 34), *range(1, 34)]
    assert got == sorted(got, key=lambda g: (g[0], g[2], g[3]))


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_previous_across_blocks(df, rows, block):
    got = {(r.k, r.row_id): (r.prev_v, r.has_prev) for r in order.with_previous(df, ["k"], ["v"], block=block).collect()}
    by = {(k, i): v for k, i, v, _ in rows}
    assert got == {(k, i): (by.get((k, i - 1)), i > 1) for k, i in by}


@pytest.mark.parametrize("block", [3, 50, 1000])
def test_fill_across_blocks(df, rows, block):
    got = {(r.k, r.row_id): r.f for r in order.filled(df, ["k"], "v", "f", block=block).collect()}
    for k in (0, 1):
        vs = [v for kk, _, v, _ in rows if kk == k]
        for i in range(len(vs)):
            want = next((v for v in reversed(vs[: i + 1]) if v is not None), next((v for v in vs[i:] if v is not None), None))
            assert got[k, i + 1] == want


@pytest.mark.parametrize("block", [2, 9, 1000])
def test_islands_across_blocks(df, rows, block):
    got = sorted((r.k, r.seg_id, r.start_row, r.n_rows) for r in order.islands(df, ["k"], "flag", block=block).collect())
    want = []
    for k in (0, 1):
        f, n, i = [x for kk, _, _, x in rows if kk == k], 0, 0
        while i < len(f):
            if f[i]:
                j = i
                while j < len(f) and f[j]:
                    j += 1
                n += 1
                want.append((k, n, i + 1, j - i))
                i = j
            else:
                i += 1
    assert got == want


@pytest.mark.parametrize("q", [0.0, 0.3, 0.995, 1.0])
def test_quantile_is_numpys(spark, q):
    vs = np.random.default_rng(1).normal(size=997).round(2).tolist() + [None]
    d = spark.createDataFrame([(v,) for v in vs], "v double")
    assert order.exact_quantile(d, [], "v", q, "q").first().q == pytest.approx(np.quantile(vs[:-1], q), rel=1e-12)


def test_quantile_of_equal_values(spark):
    assert order.exact_quantile(spark.createDataFrame([(2.0,)] * 5, "v double"), [], "v", 0.5, "q").first().q == 2.0


def test_windows(df):
    w = record.windows(df.fillna(0.0), ["k"], ["v", "row_id"], "flag", 10, 5)
    got = w.filter("k = 0").orderBy("window_id").collect()
    assert len(got) == (150 - 10) // 5 + 1 and all(len(r.x) == 20 for r in got)
    assert got[2].x[1] == 11.0


def test_short_record_has_no_window(spark):
    assert record.windows(spark.createDataFrame([(1, 1, 0.0, 0)], "k int, row_id long, v double, flag int"), ["k"], ["v"], "flag", 10).count() == 0


@pytest.mark.parametrize("kind,options", [("channel_roll", {"key": ["k"], "channels": ["v"], "shift": 7}), ("within_regime_permutation", {"key": ["k"], "regime": "flag", "channels": ["v"], "seed": 1}), ("regime_splicing", {"key": ["k"], "segments": 12, "seed": 1}), ("splice_only", {})])
def test_fabrications_keep_the_values(df, kind, options):
    values = lambda d: sorted(map(str, [(r.k, r.v) for r in d.collect()]))
    out = record.fabricate(df, kind, **options)
    assert values(out) == values(df) and sorted(out.columns) == sorted(df.columns)
    assert sorted((r.k, r.row_id) for r in out.collect()) == sorted((r.k, r.row_id) for r in df.collect())


def test_unknown_fabrication(df):
    with pytest.raises(KeyError):
        record.fabricate(df, "none")


def test_roll_is_circular(df, rows):
    got = {(r.k, r.row_id): r.v for r in record.roll(df, ["k"], ["v"], 7).collect()}
    by = {(k, i): v for k, i, v, _ in rows}
    assert all(got[k, i] == by[k, (i - 1 - 7) % 150 + 1] for k, i in by)


def test_later_splice_wins(spark):
    d = spark.createDataFrame([(0, i, float(i)) for i in range(1, 11)], "k int, row_id long, v double")
    pieces = spark.createDataFrame([(0, 1, 3, 8, 3), (0, 2, 4, 1, 1)], "k int, seq int, at long, from_row long, n_rows long")
    got = [(r.v, r.spliced) for r in record.splice(d, ["k"], pieces, d, ["v"]).orderBy("row_id").collect()]
    assert [x for x, _ in got] == [1, 2, 8, 1, 10, 6, 7, 8, 9, 10] and [i for i, (_, s) in enumerate(got) if s] == [2, 3, 4]


def test_budget_cuts_the_last_segment(spark):
    seg = spark.createDataFrame([(0, i, 10 * i, 4) for i in range(1, 6)], "k int, seg_id long, start_row long, n_rows long")
    got = record.budgeted(seg, ["k"], 10, 1).collect()
    assert sum(r.n_rows for r in got) == 10 and len(got) == 3


def test_even_shards_differ_by_one(spark):
    d = spark.range(103).withColumn("n", F.lit(103))
    n = [r["count"] for r in record.even_shards(d, 10, F.col("n"), F.rand(3), "id").groupBy("client_id").count().collect()]
    assert sorted(n) == [10] * 7 + [11] * 3


def test_constant_channel_has_unit_scale(spark):
    d = spark.createDataFrame([(1.0, float(i)) for i in range(100)], "a double, b double")
    s = record.scaler(d, ["a", "b"])
    assert s.first().s_a == 1.0
    z = record.standardised(spark.createDataFrame([(2.0, 0.0)], "a double, b double"), s, ["a"]).first()
    assert z.z_a == 1.0


def test_interval_labels(spark):
    d = spark.range(1, 3001).select(F.col("id").alias("row_id"))
    sheet = spark.createDataFrame([(2, 4), (1000, 2100), (7, 7)], "start long, stop long")
    got = {r.row_id for r in record.interval_labels(d, sheet).filter("label = 1").collect()}
    assert got == {2, 3, *range(1000, 2100)}


def test_catalog_roles(spark):
    d = spark.createDataFrame([(float(i), i % 3, i % 2, i % 9) for i in range(50)], "L_T1 double, x int, S_P int, y int")
    got = {r.channel: r.role for r in record.channel_catalog(d).collect()}
    assert got == {"L_T1": "continuous", "x": "discrete", "S_P": "discrete", "y": "continuous"}


def test_regimes_cover_all_rows(df):
    got = record.regimes(df.fillna(0.0), ["v", "row_id"], k=3)
    assert got.count() == df.count() and got.select("regime").distinct().count() == 3


@pytest.mark.parametrize("kind", ["outlier", "ties", "heavy tail"])
def test_quantiles_of_awkward_values(spark, kind):
    """More values than lie in the bracket: exact, and the ranked rows are few."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=100_000)
    if kind == "outlier":
        v[7] = 1e12
    elif kind == "ties":
        v[: len(v) // 2] = 0.25
    else:
        v = np.exp(8 * v)
    d = spark.createDataFrame([(float(x),) for x in v], "v double")
    for q in (0.0, 0.3, 0.5, 0.995, 1.0):
        got = order.exact_quantile(d, [], "v", q, "q").first().q
        assert got == pytest.approx(float(np.quantile(v, q)), rel=1e-12)


def joins(df) -> int:
    """How often a query's plan joins."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.mark.parametrize(("rows_", "step"), [(4, 2), (5, 3), (6, 6)])
def test_overlapping_batches_are_found_without_a_join(df, rows_, step):
    d = record.overlapping(df.select("k", "row_id"), rows_, step)
    assert joins(d) == 0
    got = {(r.k, r.batch_id): sorted(r.ids) for r in d.groupBy("k", "batch_id").agg(F.collect_list("row_id").alias("ids")).collect() if len(r.ids) == rows_}
    assert got == {(k, b): list(range(b * step + 1, b * step + rows_ + 1)) for k in (0, 1) for b in range((150 - rows_) // step + 1)}


def test_batches_are_not_spread_over_single_rows(df, spark):
    starts = spark.createDataFrame([(0, 0, 1), (0, 1, 4), (1, 0, 8), (1, 1, 144), (1, 2, 149)], "k int, batch_id int, start long")
    d = record.batches(df.select("k", "row_id", F.col("row_id").alias("was")), ["k"], starts, 7)
    got = sorted((r.k, r.batch_id, r.row_id, r.was) for r in d.collect())
    assert got == sorted((k, b, i + 1, s + i) for k, b, s in ((0, 0, 1), (0, 1, 4), (1, 0, 8), (1, 1, 144), (1, 2, 149)) for i in range(7) if s + i <= 150)
    each = starts.select(F.explode(F.sequence(F.floor((F.col("start") - 1) / 7), F.floor((F.col("start") + 5) / 7)))).count()
    assert each <= 2 * starts.count() and "Generate explode(sequence(FLOOR" in d._jdf.queryExecution().optimizedPlan().toString()


def test_honest_verdicts_join_no_windows(spark, data):
    from tidegate.plans import evaluation, studies

    assert joins(studies.honest_verdicts(spark, data)) == joins(evaluation._counted(spark, data))


def test_honest_windows_join_no_windows(spark, data):
    from tidegate.plans import evaluation, studies

    assert joins(studies.honest_windows(spark, data)) == joins(evaluation._counted(spark, data))


def test_opening_check_gathers_a_tree_without_joins(spark, data):
    from tidegate.plans import evaluation

    assert joins(evaluation.opening_check(spark, data)) == joins(evaluation._counted(spark, data))


def test_budget_table_ranks_no_copies_of_rows(spark, data):
    from tidegate.plans import evaluation, studies

    windows = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows(studies.budget_table(spark, data)) == windows(evaluation._counted(spark, data))


def test_balances_order_the_record_once(spark, monkeypatch):
    from tidegate.operators import mining

    kept = []
    monkeypatch.setattr(mining, "written", lambda d: kept.append(d.columns) or d)
    d = spark.range(1, 60).selectExpr("0 AS k", "id AS row_id", "CAST(id * id AS DOUBLE) AS level", "2.0 * id - 1 AS flow")
    found = mining.balances(d, ["k"], ["level"], ["flow"])
    assert len(found) == 1 and abs(found[0].terms["flow"] - 1) < 0.01 and kept == [["level", "flow", "prev_level"]]
