"""Scenarios: slices, shards, choices, splices and what they refuse."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegate.operators import rules, scenario


@pytest.fixture(scope="module")
def records(spark):
    """A clean record of 1,200 rows and a labelled one of 600 with three attacks; the flow follows the status."""
    flow = F.when(F.col("S_1") == 2, 2.0 + (F.col("row_id") % 7) / 100).otherwise(0.001)
    base = lambda n: spark.range(1, n + 1).select(F.col("id").alias("row_id"), F.when(F.floor(F.col("id") / 20) % 2 == 0, 2).otherwise(1).alias("S_1"), (F.col("id") % 13).cast("double").alias("L_1"), F.lit(0.5).alias("AIT_1"))
    clean = base(1200).withColumn("F_1", flow).withColumn("att_flag", F.lit(0))
    hit = F.when(F.col("row_id").between(50, 69) | F.col("row_id").between(200, 259) | F.col("row_id").between(400, 409), 1).otherwise(0)
    return clean, base(600).withColumn("F_1", F.when(hit == 1, 9.0).otherwise(flow)).withColumn("att_flag", hit)


MINE = scenario.mined_couplings(["S_1"], ["F_1"])
SMALL = scenario.Settings(clients=5, malicious=0.4, least_rows=50, options={"channels": ["S_1"], "shift": 7}, alpha=0.05)


@pytest.fixture(scope="module")
def built(records):
    return scenario.Scenario(*records, SMALL, MINE)


def test_slices_and_features(records, built):
    assert built.channels == ["S_1", "L_1", "F_1"]  # no label, no analyser
    assert {k: v.count() for k, v in built.slices.items()} == {"mining": 360, "validation": 180, "root": 60, "pool": 600}
    assert all(v.agg(F.min("row_id")).first()[0] == 1 for v in built.slices.values())
    assert [r.name for r in built.rules] == ["coupling::S_1~F_1"] and built.rules[0].eps > 0


def test_batches_and_verdicts(built):
    size = {r.client_id: r for r in built.batches.groupBy("client_id", "is_malicious").agg(F.count("*").alias("n"), F.count_if("spliced").alias("s"), F.max("row_id").alias("m")).collect()}
    assert len(size) == 5 and all(r.n == r.m == 120 for r in size.values()) and sum(r.is_malicious for r in size.values()) == 2
    # the target budget is a quarter of a shard; stretches may overlap
    assert all((0 < r.s <= 30) == r.is_malicious for r in size.values())
    assert built.targets.agg(F.sum("n_rows")).first()[0] == 30
    v = {r.client_id: r for r in built.verdicts.collect()}
    assert all(v[i].admitted != size[i].is_malicious for i in size)


def test_training_windows(built):
    count = lambda w: {r.client_id: (r.n, r.d) for r in w.groupBy("client_id").agg(F.count("*").alias("n"), F.countDistinct("window_id").alias("d")).collect()}
    assert count(scenario.windows_of(built, built.batches, 10, ["L_1", "F_1"])) == {i: (111, 111) for i in range(5)}
    drawn = count(scenario.windows_of(built, built.batches, 10, ["L_1", "F_1"], drawn=True))
    assert len(drawn) == 2 and all(n == 111 and d < 111 for n, d in drawn.values())


def test_evaluation_sets(built):
    e = {r.set: r for r in scenario.evaluation_windows(built, 10).groupBy("set").agg(F.count("*").alias("n"), F.sum("label").alias("y"), F.count_if("targeted").alias("t")).collect()}
    assert (e["clean_val"].n, e["clean_val"].y, e["clean_val"].t) == (171, 0, 0)
    assert e["test"].n == 591 and e["test"].y == 29 + 69 + 19 and 0 < e["test"].t < e["test"].y


def test_what_is_refused(records):
    with pytest.raises(ValueError, match="fewer than 500"):
        _ = scenario.Scenario(*records, scenario.Settings(), MINE).shards
    with pytest.raises(ValueError, match="unknown partition"):
        scenario.shards(records[0], 1200, 2, "other", least_rows=10)
    with pytest.raises(KeyError, match="unknown fabrication"):
        scenario.fabricated(records[0], "other", [], 0, {})


def test_random_shards_are_even(records):
    d = scenario.shards(records[0], 1200, 7, "iid", 3, 10)
    got = d.groupBy("client_id").agg(F.count("*").alias("n"), F.max("row_id").alias("m")).collect()
    assert sorted(r.n for r in got) == [171] * 4 + [172] * 3 and all(r.n == r.m for r in got)


def test_every_fabrication(records, built):
    clean, attack = records
    own = built.batches.filter("is_malicious").select("client_id", "row_id", *built.channels)
    for kind in ("channel_roll", "conservation_scaling", "regime_splicing", "splice_only"):
        made = scenario.fabricated(own, kind, built.channels, 1, {})
        assert made.count() == own.count() and made.columns == own.columns
        same = made.exceptAll(own).count() == 0
        assert same == (kind == "splice_only")


def test_no_malicious_clients(records):
    sc = scenario.Scenario(*records, scenario.Settings(clients=5, malicious=0.0, least_rows=50), MINE)
    assert sc.selection.count() == 0 and sc.batches.filter("spliced OR is_malicious").count() == 0
    assert rules.summary(sc.verdicts).first().malicious_admitted_rate is None
