"""The float model beside the integer one reads the previous row as it is recorded."""

from __future__ import annotations

from datetime import datetime

from tidegate.plans import evaluation


def test_previous_value_is_not_quantised(spark, tmp_path):
    # 120.2 - 0.2 is 120 in doubles, which is within eps; 0.2 at a scale of 2^16 is less than 0.2
    rows = [(i, datetime(2024, 1, 1, 0, i), 10, "view", v, '{"k": 0}') for i, v in enumerate((0.2, 120.2))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.rule: (r.disagreements, r.applicability_disagreements) for r in evaluation.fidelity(spark, str(tmp_path)).collect()}
    assert got == {"coupling::status~value": (0, 0), "linear::value": (0, 0)}
