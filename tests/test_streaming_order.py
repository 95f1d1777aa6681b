"""A whole rule set on a stream that comes out of order."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import order, rules
from tidegate.streaming import gate

SET = [replace(rules.coupling("status", "value", 50.0, off=1, on=2, steady=True), eps=60.0), replace(rules.linear("value", {"k": 0.5}, 0.0, diff=True), eps=60.0)]


@pytest.fixture(scope="module")
def rows(spark):
    """Three keys, a row a second, values and statuses that violate at times; the third key stops early."""
    rng = np.random.default_rng(0)
    out = [(k, 1_700_000_000 + 3 * i + k, 10 * i + k, float(rng.integers(0, 150)), float(rng.integers(0, 100)), int(1 + i // 4 % 2)) for i in range(200) for k in range(3) if k < 2 or i < 40]
    return out


def stream_of(spark, folder, parts):
    for i, part in enumerate(parts):
        d = spark.createDataFrame(part, "client_id long, s long, event_id long, value double, k double, status int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        d.coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def ran(df, spark, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    assert q.awaitTermination(240)
    return {(r.key, r.ident): r for r in spark.table(name).collect()}, q


def test_shuffled_rows_are_judged_as_a_table(spark, rows, tmp_path):
    rng = np.random.default_rng(1)
    # each row comes up to a minute late; the last part moves the watermark past all of them
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 60))
    parts = [late[i : i + 80] for i in range(0, len(late), 80)] + [[(0, 1_700_100_000, 10**6, 1.0, 1.0, 1)]]
    stream = gate.judged(gate.in_order(stream_of(spark, str(tmp_path / "in"), parts), ["value", "k", "status"], "2 minutes", "1 hour"), SET)
    got, q = ran(stream, spark, "ordered", tmp_path)
    d = spark.createDataFrame(rows, "client_id long, s long, event_id long, value double, k double, status int")
    d = order.cumulative(d, ["client_id"], F.lit(0), [F.col("s"), F.col("event_id")])
    want = rules.residuals(order.with_previous(d, ["client_id"], rules.looking_back(SET)), SET).withColumn("violates", rules.any_violation(SET)).collect()
    assert len(want) == len(rows) and 0 < sum(r.violates for r in want) < len(want)
    for r in want:
        g = got[r.client_id, r.event_id]
        assert (g.row_id, g.has_prev, g.violates) == (r.row_id, r.has_prev, r.violates)
    assert len(got) == len(rows)


def test_idle_keys_lose_their_state(spark, rows, tmp_path):
    parts = [rows, [(0, 1_700_001_000, 10**6, 1.0, 1.0, 1)], [(0, 1_700_010_000, 10**6 + 1, 1.0, 1.0, 1)], [(0, 1_700_020_000, 10**6 + 2, 1.0, 1.0, 1)], [(2, 1_700_020_001, 10**6 + 3, 1.0, 1.0, 1), (0, 1_700_030_000, 10**6 + 4, 1.0, 1.0, 1)], [(0, 1_700_040_000, 10**6 + 5, 1.0, 1.0, 1)]]
    got, q = ran(gate.in_order(stream_of(spark, str(tmp_path / "in"), parts), ["value", "k", "status"], "1 minute", "10 minutes"), spark, "idle", tmp_path)
    left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(left) == 3 and left[-1] <= 2
    back = got[2, 10**6 + 3]
    assert not back.has_prev and back.row_id == 1  # the key's state had gone
