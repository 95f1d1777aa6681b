"""Readers on small files, resumable cells, and the streaming gate."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegate.sources import plants, records, results
from tidegate.streaming import gate


def test_inline_labels(spark, tmp_path):
    rows = "\n".join(f" 28/12/2015 10:00:{i % 60:02d} AM, {i / 10},{i * 1.5}, {1 + i % 2},{'A ttack' if i >= 180 else 'Normal'}" for i in range(200))
    (tmp_path / "r.csv").write_text(f"Title,,,,\n Timestamp, FIT101,LIT101 ,P101,Normal/Attack\n{rows}\n")
    d = plants.read_inline(spark, str(tmp_path / "r.csv"))
    assert d.columns == ["row_id", "datetime", "FIT101", "LIT101", "P101", "att_flag"]
    got = d.orderBy("row_id").collect()
    assert len(got) == 200 and sum(r.att_flag for r in got) == 20 and got[10].FIT101 == 1.0 and got[0].datetime is not None
    assert [r.att_flag for r in got[-20:]] == [1] * 20
    s = plants.read_inline(spark, str(tmp_path / "r.csv"), skip=50, step=5)
    assert s.count() == 30 and s.filter("row_id = 2").first().FIT101 == 5.5


def test_logged_record_with_a_sheet(spark, tmp_path):
    head = "info\ninfo\ninfo\ninfo\nRow,Date,Time,\\\\S\\1_FIT_001_PV,\\\\S\\1_P_001_STATUS,\\\\S\\LEAK_DIFF_PRESSURE,\\\\S\\EMPTY\n"
    values = ["", "1.5", "", "2.5", ""]
    body = "".join(f"{i + 1},10/9/2017,6:00:0{i}.000 PM,{v},1,7,\n" for i, v in enumerate(values))
    (tmp_path / "w.csv").write_text(head + body)
    sheet = spark.createDataFrame([(1, "1947-10-09", "18:00.01", "18:00:03"), (2, None, "bad", "x")], "position int, date string, start_time string, end_time string")
    d = plants.read_logged(spark, str(tmp_path / "w.csv"), plants.interval_rows(sheet)).orderBy("row_id").collect()
    assert set(d[0].asDict()) == {"row_id", "datetime", "1_FIT_001_PV", "1_P_001_STATUS", "att_flag"}
    assert [r.att_flag for r in d] == [0, 1, 1, 0, 0]
    assert [r["1_FIT_001_PV"] for r in d] == [1.5, 1.5, 1.5, 2.5, 2.5]


def test_flags(spark, tmp_path):
    (tmp_path / "b.csv").write_text("DATETIME, L_T1, ATT_FLAG\n06/01/14 00,1.0,-999\n06/01/14 01,2.0,1\n06/01/14 02,x,0\n")
    d = plants.read_flagged(spark, str(tmp_path / "b.csv")).orderBy("row_id").collect()
    assert [(r.datetime, r.L_T1, r.att_flag) for r in d] == [("06/01/14 00", 1.0, 0), ("06/01/14 01", 2.0, 1), ("06/01/14 02", None, 0)]


def test_unlabelled(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.csv").write_text("time,x,c,attack_P1\n" + "".join(f"t,{i},3,0\n" for i in range(10)))
    d = plants.read_unlabelled(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], most=5)
    assert d.columns == ["row_id", "x"] and [r.x for r in d.orderBy("row_id").collect()] == [0, 4, 8, 2, 6]


def test_files_are_ranked(spark, tmp_path):
    names = ["d/List_of_attacks.xlsx", "d/Plant_Dataset_Normal_v0.csv", "d/Plant_Dataset_Normal_v1.xlsx", "d/Plant_Dataset_Normal_v1.csv", "d/deep/x_attack.csv", "d/~$x_attack.csv", "d/notes.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    found = records.find(spark, str(tmp_path), "inline")
    assert {k: v.rsplit("/d/")[-1] for k, v in found.items()} == {"normal": "Plant_Dataset_Normal_v1.csv", "attack": "deep/x_attack.csv"}
    (tmp_path / "e").mkdir()
    (tmp_path / "e/readme.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        records.find(spark, str(tmp_path / "e"), "inline")
    with pytest.raises(ValueError):
        records.load(spark, str(tmp_path), "other")


def test_records_are_loaded_checked_and_kept(spark, tmp_path):
    line = lambda i, label: f"28/12/2015 10:00:{i % 60:02d} AM,{i},{label}"
    head = "Timestamp,FIT101,Normal/Attack (1)\n"
    (tmp_path / "plant").mkdir()
    (tmp_path / "plant/Dataset_Normal_v1.csv").write_text(head + "\n".join(line(i, "Normal") for i in range(40)))
    (tmp_path / "plant/Dataset_Attack_v0.csv").write_text(head + "\n".join(line(i, "Attack" if i > 30 else "Normal") for i in range(40)))
    normal, attack = records.load(spark, str(tmp_path / "plant"), "inline", skip=10, step=5)
    assert [r.FIT101 for r in normal.orderBy("row_id").collect()] == [10, 15, 20, 25, 30, 35] and attack.filter("att_flag = 1").count() == 1
    again = records.kept(spark, str(tmp_path / "plant"), "inline", str(tmp_path / "store"), 10, 5)
    once = records.kept(spark, str(tmp_path / "plant"), "inline", str(tmp_path / "store"), 10, 5)
    assert again[0].count() == once[0].count() == 6 and len(list((tmp_path / "store").iterdir())) == 2
    (tmp_path / "plant/Dataset_Normal_v2.csv").write_text(head + line(1, "Attack"))
    with pytest.raises(ValueError, match="holds attack rows"):
        records.load(spark, str(tmp_path / "plant"), "inline", 0, 1)


def test_logged_folder(spark, tmp_path):
    preamble = "info\ninfo\nRow,Date,Time,\\\\S\\1_FIT_001_PV,\\\\S\\1_P_001_STATUS\n"
    body = "".join(f"{i + 1},10/9/2017,6:00:0{i}.000 PM,{i},1\n" for i in range(5))
    for n in ("W_14days.csv", "W_attackdata.csv"):
        (tmp_path / n).write_text(preamble + body)
    (tmp_path / "attack_description.csv").write_text("Attacks,,,\nS.No,Date,Start Time,End Time\n1,2017-10-09,18:00:01,18:00:03\n")
    normal, attack = records.load(spark, str(tmp_path), "logged")
    assert normal.agg(F.sum("att_flag")).first()[0] == 0
    assert [r.att_flag for r in attack.orderBy("row_id").collect()] == [0, 1, 1, 0, 0]


def test_manifest(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"abc")
    r = plants.manifest(spark, str(tmp_path)).first()
    assert r.length == 3 and r.sha256.startswith("ba7816bf")


def test_cells_resume(spark, tmp_path):
    path = str(tmp_path / "cells")
    grid = spark.createDataFrame([(s, d, "clean") for s in (0, 1) for d in ("a", "b")], "seed int, defence string, mode string")
    assert results.open_cells(spark, grid, path, {"x": 1}).count() == 4
    results.append(grid.filter("seed = 0").withColumn("f1", F.lit(1.0)), path, {"x": 1})
    assert results.open_cells(spark, grid, path, {"x": 1}).count() == 2
    assert results.open_cells(spark, grid, path, {"x": 2}).count() == 4


def test_streaming_state_matches_batch(spark, data, tmp_path):
    src = tmp_path / "in"
    e = spark.read.parquet(f"{data}/events.parquet").select((F.col("user_id") % 3).alias("client_id"), "event_id", "ts", "value").orderBy("ts").limit(90)
    rows = e.collect()
    for i in range(3):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], e.schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = gate.with_previous(stream, "value").writeStream.format("memory").queryName("stepped").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    assert q.awaitTermination(120)
    got = spark.table("stepped").collect()
    assert len(got) == 90 and sum(r.prev != r.prev or r.prev is None for r in got) == 3


def test_streaming_verdicts(spark, data, tmp_path):
    src = str(tmp_path / "in")
    e = spark.read.parquet(f"{data}/events.parquet").select((F.col("user_id") % 3).alias("key"), F.col("ts").alias("time"), (F.col("value") > 150).alias("violates"))
    e.write.parquet(src)
    q = gate.verdicts(spark.readStream.schema(e.schema).parquet(src), "1 day", "1 minute").writeStream.format("memory").queryName("judged").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    assert q.awaitTermination(120)
    got = {(r.key, r.start): r for r in spark.table("judged").collect()}
    want = {(r.key, r.w.start): r for r in e.groupBy("key", F.window("time", "1 day").alias("w")).agg(F.count("*").alias("n"), F.avg(F.col("violates").cast("double")).alias("f")).collect()}
    assert got and all(got[k].n_rows == want[k].n and abs(got[k].violating_fraction - want[k].f) < 1e-12 and got[k].admitted == (want[k].f <= 0.01) for k in got)
