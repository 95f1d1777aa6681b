"""The command line's jobs."""

from __future__ import annotations

import pytest

from tidegate.__main__ import main


def test_query(spark, data, tmp_path):
    out = main(["query", "relabelled", "--data", data, "--out", str(tmp_path / "q")])
    assert out.count() == 10 and (tmp_path / "q/_SUCCESS").exists()
    with pytest.raises(SystemExit):
        main(["query", "other", "--data", data])


def test_grid(spark, data, tmp_path):
    s = main(["grid", "--data", data, "--out", str(tmp_path), "--rounds", "1", "--modes", "clean", "fabricated", "--defences", "fedavg"])
    r = s.first()
    assert r.defence == "fedavg" and 0 <= r.fabricated <= 1 and r.gated is None and (tmp_path / "cells/_SUCCESS").exists()


def test_record(spark, tmp_path):
    for n, label in (("Normal_v1", "Normal"), ("Attack_v0", "Attack")):
        (tmp_path / f"Dataset_{n}.csv").write_text("Timestamp,FIT101,Normal/Attack\n" + "\n".join(f"28/12/2015 10:00:{i:02d} AM,{i},{label}" for i in range(20)))
    got = {r.att_flag: r["count"] for r in main(["record", "inline", str(tmp_path), "--out", str(tmp_path / "out"), "--skip", "2", "--step", "1"]).collect()}
    assert got == {0: 18, 1: 20}
