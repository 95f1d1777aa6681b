"""Queries over projected batches order the record once and project it once."""

from __future__ import annotations

import pytest

from tidegate.operators import projection
from tidegate.plans import learning, studies
from tidegate.sources import views


@pytest.mark.parametrize("query", [studies.mode_verdicts, learning.projection_verdicts])
def test_one_projection_of_a_written_record(spark, data, monkeypatch, query):
    seen, real = [], projection.project
    monkeypatch.setattr(projection, "project", lambda batches, *a, **o: seen.append(batches) or real(batches, *a, **o))
    plan = query(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1
    # what is projected, and what is left to do, reads written tables
    assert "props" not in seen[0]._jdf.queryExecution().optimizedPlan().toString() and "props" not in plan
    assert "props" in views.telemetry(spark, data)._jdf.queryExecution().optimizedPlan().toString()
