"""Optimised batches: rows are dealt once for all steps, which gives what step after step gives."""

from __future__ import annotations

import numpy as np
import pytest

from tests.test_matching import NAMES, PARAMS, WIDTH, arrays, frame
from tidegate.operators import matching, order


@pytest.mark.parametrize("wanted", [None, [0.5, -1.0, 0.3, 0.2, -0.7, 1.0, 0.4]])
def test_rows_are_dealt_once(spark, wanted, monkeypatch):
    key, dealt, real = ["client_id"], [], order.in_blocks
    state = matching.written(matching.standard(frame(spark, 25), key, NAMES)[0])
    one = state
    for rate in (0.5, 0.3, 0.1):
        one = matching.written(matching._stepped(one, key, [True, True], PARAMS, WIDTH, rate, 0.6, "row_id", wanted))
    # blocks shorter than what the steps look over
    monkeypatch.setattr(matching.order, "in_blocks", lambda df, before, after, row="row_id", block=0: dealt.append(before) or real(df, before, after, row, 5))
    matching.perturbed(frame(spark, 25), key, NAMES, WIDTH, params=PARAMS, wanted=wanted, steps=3).count()
    assert dealt == [3 * (WIDTH - 1)]
    whole, once = arrays(one), arrays(matching._stepped(state, key, [True, True], PARAMS, WIDTH, [0.5, 0.3, 0.1], 0.6, "row_id", wanted))
    assert all(np.allclose(once[c], whole[c]) and len(whole[c]) == 25 for c in whole)
