"""Periodic runs against a search through all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import CASES, words
from tidegate.llm import periodic


def runs_by_brute_force(w):
    """start, length, period of all runs of at least 12 words, through every period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(doc_id, text):
    w = words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_brute_force(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2]))).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


def _periodic_words(rng):
    """Words with runs of many shapes: powers, Fibonacci strings, regions of small periods side by side, long periods."""
    few, shape = rng.randrange(1, 5), rng.randrange(6)
    w = [rng.randrange(few) for _ in range(rng.randrange(160))]
    if shape == 1:
        u = [rng.randrange(few) for _ in range(rng.randrange(1, 9))]
        w = (u * rng.randrange(1, 25) + u[: rng.randrange(len(u) + 1)]) * rng.randrange(1, 5) + w[: rng.randrange(20)]
    elif shape == 2:
        a, b = [0], [0, 1]
        while len(b) < 300:
            a, b = b, b + a
        at = rng.randrange(100)
        w = b[at : at + 200]
    elif shape == 3:
        u = [0, 1] * rng.randrange(1, 60) + [0]
        w = u + u[: rng.randrange(1, len(u) + 1)] + [rng.randrange(3) for _ in range(rng.randrange(4))] + u
    elif shape == 4:
        u = [rng.randrange(500) for _ in range(rng.randrange(1, 70))]
        w = [900] + u * 3 + u[:3] + w
    elif shape == 5:
        w = [x for _ in range(rng.randrange(1, 8)) for x in [rng.randrange(2) for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 30)][:300]
    return w


@pytest.mark.parametrize("seed", range(8))
def test_all_runs_of_words_side_by_side(seed):
    rng, seen = random.Random(seed), 0
    for _ in range(30):
        docs = [_periodic_words(rng) for _ in range(rng.randrange(1, 8))]
        flat = np.array([x for d in docs for x in d], dtype=np.int64)
        got = periodic.find_runs(flat, np.repeat(np.arange(len(docs)), [len(d) for d in docs])).tolist() if len(flat) else []
        want, at = [], 0
        for d in docs:
            want += [[s + at, s + length + at, q] for s, length, q in runs_by_brute_force(d)]
            at += len(d)
        assert got == sorted(want)
        seen += len(want)
    assert seen > 300


@pytest.mark.parametrize("held", [50, periodic.WORDS])
def test_documents_by_brute_force(spark, monkeypatch, docs, texts, held):
    monkeypatch.setattr(periodic, "WORDS", held)
    rows = {r.doc_id: tuple(r) for r in periodic.periodic_runs(docs).collect()}
    assert len(rows) == len(texts)
    small = {i: t for i, t in texts.items() if len(words(t)) < 1500}
    assert len(small) > 100 and sum(rows[i][1] for i in small) > 5
    assert all(rows[i] == expected(i, t) for i, t in small.items())


def test_awkward_rows(spark, odd, none):
    got = sorted((tuple(r) for r in periodic.periodic_runs(odd).collect()), key=repr)
    assert len(got) == len(CASES) and periodic.periodic_runs(none).count() == 0
    assert sorted((expected(i, t) for i, t in CASES if len(t or "") < 100_000), key=repr) == [r for r in got if r[0] != 4]
    long = next(r for r in got if r[0] == 4)
    assert long[1:6] == (1, 0, 60_000, 977, 61_412)


def test_linear_time_where_everything_repeats():
    import time

    began = time.time()
    for w in (np.zeros(200_000, np.int64), np.tile(np.arange(25_000), 8), np.arange(200_000) % 2):
        assert len(periodic.find_runs(w, np.zeros(len(w), np.int64))) == 1
    assert time.time() - began < 20
