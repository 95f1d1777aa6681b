"""Pieces of the near-duplicate stage: hashes of long texts, meeting places, pairs that are compared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidegate.llm import neardedup
from tidegate.llm.decontamination import ByteHashes


def test_words_of_long_texts_hash_as_in_short_ones():
    bytes_, rng = ByteHashes(), np.random.default_rng(0)
    words = [f"W{i}é" for i in rng.integers(0, 50_000, 60_000)]
    text = " \n\t".join(words)
    assert len(text.encode()) > neardedup.BYTES
    short = np.concatenate([bytes_.words([" ".join(words[i : i + 100]).encode()])[0] for i in range(0, len(words), 100)])
    assert (neardedup._long_words(text.encode(), bytes_) == short).all()
    own = list(neardedup.shingle_sets([text, "one two three four five", "", "x" * 300_000 + " a b c d"], bytes_))
    assert [len(x) for x in own] == [len(np.unique(own[0])), 1, 0, 1] and len(own[0]) > 59_000


def test_pairs_that_could_be_near_copies_are_given_once():
    """Against all pairs of two families: sizes, what is left behind the meeting place, bits; those that met before are left out."""
    rng = np.random.default_rng(1)
    rows = []
    for h in range(3):
        for no in range(60):
            rows.append((h, 0, int(no % 3 > 0), no, int(rng.integers(40, 60)), int(rng.integers(0, 14)), no % 3, int(rng.integers(-(2**40), 2**40)), -1 - no, [] if h == 0 else [7 + h] if no < 30 else [0] * 3))
    # as in the job: entries of all families are held (role 0), those outside of the largest are compared (role 1)
    held = [(*r[:2], 0, *r[3:]) for r in rows] + [r for r in rows if r[2] == 1]
    held.sort(key=lambda r: (r[0], r[1], r[2], r[4]))
    names = ["h", "part", "role", "no", "n", "i", "comp", "low", "high", "recent"]
    batch = pa.RecordBatch.from_arrays([pa.array([r[j] for r in held], pa.list_(pa.int64()) if j == 9 else pa.int32() if j in (1, 2) else pa.int64()) for j in range(10)], names)
    got = {p for b in neardedup._compared(iter([batch])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    want = set()
    for h in range(3):
        own = [r for r in rows if r[0] == h]
        for x in own:
            for y in own:
                apart = ((x[7] ^ y[7]) & (2**64 - 1)).bit_count() + ((x[8] ^ y[8]) & (2**64 - 1)).bit_count()
                room = min(x[4] - x[5], y[4] - y[5])
                met = h > 0 and x[3] < 30 and y[3] < 30
                if x[3] < y[3] and x[6] != y[6] and 9 * room >= 4 * (x[4] + y[4]) and 5 * min(x[4], y[4]) >= 4 * max(x[4], y[4]) and apart <= neardedup.FAR and not met:
                    want.add((x[3], y[3]))
    assert got == want and len(want) > 50
