"""The license scan against word-by-word search and edit distances."""

from __future__ import annotations

import random
import re
import string
import time

import pytest

from tests.llm.conftest import CASES
from tidegate.llm import licenses

SPOKEN = licenses.NOTICES


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def least_edits(said, text):
    """Fewest edits between ``said`` and any stretch of ``text``, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(said, 1):
        before, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(before[j - 1] + (a != b), before[j] + 1, row[j - 1] + 1)
    return min(row)


def base_by_brute_force(w):
    found = []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return found


def test_rows(spark, docs, texts):
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        w, r = norm(t), rows[i]
        base = base_by_brute_force(w)
        at = [x for x, _ in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(base), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in base}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert (r.score == 0) == (r.labels == "") and 0 <= r.score <= 1
    assert sum(r.n_base > 0 for r in rows.values()) > 0


def _edited(rng, said, edits):
    s = list(said)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(s))
        if kind == 0:
            s[at] = rng.choice(string.ascii_lowercase)
        elif kind == 1:
            s.insert(at, rng.choice(string.ascii_lowercase + " "))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


@pytest.mark.parametrize("seed", range(4))
def test_labels_are_those_within_the_edits(seed):
    rng, scanner, hits, misses = random.Random(seed), licenses.Scanner(exact=()), 0, 0
    for _ in range(60):
        label, said = rng.choice(SPOKEN)
        noise = lambda: " ".join("".join(rng.choices("abcde", k=rng.randrange(1, 7))) for _ in range(rng.randrange(8)))
        text = f"{noise()} {_edited(rng, said, rng.randrange(0, 7))} {noise()} {said[: rng.randrange(len(said))]}"
        w = " " + " ".join(norm(text)) + " "
        near = {(x, n) for x, n in SPOKEN if least_edits(n, w) <= len(n) // licenses.PER_ERROR}
        got = {(scanner.notices[i].label, scanner.notices[i].said) for _, _, i, _ in scanner.matches(w)}
        assert got == near
        hits, misses = hits + len(near), misses + (not near)
    assert hits > 20 and misses > 5


def test_reported_edits_and_spans():
    scanner = licenses.Scanner()
    text = "Intro -- Realeased under  the M.I.T. licence, and more. Licensed under the Apache License; MIT License MIT license"
    r = scanner.row(1, text)
    assert r[2] == 3 and r[3] == 13 and r[4] == 17 and r[5] == "apache,mit"
    for told in r[8].split(","):
        label, s, e, errors = told.split(":")
        said = " ".join(norm(text[int(s) : int(e)]))
        assert any(x.label == label and least_edits(x.said.strip(), said) <= int(errors) for x in scanner.notices)
    one = scanner.row(1, "This was relesed under the mit licence.")
    assert (one[5], one[6], one[2]) == ("", "", 0)  # three edits, one is allowed
    two = scanner.row(1, "x\nReleased under\tthe MIT licence!")
    assert (two[5], two[6], two[8]) == ("", "mit", "mit:2:32:1")


def test_phrases_overlap_and_need_whole_words():
    row = licenses.Scanner(notices=()).row
    assert row(1, "mit license mit license")[2:5] == (2, 0, 2)
    assert row(1, "summit license, mit licenses, mit-license; MIT license")[2:5] == (1, 4, 4)
    assert row(1, "GNU General Public License")[2:7] == (1, 1, 1, "gpl", "gpl")


def test_awkward_rows(odd, none):
    assert licenses.scan(odd).count() == len(CASES) and licenses.scan(none).count() == 0
    assert {tuple(r)[1:] for r in licenses.scan(odd).filter("doc_id IN (2, 3, 6)").collect()} == {(0, 0, None, None, "", "", 0.0, "")}


def test_halves_of_notices_take_little_time():
    scanner, began = licenses.Scanner(), time.time()
    for _, said in SPOKEN:
        scanner.row(1, (said[: len(said) * 2 // 3] + " ") * 300)
    assert time.time() - began < 30
