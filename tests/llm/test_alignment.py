"""Alignment of two tokenizers' tokens against a token-by-token version."""

from __future__ import annotations

import collections
import hashlib

import pytest

from tests.llm.conftest import CASES
from tidegate.llm import alignment


@pytest.fixture(scope="module")
def tools():
    return alignment.Tokenizers(*alignment.PATHS)


def ends(ids, said):
    out, at = [], 0
    for i in ids:
        at += len(said[i].as_py())
        out.append(at)
    return out


def by_brute_force(rows, tools):
    """doc_id and the counts of each row of (doc_id, text)."""
    groups = []
    for _, text in rows:
        want = b" " + (text or "").encode()
        a = tools.a.encode(f" {text or ''}", add_special_tokens=False).ids if text else []
        b = tools.b.encode(text) if text else []
        joined = lambda ids, said: b"".join(said[i].as_py() for i in ids)
        found = []
        if text and joined(a, tools.bytes_a) == want and joined(b, tools.bytes_b) == want:
            ea, eb = ends(a, tools.bytes_a), ends(b, tools.bytes_b)
            low = 0
            for cut in sorted(set(ea) & set(eb)):
                found.append(([i for i, e in zip(a, ea, strict=True) if low < e <= cut], [i for i, e in zip(b, eb, strict=True) if low < e <= cut]))
                low = cut
        groups.append(found)
    count = collections.Counter(p for found in groups for p in {(x, y) for p, q in found for x in p for y in q})
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), found in zip(rows, groups, strict=True):
        links = [(x, y) for p, q in found for x in p for y in q]
        said = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in found)
        digest = hashlib.sha256(said.encode()).hexdigest() if found else ""
        out.append((doc_id, sum(len(p) for p, _ in found), sum(len(q) for _, q in found), len(found), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=repr)


def test_bytes_of_tokens(tools):
    said = [x for x in tools.bytes_a.to_pylist() if x != b"<|endoftext|>"]
    assert {bytes([b]) for b in range(256)} <= set(said) and len(set(said)) == len(said)
    assert {bytes([b]) for b in range(256)} <= set(tools.bytes_b.to_pylist())


@pytest.mark.parametrize(("hot", "held"), [(alignment.HOT, alignment.CHARACTERS), (7, 500), (0, 1)])
def test_documents_by_brute_force(spark, docs, tools, monkeypatch, hot, held):
    monkeypatch.setattr(alignment, "CHARACTERS", held)
    monkeypatch.setattr(alignment, "PARTIAL", held)
    few = docs.filter("length(text) < 1500 OR text IS NULL").unionByName(docs.limit(20))
    rows = [(r.doc_id, r.text) for r in few.select("doc_id", "text").collect() if r.text is None or len(r.text) < 1500]
    got = alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_brute_force(rows, tools)
    assert len(rows) > 60


AWKWARD = ["<|endoftext|> and <s> </s>", "▁ marks stay spaces", "naïve 日本語テキスト 😀😀 é", "  two  spaces \n\n\ttabs\r\n", "\x00\x01 controls", "a" * 300, "=-=-" * 60, " ", "12345678901234567890", "ﬁ ligature ½", " 　 wide"]


def test_awkward_texts(spark, tools):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id"), (5, None), (6, "")]
    got = sorted((tuple(r) for r in alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == by_brute_force(rows, tools)
    assert {r[0] for r in got if r[1] == 0} == {1, 5, 6}  # the mark is read as a space


def test_awkward_rows(odd, none):
    assert alignment.aligned(odd).count() == len(CASES)
    assert alignment.aligned(none).count() == 0
    assert {tuple(r)[1:] for r in alignment.aligned(odd.filter("text IS NULL OR text = ''")).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_both_readings_of_a_give_the_same_ids(tools, texts):
    known = [t for t in texts.values() if t] + AWKWARD + [" " * 6000, "x" + "\n" * 20_000 + "y", "a " * 3000, "é" * 5000, " \u3000" * 3000]
    for t in known:
        assert tools.ids_a(t).tolist() == tools.a.encode(f" {t}", add_special_tokens=False).ids


def test_long_groups_are_counted_not_listed(tools):
    # 40,000 equal signs: groups hold few different ids, so pairs stay few
    rows, pairs = alignment.align(["=" * 40_000], tools)
    assert rows["n_links"][0].as_py() >= rows["n_groups"][0].as_py() > 0 and len(pairs) < 200
