r"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q and at least max(``LEAST``, 2 q) words that no neighbouring word extends keeping
period q. All runs of a text are found, in time near to linear in its words, whatever its periods:

* Substrings of 2, 4, 8, ... words are named so that equal ones of a text share a name; a substring that stands once keeps a name
  of its own, and only the others are named at the next length. Names compare any two stretches in a logarithmic number of steps.
* Periods under 12 are read off from words that equal the word so far before them.
* At each dyadic scale t = 4, 8, 16, ... a position belongs to the synchronising set if the least hash of the t-word substrings at it and
  the t positions after it is its own or the last one's. Substrings of a period of at most t / 3 have no hash. Membership depends on the 2 t words from the position
  alone, so a run of a period in [3 t, 6 t) holds a position whose context of 2 t words stands again one period on. Pairs of equal contexts at such distances
  propose periods; comparing onwards and backwards gives the run.
* Such a run is missed where all of its first period lies in a region of a period of at most t / 3. These regions are runs of smaller
  periods, known by then. Two that touch or overlap, of one period and one root, propose the distances at which their roots are in phase.

Of runs with the same ends the one of smallest period stays; by periodicity it divides the others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidegate.llm.common import TEXTS, table, trimming

LEAST, SMALL = 12, 12
#: Words whose names are held at once, unless one text has more.
WORDS = 400_000
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _named(keys: np.ndarray) -> np.ndarray:
    """A name for each key: its rank where the key stands more than once, else minus one minus its place."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(count[name] > 1, name, -1 - np.arange(len(keys)))


class Names:
    """Names of all substrings of 1, 2, 4, ... words. Words of different texts never share one."""

    def __init__(self, words: np.ndarray, texts: np.ndarray):
        n = len(words)
        self.text = texts
        self.levels = [_named(texts.astype(np.int64) << 32 | words)]
        while True:
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            at = np.flatnonzero(last[: max(n - half, 0)] >= 0)
            at = at[(last[at + half] >= 0) & (texts[at] == texts[at + half])]
            if not len(at):
                break
            name = _named(last[at] << 32 | last[at + half])
            new = -1 - np.arange(n)
            kept = name >= 0
            new[at[kept]] = name[kept]
            self.levels.append(new)
            if not kept.any():
                break

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of places the number of equal words from them on."""
        return self._common(i, j, 1)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of places the number of equal words before them."""
        return self._common(i, j, -1)

    def _common(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        n, out = len(self.text), np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            # a stretch of names at the top level is shorter than two of its substrings
            a, b = (i + out, j + out) if step > 0 else (i - out - (1 << k), j - out - (1 << k))
            ok = np.flatnonzero((np.minimum(a, b) >= 0) & (np.maximum(a, b) < n))
            ok = ok[self.levels[k][a[ok]] == self.levels[k][b[ok]]]
            out[ok] += 1 << k
        return out


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true."""
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Rows start, end, period by start and end, of the smallest period alone."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    keep = np.ones(len(runs), bool)
    keep[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[keep]


def _synchronising(names: Names, k: int, at: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Those of the places ``at`` (each with 2 t words of its text from it on) in the synchronising set of scale t = 2**k."""
    t, level = 1 << k, names.levels[k]
    n = len(level)
    # an odd factor makes different names different hashes
    h = level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = np.where(h == NEVER, NEVER - np.uint64(1), h)
    own = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, own[:, 0], 1)
    np.add.at(marks, own[:, 1] - t + 1, -1)
    h[np.cumsum(marks[:-1]) > 0] = NEVER
    least = h.copy()
    for j in range(k):  # least over 2, 4, ..., t places
        least[: n - (1 << j)] = np.minimum(least[: n - (1 << j)], least[1 << j :])
    low = np.minimum(least[at], h[at + t])
    return at[(low != NEVER) & ((h[at] == low) | (h[at + t] == low))]


def _contexts(names: Names, k: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with equal contexts that propose a period in [3 t, 6 t)."""
    t, context = 1 << k, names.levels[k + 1]
    at = _synchronising(names, k, np.flatnonzero(context >= 0), runs)
    at = at[np.argsort(context[at], kind="stable")]
    name = context[at]
    firsts, seconds, skip = [], [], 1
    while skip < len(at):  # equal contexts are over t / 3 apart, so this ends after 18 steps
        a, b = at[:-skip], at[skip:]
        near = (name[:-skip] == name[skip:]) & (b - a < 6 * t)
        if not near.any():
            break
        far = near & (b - a >= 3 * t)
        firsts.append(a[far])
        seconds.append(b[far])
        skip += 1
    return (np.concatenate(firsts), np.concatenate(seconds)) if firsts else (at[:0], at[:0])


def _regions(names: Names, k: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, in phase, of neighbouring regions of one period of at most t / 3 that propose a period in [3 t, 6 t)."""
    t = 1 << k
    own = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= 3 * t)]
    own = own[np.lexsort((own[:, 0], own[:, 2]))]
    firsts, seconds = [], []
    for (b1, e1, q), (b2, e2, r) in zip(own[:-1], own[1:], strict=True):
        if q != r or b2 > e1 or names.text[b1] != names.text[b2]:
            continue
        root = np.arange(b1, b1 + q)
        same = root[names.forward(root, np.full(q, b2)) >= q]
        if not len(same):
            continue
        phase = int(b2 - same[0]) % q
        low = 3 * t + (phase - 3 * t) % q
        periods = np.arange(low, min(6 * t, e1 - b1 + 1, e2 - b2 + 1), q)
        # either side of the border between the regions
        first = np.maximum(b1, b2 - periods)
        firsts.append(first)
        seconds.append(first + periods)
    return (np.concatenate(firsts), np.concatenate(seconds)) if firsts else (np.zeros(0, np.int64),) * 2


def find_runs(words: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Rows start, end, period of all runs in ``words``, ids of words text after text; ``texts`` has a word's text, not decreasing."""
    names = Names(words, texts)
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(SMALL, len(words))):
        same = names.levels[0][:-q] == names.levels[0][q:]
        starts, ends = _stretches(same)
        long = ends - starts >= q
        found.append(np.stack([starts[long], ends[long] + q, np.full(long.sum(), q)], axis=1))
    runs = _smallest(np.concatenate(found))
    for k in range(2, len(names.levels) - 1):
        pairs = [_contexts(names, k, runs), _regions(names, k, runs)]
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if not len(i):
            continue
        onwards, back = names.forward(i, j), names.backward(i, j)
        new = np.stack([i - back, j + onwards, j - i], axis=1)
        new = new[(onwards + back >= j - i)]
        runs = _smallest(np.concatenate([runs, new]))
    return runs[runs[:, 1] - runs[:, 0] >= LEAST]


def places(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original word that stands at each place, where a text has its tail replaced by a repeated stretch; else None."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def _row(doc_id: int | None, words: list[bytes], place: np.ndarray | None, runs: np.ndarray) -> tuple:
    keep = np.ones(len(words), bool)
    for s, e, q in runs:
        keep[s + q : e] = False
    at = np.flatnonzero(keep) if place is None else place[keep]
    kept = words if len(at) == len(words) and place is None else [words[i] for i in at]
    digest = hashlib.sha256(b"".join(b"%d,%d,%d\n" % (s, e - s, q) for s, e, q in runs[np.lexsort((runs[:, 2], runs[:, 0]))])).hexdigest()
    best = (None,) * 4
    if len(runs):
        s, e, q = min(runs.tolist(), key=lambda r: (r[0] - r[1], r[0], r[2]))
        best = (s, e - s, q, 1000 * (e - s) // q)
    return (doc_id, len(runs), *best, digest, hashlib.sha256(b" ".join(kept)).hexdigest())


def _together(docs: list[tuple[int | None, list[bytes], np.ndarray | None]]) -> Iterator[tuple]:
    """Rows of texts whose runs are sought together."""
    sizes = [len(w) for _, w, _ in docs]
    flat = pa.chunked_array([pa.array(w, pa.binary()) for _, w, _ in docs], pa.binary()).combine_chunks().dictionary_encode().indices.to_numpy()
    ends = np.cumsum([0, *sizes])
    moved = [flat[s:e] if p is None else flat[s:e][p] for (_, _, p), s, e in zip(docs, ends[:-1], ends[1:], strict=True)]
    runs = find_runs(np.concatenate(moved), np.repeat(np.arange(len(docs)), sizes))
    cut = np.searchsorted(runs[:, 0], ends)
    for (doc_id, words, place), at, s, e in zip(docs, ends, cut[:-1], cut[1:], strict=False):
        yield _row(doc_id, words, place, runs[s:e] - [at, at, 0])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i > 5 else pa.int64()) for i, c in enumerate(columns)], [x.split()[0] for x in OUT.split(", ")])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, n, rows = [], 0, []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (text.as_py() or "").encode("utf-8", "replace").split()
            if held and n + len(words) > WORDS:
                rows += _together(held)
                held, n = [], 0
            held.append((doc_id, words, places(doc_id, len(words))))
            n += len(words)
        if held:
            rows += _together(held)
        yield _batch(rows)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest start, then period;
    nulls without a run), runs_sha256 over all runs, collapsed_sha256 over the words left when each run keeps its first period alone.

    In a tenth of the documents, chosen by doc_id, the tail is first replaced by a repeated stretch (``places``); a null doc_id
    is never chosen. A null text has no words; equal rows give equal rows; an empty table gives none. Other columns are not read. A text of n words
    takes about 8 n log2(n) bytes where it repeats throughout, else about 40 n.
    """
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(trimming(_run, TEXTS), OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
