"""Benchmark decontamination by SimHash over item-sized windows.

For each item of L words, windows of L words slide over every whole text; a text with fewer shingles than the item is
its one window. A window and an item are multisets of shingles (5 words; an item of fewer words is one shingle). The test is weighted Jaccard
(a shingle weighs as often as it occurs) of 0.8 or more.

1. A text without any item's shingle holds no item; a vectorised pass over the bytes finds the others. In these, a window that
   reaches 0.8 shares at least 0.8 / 1.8 * 2 of its shingles with its item, so windows with fewer shingles known to
   items of their size need no fingerprint. Both bounds lose nothing.
2. The other windows get a 64-bit SimHash.
3. Multi-index Hamming search: of 8 blocks of 8 bits, fingerprints within ``RADIUS`` (20 < 8 * 3) bits differ in at most 2
   bits in one block at least. Every item filed under a block value within 2 bits is a candidate, so all
   items within the radius are found. At a similarity of 0.8 about 10 bits differ on average (standard
   deviation 3), so the radius keeps all but about one in a thousand borderline windows.
4. Candidates within the radius are verified on their shingles.
5. A text with fewer shingles than an item, but 0.8 of them at least, needs no fingerprint: an item that reaches 0.8 lacks few of
   its shingles, so it holds one of any that outnumber these. All holders of the rarest are verified; that loses nothing.

Items are read in blocks of at most ``ITEMS`` items and ``CHARS`` characters, and each block is held against all documents in a pass of its
own. No shuffle is needed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import TEXTS, batched, stored, table, trimming, words_of

SHINGLE, SIMILARITY, RADIUS, NEAR = 5, 0.8, 20, 2
ITEMS, CHARS, WORDS = 20_000, 32_000_000, 150_000
SHIFTS = np.arange(8, dtype=np.uint64) * np.uint64(8)
#: Block values within NEAR bits of 0: XOR with a block gives its neighbours.
MASKS = np.array([m for m in range(256) if m.bit_count() <= NEAR], dtype=np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a word; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values: a polynomial modulo 2^64, built from runs of 1, 2, 4, ... values, then mixed."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, width = None, 0, h, 1
    while True:
        if size & width:
            part = block[done : done + n]
            out = part if out is None else out * _power(width) + part
            done += width
        if 2 * width > size:
            break
        block = block[:-width] * _power(width) + block[width:]
        width *= 2
    out = out ^ (out >> np.uint64(31))
    out *= _ODD
    return out ^ (out >> np.uint64(29))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0xD6E8FEB86659FD93, n, 2**64))


def shingles(words: list[bytes], size: int, known: WordHashes) -> np.ndarray:
    """Hash of each run of ``size`` words, repeats included."""
    return rolled(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), size)


#: Bytes that are hashed together without cutting words out one by one, and tables over byte values.
CHUNK = 1 << 18
_LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, base, np.uint64))])


class ByteHashes:
    """Hashes of all lower-cased words of a few texts at once, from one running sum over their bytes."""

    def __init__(self):
        base = 0x9E3779B97F4A7C15
        self.up, self.down = _powers(base, CHUNK), _powers(pow(base, -1, 2**64), CHUNK)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and for each text its first word's number (one more at the end). CHUNK bytes at most."""
        raw = _LOWERED[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        gap = _SPACE[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        edge = edge if gap[0] else np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        h *= _ODD
        h ^= h >> np.uint64(29)
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        return h, np.searchsorted(starts, at)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(h).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


@dataclass
class Sized:
    """Items of one length, with their fingerprints filed by block."""

    words: int
    shingle: int
    ids: list[int] = field(default_factory=list)
    bags: list[Counter] = field(default_factory=list)
    prints: np.ndarray | None = None
    known: np.ndarray | None = None
    filed: list[dict[int, np.ndarray]] = field(default_factory=list)
    holders: dict[int, list[int]] = field(default_factory=dict)

    def file(self) -> None:
        ones = np.stack([sum(_bits(np.array([h], np.uint64))[0].astype(np.int64) * c for h, c in bag.items()) for bag in self.bags])
        self.prints = _packed(ones, self.words - self.shingle + 1)
        self.known = np.unique(np.array([h for bag in self.bags for h in bag], np.uint64))
        for i, bag in enumerate(self.bags):
            for h in bag:
                self.holders.setdefault(h, []).append(i)
        blocks = (self.prints[:, None] >> SHIFTS & np.uint64(255)).astype(np.uint8)
        for k in range(8):
            by = defaultdict(list)
            for i, v in enumerate(blocks[:, k].tolist()):
                by[v].append(i)
            self.filed.append({v: np.array(i) for v, i in by.items()})

    def near(self, fingerprint: int) -> np.ndarray:
        """Items within RADIUS of a fingerprint."""
        hit = [at for k in range(8) for v in (MASKS ^ np.uint8(fingerprint >> 8 * k & 255)).tolist() if (at := self.filed[k].get(v)) is not None]
        if not hit:
            return np.zeros(0, int)
        at = np.unique(np.concatenate(hit))
        return at[np.bitwise_count(self.prints[at] ^ np.uint64(fingerprint)) <= RADIUS]


    def sharing(self, bag: Counter, least: int) -> list[int]:
        """All items that can share ``least`` shingles with a bag, and some others."""
        hit: set[int] = set()
        spare = sum(bag.values()) - least
        for h, c in sorted(bag.items(), key=lambda x: len(self.holders.get(x[0], ()))):
            hit.update(self.holders.get(h, ()))
            spare -= c
            if spare < 0:
                break
        return sorted(hit)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets."""
    both = sum(min(c, b[h]) for h, c in a.items() if h in b)
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


class Sieve:
    """Tells most hashes that are not among ``known`` by their leading bits, some 64 places for each."""

    def __init__(self, known: np.ndarray):
        bits = min(22, max(12, len(known).bit_length() + 6))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(known >> self.shift).astype(np.int64)] = True

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        return self.seen[(h >> self.shift).astype(np.int64)]


class Index:
    """A block of items, ready for ``matches``."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.hashes = WordHashes()
        sized: dict[int, Sized] = {}
        for item_id, text in items:
            words = words_of(text or "", lower=True)
            if not words:
                continue  # an empty item is in no text
            k = min(SHINGLE, len(words))
            s = sized.setdefault(len(words), Sized(len(words), k))
            s.ids.append(item_id)
            s.bags.append(Counter(shingles(words, k, self.hashes).tolist()))
        self.by_shingle: dict[int, list[Sized]] = defaultdict(list)
        for s in sized.values():
            s.file()
            self.by_shingle[s.shingle].append(s)
        self.bytes = ByteHashes()
        small: dict[int, list[np.ndarray]] = defaultdict(list)
        for _, text in items:
            if words := words_of(text or "", lower=True):
                k = min(SHINGLE, len(words))
                for i in range(0, len(words) - k + 1):
                    small[k].append(rolled(self.bytes.words([b" ".join(words[i : i + k])])[0], k))
        self.quick = {k: np.unique(np.concatenate(v)) for k, v in small.items()}
        self.quick_seen = {k: Sieve(v) for k, v in self.quick.items()}
        self.known = {k: np.unique(np.array([h for s in group for bag in s.bags for h in bag], np.uint64)) for k, group in self.by_shingle.items()}
        self.seen = {k: Sieve(v) for k, v in self.known.items()}

    def possible(self, texts: list[str]) -> list[bool]:
        """Whether a text shares a shingle with any item; the others hold none and need no window."""
        out: list[bool] = []
        part: list[bytes] = []
        size = 0
        for raw in [t.encode("utf-8", "replace") for t in texts] + [None]:
            if part and (raw is None or size + len(raw) + 1 > CHUNK):
                out += self._possible(part)
                part, size = [], 0
            if raw is not None:
                if len(raw) + 1 > CHUNK:
                    out.append(True)
                else:
                    part.append(raw)
                    size += len(raw) + 1
        return out

    def _possible(self, texts: list[bytes]) -> list[bool]:
        h, first = self.bytes.words(texts)
        hit = np.zeros(len(texts), bool)
        for k, known in self.quick.items():
            s = rolled(h, k)
            at = np.flatnonzero(self.quick_seen[k].may_hold(s))
            at = at[np.isin(s[at], known)]
            text = np.searchsorted(first, at, side="right") - 1
            hit[text[at + k <= first[text + 1]]] = True
        return hit.tolist()

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words): for each item the most similar window, the earliest of equals."""
        words = words_of(text, lower=True)
        best: dict[int, tuple[float, int, int]] = {}
        for k, group in self.by_shingle.items():
            h = shingles(words, k, self.hashes)
            known = self.seen[k].may_hold(h)
            if not known.any():
                continue
            at = np.flatnonzero(known)
            at = at[np.isin(h[at], self.known[k])]
            if not len(at):
                continue
            for s in group:
                n = s.words - k + 1
                if len(h) < SIMILARITY * n:
                    continue
                own = at[np.isin(h[at], s.known)]
                if not len(own):
                    continue
                if len(h) < n:
                    least = int(np.ceil(SIMILARITY / (1 + SIMILARITY) * (len(h) + n) - 1e-9))
                    if len(own) < least:
                        continue
                    bag = Counter(h.tolist())
                    for at_item in s.sharing(bag, least):
                        like = similarity(bag, s.bags[at_item])
                        if like >= SIMILARITY and like > best.get(s.ids[at_item], (0.0,))[0]:
                            best[s.ids[at_item]] = (like, 0, len(words))
                    continue
                known = np.zeros(len(h) + 1, np.int64)
                known[own + 1] = 1
                known = known.cumsum()
                held = known[n:] - known[:-n] if n < len(known) else known[:0]
                starts = np.flatnonzero(held >= np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * n - 1e-9))
                for i in range(0, len(starts), 4096):
                    part = starts[i : i + 4096]
                    ones = np.stack([_bits(h[p : p + n]).sum(axis=0, dtype=np.int64) for p in part.tolist()])
                    for p, fingerprint in zip(part.tolist(), _packed(ones, n).tolist(), strict=True):
                        near = s.near(fingerprint)
                        if not len(near):
                            continue
                        bag = Counter(h[p : p + n].tolist())
                        for at_item in near.tolist():
                            like = similarity(bag, s.bags[at_item])
                            if like >= SIMILARITY and like > best.get(s.ids[at_item], (0.0,))[0]:
                                best[s.ids[at_item]] = (like, p, s.words)
        return [(item, *x) for item, x in sorted(best.items())]


_made: dict[int, Index] = {}


def indexed(items: list[tuple[int, str | None]]) -> Index:
    """The index of a block of items, made once in each Python worker; one block is held at a time."""
    key = xxhash.xxh64_intdigest(repr(items).encode("utf-8", "replace"))
    if key not in _made:
        _made.clear()
        _made[key] = Index(items)
    return _made[key]


def item_blocks(benchmark: DataFrame, size: int = ITEMS, most: int = CHARS) -> Iterator[list[tuple[int, str | None]]]:
    """Items with an id, in blocks of at most ``size`` items and ``most`` characters (or one item)."""
    part: list = []
    held = 0
    for r in benchmark.select("item_id", "text").filter("item_id IS NOT NULL").toLocalIterator():
        own = len(r.text or "")
        if part and (len(part) == size or held + own > most):
            yield part
            part, held = [], 0
        part.append((r.item_id, r.text))
        held += own
    if part:
        yield part


MATCHES = "array<struct<item_id:bigint,similarity:double,first_word:bigint,n_words:bigint>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def found_in(texts: list[str | None], items: list[tuple[int, str | None]]) -> list[list[tuple[int, float, int, int]]]:
    """The matches of each text."""
    index = indexed(items)
    whole = [t or "" for t in texts]
    return [index.matches(t) if may else [] for t, may in zip(whole, index.possible(whole), strict=True)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, similarity, first_word, n_words.

    Only contaminated documents appear. Words are lower-cased (A-Z). Null and empty texts and items
    match nothing; a text with fewer shingles than an item is one window, of its own n_words; repeated documents or items give a row each.
    Of several blocks all but the last are written before the next is read, so that one is held at a time.
    """
    texts, done, last = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None, None

    def marked(items: list[tuple[int, str | None]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [[dict(zip(("item_id", "similarity", "first_word", "n_words"), m, strict=True)) for m in x] for x in found_in(b.column(1).to_pylist(), items)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _ARROW)], ["doc_id", "matches"])

        return texts.mapInArrow(trimming(run, TEXTS), f"doc_id long, matches {MATCHES}").select("doc_id", F.inline("matches"))

    for items in item_blocks(benchmark):
        if last is not None:
            last = stored(last)
            done = last if done is None else done.unionAll(last)
        last = marked(items)
    if last is None:
        return texts.select("doc_id", F.inline(F.array().cast(MATCHES)))
    return last if done is None else done.unionAll(last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark item. Columns are those of ``docs``, whatever their names."""
    at = docs.columns.index("text")
    for i, items in enumerate(item_blocks(table(spark, sf_dir, "benchmark"))):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not x for x in found_in(b.column(at).to_pylist(), items)], pa.bool_()))

        docs = (stored(docs) if i else batched(docs)).mapInArrow(trimming(run, TEXTS), docs.schema)
    return docs
