"""Exact substring removal through prefix-partitioned suffix trees.

A window of 35 words is repeated if its words also start anywhere else. Trees over every suffix of a corpus would
not fit, and most suffixes repeat nothing, so:

1. Every window has an owner: the 16-word gram of least hash in it. Equal windows own equal grams
   at the same offset, so a window whose owner's gram occurs once is unique. Grams are counted over
   all texts (pre-aggregated); only windows with a repeated owner go on.
2. Windows that share an owner form a run; its words travel once. Runs are dealt by the owner's
   gram: the prefix of the suffix that starts at the owner. Each task takes as many whole prefix groups as
   fit (``ROWS``) and grows their trees word by word: the suffix tree to the right of the owner, and
   its mirror to the left. A node with one leaf is dropped at once. A window is repeated exactly if its
   right node, of depth 35 - j, and its left node, of depth j, hold another leaf together: such deep inner nodes
   are the repeats. All depths from 16 to 35 are read off one growth.
3. A prefix with more than ``HOT`` suffixes would outgrow a task. It is lengthened to the full 35
   words: its windows are counted by the digest of their words, which pre-aggregates.

Texts are taken once for each distinct text; copies count in ``copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import TEXTS, batched, clean_text, spread_join, stored, table, trimming, words_of
from tidegate.llm.decontamination import WordHashes, shingles

WINDOW, GRAM = 35, 16
SPAN = WINDOW - GRAM + 1
#: Runs that one growth holds at most beyond a whole prefix group, and the suffixes of a prefix group at most.
ROWS, HOT = 60_000, 60_000


#: The low bits of a gram's key hold its place; the rest of the hash decides, so equal windows still agree.
PLACE = np.uint64((1 << 24) - 1)


def owners(words: list[bytes], known: WordHashes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each gram, and for each window the place of its owner: the least hash (but for 24 bits), leftmost of equals."""
    g = shingles(words, gram, known)
    span = window - gram + 1
    if len(words) < window:
        return g, np.zeros(0, np.int64)
    block = int(PLACE) + 1 - span
    out = []
    for at in range(0, len(words) - window + 1, block):  # one block for any text under 16 million words
        part = g[at : at + block + span - 1]
        key = part & ~PLACE | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[: len(key) - width], key[width:])
            width *= 2
        rest = span - width
        key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
        out.append((key & PLACE).astype(np.int64) + at)
    return g, np.concatenate(out)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, text -> digest, gram, n: the owners' grams of a text with the places they own from."""
    known = WordHashes()
    for b in batches:
        digests, grams, counts = [], [], []
        for digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            g, own = owners(words_of(text), known)
            if len(own):
                h, n = np.unique(g[np.unique(own)], return_counts=True)
                digests += [digest] * len(h)
                grams.append(h)
                counts.append(n)
        if grams:
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))], ["digest", "gram", "n"])


RUN = [("digest", pa.binary()), ("route", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("back", pa.int32()), ("words", pa.binary())]
LONE = [("digest", pa.binary()), ("first", pa.int64()), ("whole", pa.binary())]


def _runs(batches: Iterator[pa.RecordBatch], hot: int, lone: bool) -> Iterator[pa.RecordBatch]:
    """digest, text, copies, grams, counts -> runs of windows with repeated owners; ``back`` is the owner's place less ``first``.

    With ``lone`` the windows of hot owners instead, one by one, with the digest of their 35 words.
    """
    known = WordHashes()
    names, kinds = zip(*(LONE if lone else RUN), strict=True)
    for b in batches:
        out: list[list] = [[] for _ in names]

        def put(*row):
            for column, value in zip(out, row, strict=True):
                column.append(value)

        for digest, text, _, grams, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = words_of(text)
            g, own = owners(words, known)
            held = np.array(grams, np.int64).view(np.uint64)[(np.array(counts) > hot) == lone]
            places = np.unique(own)
            places = places[np.isin(g[places], held)]
            first = np.searchsorted(own, places, side="left")  # owners ascend with windows
            after = np.searchsorted(own, places, side="right")
            for a, s, e, h in zip(places.tolist(), first.tolist(), after.tolist(), g[places].view(np.int64).tolist(), strict=True):
                if lone:
                    for p in range(s, e):
                        put(digest, p, hashlib.md5(b" ".join(words[p : p + WINDOW])).digest())
                else:
                    put(digest, h, s, e - s, a - s, b" ".join(words[s : e - 1 + WINDOW]))
            if len(out[0]) > ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                for column in out:
                    column.clear()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _grow(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The next level: a child for each (node, word) with two leaves or more; -1 for a dropped leaf."""
    alive = np.flatnonzero((node >= 0) & (word >= 0))
    out = np.full(len(node), -1, np.int64)
    if len(alive):
        _, child, n = np.unique(node[alive] << np.int64(32) | word[alive], return_inverse=True, return_counts=True)
        many = n[child] > 1
        out[alive[many]] = child[many]
    return out


def repeats(route: np.ndarray, n: np.ndarray, back: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """For each run a bit for each of its windows that is repeated among the runs given."""
    ids: dict[bytes, int] = {}
    split = [c.split() for c in contexts]
    flat = np.fromiter((ids.setdefault(w, len(ids)) for c in split for w in c), np.int64)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def word(offset: int) -> np.ndarray:
        """The word at the owner's place + offset; -1 outside of the run's words."""
        at = back + offset
        inside = (at >= 0) & (at < sizes)
        return np.where(inside, flat[np.where(inside, starts + at, 0)], -1)

    _, first, root = np.unique(route, return_index=True, return_inverse=True)
    # a route is the hash of the owner's words: where they are equal throughout, the node of depth GRAM is the route
    right, node, depth = {}, root.astype(np.int64), 0
    if all((w == w[first][root]).all() for w in map(word, range(GRAM))):
        depth = GRAM
        right[depth] = node
    while depth < WINDOW:
        node = _grow(node, word(depth))
        depth += 1
        if depth >= GRAM:
            right[depth] = node
    bits = np.zeros(len(route), np.int64)
    left = root.astype(np.int64)
    for j in range(SPAN):
        if j:
            left = _grow(left, word(-j))
        deep = right[WINDOW - j]
        at = back - j  # the window's place in the run
        here = np.flatnonzero((at >= 0) & (at < n) & (deep >= 0) & (left >= 0))
        if len(here):
            _, leafs, count = np.unique(deep[here] << np.int64(32) | left[here], return_inverse=True, return_counts=True)
            again = here[count[leafs] > 1]
            bits[again] |= np.int64(1) << at[again]
    return bits


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by route -> digest, first, bits of the repeated windows; whole prefix groups at a time."""

    def grown(t: pa.Table) -> pa.RecordBatch:
        bits = repeats(t["route"].to_numpy(), t["n"].to_numpy().astype(np.int64), t["back"].to_numpy().astype(np.int64), t["words"].to_pylist())
        hit = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays([t["digest"].combine_chunks().take(pa.array(hit)), t["first"].combine_chunks().take(pa.array(hit)), pa.array(bits[hit])], ["digest", "first", "bits"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= ROWS:
            t = pa.Table.from_batches(held)
            route = t["route"].to_numpy()
            end = int(np.flatnonzero(route != route[-1])[-1]) + 1 if route[0] != route[-1] else 0
            if end:
                yield grown(t.slice(0, end))
                held = t.slice(end).combine_chunks().to_batches()
                size -= end
    if size:
        yield grown(pa.Table.from_batches(held))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, text, copies, firsts, bits -> digest, n_words, n_removed, kept_sha256, kept."""
    for b in batches:
        rows = []
        for digest, text, copies, firsts, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = words_of(text)
            n = len(words)
            gone = np.zeros(n, bool)
            if n >= WINDOW:
                starts = np.zeros(n + 1, np.int64)
                if copies > 1:
                    starts[: n - WINDOW + 1] = 1
                for first, mask in zip(firsts or [], bits or [], strict=True):
                    for i in range(SPAN):
                        if mask >> i & 1:
                            starts[first + i] = 1
                count = starts.cumsum()
                at = np.arange(n)
                gone = count[at] - np.where(at >= WINDOW, count[np.maximum(at - WINDOW, 0)], 0) > 0
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            rows.append((digest, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        names = ["digest", "n_words", "n_removed", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()])], names)


def _keyed(docs: DataFrame) -> DataFrame:
    # the filter holds for every row; written out, all uses of the texts plan alike and share an exchange
    keyed = batched(docs).select(F.unhex(F.md5(clean_text())).alias("digest"), clean_text().alias("text"))
    return keyed.filter("digest IS NOT NULL")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """digest, text, copies for each distinct text (null is empty)."""
    return _keyed(docs).groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def _parts(counts: DataFrame, key: str, count: str, hot: int) -> DataFrame:
    """key, parts of the keys with more than ``hot`` rows: at most the rows over ``hot``, so few."""
    return counts.filter(F.col(count) > hot).select(key, F.ceil(F.col(count) / hot).cast("int").alias("parts"))


def with_repeated_grams(docs: DataFrame, texts: DataFrame, hot: int = HOT) -> DataFrame:
    """The distinct texts that own a repeated gram: digest, text, found (array of gram and its total)."""
    # a copy of a text adds nothing here: its windows are repeated anyway
    grams = stored(_keyed(docs).mapInArrow(trimming(_grams, TEXTS), "digest binary, gram long, n long"))
    often = stored(grams.groupBy("gram").agg(F.sum("n").alias("total")).filter("total > 1"))
    lists = spread_join(grams, often, "gram", _parts(often, "gram", "total", hot), "digest").groupBy("digest").agg(F.collect_set(F.struct("gram", "total")).alias("found"))
    return texts.join(lists, "digest")


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by a space).

    A null text has no words; texts under 35 words lose none; copies of one text lose all their windows;
    repeated rows stay rows; an empty table gives none.
    """
    texts = distinct_texts(docs)
    held = with_repeated_grams(docs, texts, hot)
    # copies goes along so that all uses of the texts share one exchange
    runs = held.select("digest", "text", "copies", "found.gram", "found.total").mapInArrow(trimming(lambda b: _runs(b, hot, False), TEXTS), "digest binary, route long, first long, n int, back int, words binary")
    trees = runs.repartition("route").sortWithinPartitions("route").mapInArrow(trimming(_trees), "digest binary, first long, bits long")
    heavy = held.filter(F.exists("found", lambda x: x["total"] > hot)).select("digest", "text", "copies", "found.gram", "found.total")
    whole = stored(heavy.mapInArrow(trimming(lambda b: _runs(b, hot, True), TEXTS), "digest binary, first long, whole binary"))
    again = stored(whole.groupBy("whole").agg(F.count("*").alias("times")).filter("times > 1"))
    repeated = spread_join(whole, again, "whole", _parts(again, "whole", "times", hot), "digest")
    found = trees.unionByName(repeated.select("digest", "first", F.lit(1).cast("long").alias("bits")))
    found = found.groupBy("digest").agg(F.collect_list(F.struct("first", "bits")).alias("found"))
    done = texts.join(found, "digest", "left").select("digest", "text", "copies", "found.first", "found.bits").mapInArrow(trimming(_removed, TEXTS), "digest binary, n_words long, n_removed long, kept_sha256 string, kept string")
    own = docs.select("doc_id", F.unhex(F.md5(clean_text())).alias("digest"))
    copies = own.groupBy("digest").agg(F.count("*").alias("copies")).filter(F.col("copies") > hot)
    return spread_join(own, done, "digest", _parts(copies, "digest", "copies", hot), "doc_id").drop("digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def sql() -> str:
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
v AS (SELECT rid, p, array_to_string(words[p:p + {WINDOW - 1}], ' ') AS said FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS p FROM w)),
r AS (SELECT said FROM v GROUP BY said HAVING count(*) > 1),
g AS (SELECT DISTINCT rid, unnest(range(p, p + {WINDOW})) AS at FROM v SEMI JOIN r USING (said)),
k AS (SELECT w.rid, coalesce(list(g.at) FILTER (g.at IS NOT NULL), []) AS gone FROM w LEFT JOIN g USING (rid) GROUP BY w.rid)
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]), ' '), '')) AS kept_sha256
FROM w JOIN k USING (rid)"""
