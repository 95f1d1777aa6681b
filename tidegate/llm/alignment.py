r"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, over a whole corpus.

A encodes a space and the text, B the text, to which it adds the space. Byte offsets where a token of A and one of B both end cut a text's
tokens into groups; all pairs of an A and a B token of one group are linked. An id pair's count is the number of documents that hold it linked.

Inside a task everything is Arrow on many texts at once: lists of ids are flattened beside their parents' indices, cumulative
sums of the tokens' bytes less those of the texts before give the ends, an Acero hash join on (text, end) gives the cuts, cumulative sums of cuts
the groups, and a hash join on groups the linked ids, of which ``Table.group_by`` leaves each pair of a text once. Pairs are written once, with partial
counts that ``Table.group_by`` takes over many texts; Spark merges these. The ``HOT`` most frequent pairs (a fixed number) travel to the tasks and meet
the written pairs in an Acero join; only the others are shuffled to their counts, so that no frequent pair is ever a shuffle key.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import TEXTS, stored, table, trimming

#: Frequent pairs that travel to every task; characters of text, and pairs of partial counts, that a task holds at once.
HOT, CHARACTERS, PARTIAL = 1 << 18, 1 << 20, 1 << 20
#: Links for a token from which on a group's ids are counted before they are joined.
WIDER = 4
LINKED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<long>"
SUMMED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, a array<int>, b array<int>, n array<long>"
#: A (byte-level BPE) and B (SentencePiece), unless other files are named.
PATHS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How byte-level BPE of this kind cuts a text before its merges (fixed value), and runs of white space that a backtracking engine should not meet.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDE = re.compile(r"(?<!\s)\s{5000}")
LISTS = {"a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "n": pa.list_(pa.int64())}


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: its own if it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of their ids. A's file is read by two libraries: its own, and a faster one that takes
    the same vocabulary as ranks and gives the same ids, for all texts but those with long runs of white space."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        said = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            said[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_a = pa.array(said, pa.large_binary())
        special = {x.content for x in self.a.get_added_tokens_decoder().values()}
        self.quick = tiktoken.Encoding("a", pat_str=CUT, mergeable_ranks={said[i]: i for t, i in vocabulary.items() if t not in special}, special_tokens={})
        b = self.b
        self.bytes_b = pa.array([bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())], pa.large_binary())

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """The ids of either side; none for an empty text."""
        a = [self.ids_a(t) if t else np.zeros(0, np.uint32) for t in texts]
        b = [x if t else [] for t, x in zip(texts, self.b.encode(texts, num_threads=1), strict=True)]
        offsets = np.cumsum([0, *map(len, a)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint32), *a]).astype(np.int32))), pa.array(b, LISTS["b"])

    def ids_a(self, text: str) -> np.ndarray:
        """The ids of a space and ``text``."""
        if WIDE.search(text):
            return np.array(self.a.encode(f" {text}", add_special_tokens=False).ids, np.uint32)
        return self.quick.encode_to_numpy(f" {text}", disallowed_special=())


def _faithful(ids: pa.ListArray, said: pa.LargeBinaryArray, texts: list[bytes]) -> np.ndarray:
    """For each text whether its tokens' bytes joined are the text."""
    tokens = pc.take(said, pc.list_flatten(ids))
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(tokens).to_numpy())]).astype(np.int64)
    joined = memoryview(tokens.buffers()[2]).cast("B") if len(tokens) else memoryview(b"")
    edge = ends[ids.offsets.to_numpy()]
    return np.array([joined[s:e] == t for s, e, t in zip(edge[:-1].tolist(), edge[1:].tolist(), texts, strict=True)], bool)


def _tokens(ids: pa.ListArray, said: pa.LargeBinaryArray, keep: np.ndarray, at: str) -> pa.Table:
    """doc, end, id, place of the tokens of the texts to ``keep``; ends count from each text's start."""
    doc = pc.list_parent_indices(ids).cast(pa.int64())
    flat = pc.list_flatten(ids)
    mask = pc.take(pa.array(keep), doc)
    doc, flat = doc.filter(mask), flat.filter(mask)
    sums = pc.cumulative_sum(pc.take(pc.binary_length(said), flat).cast(pa.int64()))
    # what the texts before have summed up to
    last = np.zeros(len(keep) + 1, np.int64)
    np.maximum.at(last, doc.to_numpy() + 1, sums.to_numpy())
    before = pa.array(np.maximum.accumulate(last)[:-1])
    return pa.table({"doc": doc, "end": pc.subtract(sums, pc.take(before, doc)), "id": flat, at: pa.array(np.arange(len(flat)))})


def _grouped(n: int, cuts: np.ndarray) -> np.ndarray:
    """The group of each of ``n`` tokens; a token at a cut is the last of its group."""
    flags = np.zeros(n, np.int64)
    flags[cuts] = 1
    return np.cumsum(flags) - flags


def _written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, docs: np.ndarray, n: int) -> list[str]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``, ids of A before those of B in each group."""
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    sum_a, sum_b = np.cumsum(size_a), np.cumsum(size_b)
    at_a = np.arange(len(a)) + (sum_b - size_b)[group_a]
    at_b = np.arange(len(b)) + sum_a[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int32), np.zeros(len(a) + len(b), np.int8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[sum_a - 1]], mark[at_b[sum_b - 1]] = 1, 2  # the last of a group's side
    doc = np.empty(len(ids), np.int64)
    doc[at_a], doc[at_b] = docs[group_a], docs[group_b]
    mark[np.flatnonzero(np.diff(doc, append=-1))] = 3
    said = pc.binary_join_element_wise(pa.array(ids).cast(pa.large_string()), pc.take(pa.array([",", "|", ";", ""], pa.large_string()), pa.array(mark)), pa.scalar("", pa.large_string()))
    offsets = np.searchsorted(doc, np.arange(n + 1))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), said), pa.scalar("", pa.large_string())).to_pylist()


def align(texts: list[str | None], tools: Tokenizers) -> tuple[pa.Table, pa.Table]:
    """A row for each text (n_a, n_b, n_groups, n_links, groups_sha256), and doc, a, b, n: the pairs linked in a text and how often."""
    known = [t or "" for t in texts]
    n = len(known)
    ids_a, ids_b = tools.encode(known)
    raw = [f" {t}".encode("utf-8", "replace") if t else b"" for t in known]
    keep = np.array([bool(t) for t in known], bool) & _faithful(ids_a, tools.bytes_a, raw) & _faithful(ids_b, tools.bytes_b, raw)
    a, b = _tokens(ids_a, tools.bytes_a, keep, "at_a"), _tokens(ids_b, tools.bytes_b, keep, "at_b")
    ends = [pa.table({"doc_end": pc.add(pc.multiply(x["doc"], 1 << 40), x["end"]), at: x[at]}) for x, at in ((a, "at_a"), (b, "at_b"))]
    cuts = ends[0].join(ends[1], keys="doc_end", join_type="inner", use_threads=False)
    group_a, group_b = (_grouped(len(x), cuts[at].to_numpy()) for x, at in ((a, "at_a"), (b, "at_b")))
    docs = np.zeros(len(cuts), np.int64)  # a group's text
    docs[group_a] = a["doc"].to_numpy()
    each = [pa.table({"group": g, side: x["id"], f"n_{side}": np.ones(len(x), np.int64)}) for x, g, side in ((a, group_a, "a"), (b, group_b, "b"))]
    if int((np.bincount(group_a) * np.bincount(group_b)).sum()) > WIDER * (len(a) + len(b)):  # long groups of few ids: each id once, with its count
        each = [x.group_by(["group", side], use_threads=False).aggregate([(f"n_{side}", "sum")]).rename_columns(["group", side, f"n_{side}"]) for x, side in zip(each, "ab", strict=True)]
    linked = each[0].join(each[1], keys="group", join_type="inner", use_threads=False)
    linked = pa.table({"doc": docs[linked["group"].to_numpy()], "a": linked["a"], "b": linked["b"], "n": pc.multiply(linked["n_a"], linked["n_b"])})
    pairs = linked.group_by(["doc", "a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["doc", "a", "b", "n"]).sort_by("doc")
    count = lambda x: np.bincount(x, minlength=n)
    said = _written(a["id"].to_numpy(), b["id"].to_numpy(), group_a, group_b, docs, n)
    links = np.zeros(n, np.int64)
    np.add.at(links, pairs["doc"].to_numpy(), pairs["n"].to_numpy())
    row = {"n_a": count(a["doc"].to_numpy()), "n_b": count(b["doc"].to_numpy()), "n_groups": count(docs), "n_links": links, "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]}
    return pa.table(row), pairs


def _lists(pairs: pa.Table, offsets: np.ndarray) -> list[pa.ListArray]:
    """Columns a, b, n as one list for each stretch between ``offsets``."""
    edges = pa.array(offsets, pa.int32())
    return [pa.ListArray.from_arrays(edges, pairs[c].combine_chunks().cast(t.value_type)) for c, t in LISTS.items()]


def _partial(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most ``CHARACTERS`` together, one row at least."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > CHARACTERS:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def linked_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``LINKED``: a row per document with its pairs, and rows without ``row`` that hold partial counts of pairs (a, b, n) over documents."""

    def counted(held: list[pa.Table]) -> pa.RecordBatch:
        x = _partial(held)
        empty = [pa.nulls(1, pa.int64())] * 6 + [pa.nulls(1, pa.string())]
        return pa.RecordBatch.from_arrays([*empty, *_lists(x, np.array([0, len(x)]))], [c.split()[0] for c in LINKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, held, pairs_held = Tokenizers(path_a, path_b), [], 0
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy()
            for s, e in _cuts(sizes):
                part = batch.slice(s, e - s)
                rows, pairs = align(part.column(1).to_pylist(), tools)
                lists = _lists(pairs, np.searchsorted(pairs["doc"].to_numpy(), np.arange(len(part) + 1)))
                columns = [part.column(0), pa.array(np.arange(row, row + len(part))), *[c.combine_chunks() for c in rows.columns], *lists]
                row += len(part)
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LINKED.split(", ")])
                held.append(pairs.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "n"]))
                pairs_held += len(held[-1])
                if pairs_held > PARTIAL:
                    held = [_partial(held)]
                    pairs_held = len(held[0])
                    if pairs_held > PARTIAL // 2:
                        yield counted(held)
                        held, pairs_held = [], 0
        if held:
            yield counted(held)

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(trimming(run, TEXTS), LINKED)


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, count, best: in how many documents a pair is linked, and whether no pair of its A id is in more. The best of each A id (as many rows as A has ids) is broadcast."""
    each = linked.filter("row IS NULL").select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("x.*")
    counts = stored(each.groupBy("a", "b").agg(F.sum("n").alias("count")))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def _summed(linked: DataFrame, hot: pa.Table) -> DataFrame:
    """``SUMMED``: documents with the sums over their hot pairs, and the pairs that are left."""
    shared = linked.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        names = [c.split()[0] for c in SUMMED.split(", ")]
        for batch in batches:
            doc = pc.list_parent_indices(batch["a"]).cast(pa.int64())
            pairs = pa.table({"doc": doc, **{c: pc.list_flatten(batch[c]) for c in LISTS}}).join(counts, keys=["a", "b"], join_type="left outer", use_threads=False)
            known = pairs.filter(pc.is_valid(pairs["count"]))
            sums = np.zeros((2, len(batch)), np.int64)
            for i, c in enumerate(("best", "count")):
                np.add.at(sums[i], known["doc"].to_numpy(), pc.multiply(known["n"], known[c]).to_numpy())
            left = pairs.filter(pc.is_null(pairs["count"])).sort_by("doc")
            lists = _lists(left, np.searchsorted(left["doc"].to_numpy(), np.arange(len(batch) + 1)))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names[:7]], pa.array(sums[0]), pa.array(sums[1]), *lists], names)

    return linked.filter("row IS NOT NULL").mapInArrow(trimming(run, TEXTS), SUMMED)


def aligned(docs: DataFrame, path_a: str = PATHS[0], path_b: str = PATHS[1], hot: int = HOT) -> DataFrame:
    """A row per document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is their A id's highest in the corpus, ties
    included), count_sum (of the counts over links), groups_sha256 of the groups' ids.

    A text that is null or empty, or that either tokenizer does not give back byte by byte, has no tokens: zeros and an empty string.
    Equal rows give equal rows and count as documents each; an empty table gives none. Other columns are not read. Texts are encoded
    whole, about ``CHARACTERS`` characters or one text at once.
    """
    linked = stored(linked_pairs(docs, path_a, path_b))
    counts = stored(pair_counts(linked))
    frequent = counts.orderBy(F.desc("count"), "a", "b").limit(hot).toArrow()  # a fixed number of rows
    parts = stored(_summed(linked, frequent))
    cold = parts.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("row", "x.*").join(counts, ["a", "b"])
    cold = cold.groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum"))
    out = parts.drop("a", "b", "n").join(cold, "row", "left")
    more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
