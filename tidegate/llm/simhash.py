"""SimHash near-duplicates through BK-trees.

Each text gets a 64-bit SimHash over word shingles. Distinct fingerprints, never documents, are
searched, so a group of copies costs one entry. Fingerprints that differ in at most 3 bits agree on at
least one of four blocks of 16 bits, so each is filed in four shards, one for each block's value; a shard that is larger
than ``BUCKET`` is filed again by the bits that its members do not share yet (two of five blocks of these), up to three times
more. Nothing is dropped at any level: two fingerprints within the radius meet in some shard.

A shard is a BK-tree whose children are keyed by their integer Hamming distance to the parent. Every member is a probe
and follows only edges within the radius of its distance at the node; there is no other comparison. Trees are flat arrays, and all trees of an Arrow
batch are built and walked together. Members found within the radius are joined in the task, so that a shard yields at most
one link for each member, not all pairs. Components over all links give the classes. A shard's tree goes to the task
that Spark deals its probes to, not to all executors: the trees together grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import components
from tidegate.llm.common import TEXTS, batched, cut, table, trimming, words_of

RADIUS, FIRST, BLOCKS, LEVELS, BUCKET = 3, 4, 5, 4, 4096
SHINGLE = 3
#: Nodes that one slice of probes may visit at once: bounds the memory of a walk.
WALK = 1 << 19


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned. Bit i is 1 if it is set in over half of the shingles' XXH64; no words: 0."""
    words = words_of(text, lower=True)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(list(map(len, words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist()))


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` with ``fingerprint`` (long, the 64 bits as a signed number). A null text has no words."""
    texts = batched(docs).select(F.col("text").alias("__text"), *keep)
    schema = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([simhash(t or "", shingle) for t in b.column(0).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(own.view(np.int64))], [*b.schema.names[1:], "fingerprint"])

    return texts.mapInArrow(trimming(run, TEXTS), f"{schema}, fingerprint long")


def submasks(held: int, radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Supersets of ``held``: the free bits in ``blocks`` runs, every choice of blocks - radius of them held too."""
    free = [b for b in range(64) if not held >> b & 1]
    parts = [p for p in np.array_split(np.array(free, dtype=int), min(blocks, len(free))) if len(p)]
    if len(parts) <= radius:
        return [held]
    return [held | sum(1 << int(b) for p in chosen for b in p) for chosen in combinations(parts, len(parts) - radius)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees, one for each shard, in flat arrays that are built and walked level by level.

    ``values`` holds a fingerprint a row (one or two 64-bit words), distinct within a shard; the first of a shard is its
    root. ``keys`` are the edges, sorted by (parent, integer distance to it), ``child`` their ends.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values, self.width, self.visits = values, 64 * values.shape[1] + 1, 0
        _, first, own = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first[own]
        keys, child = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        here = np.flatnonzero(self.root != np.arange(len(values)))
        at = self.root[here]
        while len(here):
            edge, which, own = np.unique(at * self.width + _distance(values[here], values[at]), return_index=True, return_inverse=True)
            keys.append(edge)
            child.append(here[which])
            later = np.ones(len(here), bool)
            later[which] = False
            here, at = here[later], here[which][own][later]
        keys, child = np.concatenate(keys), np.concatenate(child)
        order = np.argsort(keys, kind="stable")
        self.keys, self.child = keys[order], child[order]

    def near(self, probes: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """probe, node, distance for all nodes within the radius, walking from each probe's root along edges within it."""
        probe, node = np.arange(len(probes)), root
        found = [(np.zeros(0, np.int64),) * 3]
        while len(probe):
            d = _distance(probes[probe], self.values[node])
            self.visits += len(d)
            hit = d <= radius
            found.append((probe[hit], node[hit], d[hit]))
            low = np.searchsorted(self.keys, node * self.width + np.maximum(d - radius, 0))
            count = np.searchsorted(self.keys, node * self.width + np.minimum(d + radius, self.width - 1), side="right") - low
            probe = np.repeat(probe, count)
            node = self.child[np.arange(len(probe)) + np.repeat(low - np.cumsum(count) + count, count)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def slices(sizes: np.ndarray, most: int = WALK) -> Iterator[slice]:
    """Consecutive slices of probes whose trees hold ``most`` nodes in sum (or one probe)."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, stop)
        at = stop


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node that the links a, b lead to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def shard_links(values: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (root, member) that join the distinct ``values`` (n x words) of each shard within the radius, at most one a
    member, and the number of nodes that the walks visited."""
    forest = Forest(values, shard)
    _, own, size = np.unique(shard, return_inverse=True, return_counts=True)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in slices(size[own]):
        probe, node, _ = forest.near(values[part], forest.root[part], radius)
        probe = probe + part.start
        later = probe > node
        a.append(node[later])
        b.append(probe[later])
    label = least_reachable(len(values), np.concatenate(a), np.concatenate(b))
    member = np.flatnonzero(label != np.arange(len(values)))
    return label[member], member, forest.visits


def runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Tables of whole runs that agree in the first ``by`` columns, from batches sorted by these; a run is bounded by the caller."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        keys = [t.column(c).to_numpy() for c in range(by)]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if held and any(h != k[0] for h, k in zip((held[-1].column(c)[-1].as_py() for c in range(by)), keys, strict=True)):
            yield pa.concat_tables(held)
            held = []
        if len(change):
            yield pa.concat_tables([*held, t.slice(0, int(change[-1]))])
            held, t = [], t.slice(int(change[-1]))
        held.append(t)
    if held:
        yield pa.concat_tables(held)


def numbered(*columns: np.ndarray) -> np.ndarray:
    """The number of the run that each row of sorted columns lies in."""
    change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.concatenate([[0], np.cumsum(change)]) if len(columns[0]) else np.zeros(0, np.int64)


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp) sorted by these: each run of mask and key is a shard."""
    for t in runs(batches, 2):
        mask, key, fp = (c.to_numpy() for c in t.columns)
        a, b, _ = shard_links(fp.view(np.uint64).reshape(-1, 1), numbered(mask, key), radius)
        yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that connect the distinct fingerprints ``fps`` (column fp) exactly as all pairs within the radius do."""
    spark = fps.sparkSession
    masks = submasks(0, radius, FIRST)
    filed = fps.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp")
    small = None
    for level in range(LEVELS):
        filed = filed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        counts = filed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        sized = filed.join(counts, ["mask", "key"])
        last = level == LEVELS - 1
        here = (sized if last else sized.filter(F.col("n") <= bucket)).select("mask", "key", "fp")
        small = here if small is None else small.unionByName(here)
        if last or counts.filter(F.col("n") > bucket).isEmpty():
            break
        # at most 4 * 10 ** (level + 1) masks, whatever the input
        below = [(_signed(m), _signed(x)) for m in masks for x in submasks(m, radius)]
        masks = sorted({x for m in masks for x in submasks(m, radius)})
        finer = F.broadcast(spark.createDataFrame(below, "mask long, finer long"))
        filed = sized.filter(F.col("n") > bucket).join(finer, "mask").select(F.col("finer").alias("mask"), "fp").distinct()
    dealt = small.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(trimming(lambda b: _search(b, radius)), "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """fingerprint, component_id for each distinct fingerprint of ``prints`` (doc_id, fingerprint).

    component_id is the least doc_id among all documents whose fingerprints are linked, directly or on. A null doc_id
    counts only where a component has no other.
    """
    firsts = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    own = components.roots(links(firsts.select(F.col("fingerprint").alias("fp")), radius, bucket))
    joined = firsts.join(own, firsts["fingerprint"] == own["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return joined.join(least, "root").select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id.

    Texts without words have fingerprint 0 and are linked like any other; repeated rows stay; an empty
    table gives no rows. The fingerprints are checkpointed, so texts are read once.
    """
    prints = cut(fingerprints(docs, ["doc_id"]))
    found = prints.join(classes(prints), "fingerprint")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
