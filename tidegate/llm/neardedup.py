"""Near-duplicate removal on whole texts: SimHash, BK-trees, and exact verification on word shingles.

Two texts are near copies if the sets of their 5-word shingles (lower case A-Z) have a Jaccard
similarity of 0.8 or more; near copies of near copies form a group, of which the document of the least
doc_id stays.

1. One pass gives each text its digest, a 128-bit SimHash and ``BANDS`` keys, each a hash of three independent minima.
   Equal texts are one entry. Entries that share a key are a shard: at a similarity of 0.8 two share at least one
   with a chance of 1 - (1 - 0.8 ** 3) ** 20 = 0.9999994, more above. A shard over ``BUCKET`` entries is dealt in parts by a hash of the entry.
2. Attachment: each entry walks a BK-tree (children keyed by integer Hamming distance to the parent, only edges within
   ``RADIUS`` bits followed; at a similarity of 0.8 SimHash differs in 19 bits of 128, with a standard deviation of 4) and takes two entries:
   of those within ``SURE`` bits the first and the last, else the nearest. The tree of a shard in parts holds about
   ``LEADERS`` of its entries and is given to every part. So an entry of a family of any size costs two checks. Attachments are checked by joining
   both texts to them; verified pairs are links, their components the families. Further rounds (``ROUNDS`` in all) attach to other families in shards that still hold several.
3. The rest, by prefixes, which lose no pair: in shards that still hold several families, shingles are ordered from rare to common. Two sets of
   a similarity of 0.8 share one of the first n - ceil(0.8 n) + 1 shingles of either, so entries meet by these alone: text that many documents
   share comes last and is no meeting place. Where two meet, what is left of both sets behind the shingle and their sizes bound the similarity;
   most shards have no pair of two families that could reach 0.8. Pairs that could, whose SimHash is within ``FAR`` bits (at least four and a half deviations over what is
   expected), are given where they meet first, as far as the ``RECENT`` places before tell, and verified on their lists of shingles. No task holds a family or its pairs, and no text is copied to a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import components
from tidegate.llm.common import TEXTS, batched, clean_text, sized, stored, trimming, words_of
from tidegate.llm.decontamination import CHUNK as BYTES
from tidegate.llm.decontamination import ByteHashes, WordHashes, rolled, shingles
from tidegate.llm.simhash import Forest, numbered, runs, slices

SHINGLE, SIMILARITY, RADIUS, SURE, FAR = 5, 0.8, 32, 12, 44
BANDS, ROWS, BUCKET, LEADERS, MEMBERS = 20, 3, 256, 64, 65_536
#: Rounds of attachment; pairs of a shard that are compared at once; earlier meeting places that an entry remembers.
ROUNDS, COMPARED, RECENT = 3, 1 << 19, 16
#: Seeds and odd factors of the minima (two of 32 bits from each 64-bit hash) and of the two words of SimHash, and hashes mixed at once.
_SEEDS = np.random.default_rng(20).integers(0, 2**64, (2, BANDS * ROWS // 2 + 2, 1), dtype=np.uint64) | np.array([[[0]], [[1]]], np.uint64)
CHUNK = 4096
_HALF = np.uint64(32)


def shingle_set(text: str, known: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; a text under five words is one shingle, one without words has none."""
    words = words_of(text, lower=True)
    return np.unique(shingles(words, min(SHINGLE, len(words)), known)) if words else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 on 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sketch(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the distinct shingle hashes: bits set in each place of two 64-bit words, and the minima. An empty set has its own."""
    least = np.full((2, BANDS * ROWS // 2), 2**32 - 1, np.uint64)
    ones = np.zeros((2, 64), np.int64)
    for at in range(0, len(h), CHUNK):
        x = (h[None, at : at + CHUNK] ^ _SEEDS[0]) * _SEEDS[1]
        x ^= x >> _HALF
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x[-2:].astype("<u8").view(np.uint8).reshape(2, -1, 8), axis=2, bitorder="little")
        for i in range(0, bits.shape[1], 255):
            ones += bits[:, i : i + 255].sum(axis=1, dtype=np.uint8)
        x = x[:-2]
        np.minimum(least[0], x.min(axis=1) >> _HALF, out=least[0])
        x <<= _HALF
        np.minimum(least[1], x.min(axis=1) >> _HALF, out=least[1])
    return 2 * ones > len(h), least.ravel()


def shingle_sets(texts: list[str], bytes_: ByteHashes) -> Iterator[np.ndarray]:
    """As ``shingle_set``, by hashes of its own that are the same for texts of every length."""
    for part in byte_chunks(texts):
        if len(part[0]) < BYTES:
            h, first = bytes_.words(part)
            own = [h[s:e] for s, e in zip(first, first[1:], strict=False)]
        else:
            own = [_long_words(part[0], bytes_)]
        for w in own:
            yield np.unique(rolled(w, min(SHINGLE, len(w)))) if len(w) else w


def _long_words(raw: bytes, bytes_: ByteHashes) -> np.ndarray:
    """Hashes of the words of one long text, BYTES of them at a time; a word of BYTES itself has a hash of another kind."""
    out, held, size = [np.zeros(0, np.uint64)], [], 0

    def take() -> None:
        out.append(bytes_.words([b" ".join(held)])[0])
        held.clear()

    for word in raw.lower().split():
        if held and (size + len(word) + 2 > BYTES):
            take()
            size = 0
        if len(word) + 2 > BYTES:
            out.append(np.array([xxhash.xxh64_intdigest(word)], np.uint64))
            continue
        held.append(word)
        size += len(word) + 1
    if held:
        take()
    return np.concatenate(out)


def sketches(texts: list[str], bytes_: ByteHashes) -> tuple[np.ndarray, np.ndarray]:
    """For each text SimHash as two signed numbers, and its keys."""
    found = [sketch(x) for x in shingle_sets(texts, bytes_)]
    if not found:
        return np.zeros((0, 2), np.int64), np.zeros((0, BANDS), np.int64)
    bands = np.stack([x[1] for x in found]).reshape(len(found), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(found), BANDS))
    for r in range(ROWS):
        keys = _mixed(keys ^ (bands[:, :, r] + np.uint64(0x9E3779B97F4A7C15)))
    return np.packbits(np.stack([x[0] for x in found]), axis=2, bitorder="little").view("<i8").reshape(-1, 2), keys.view(np.int64)


def byte_chunks(texts: list[str]) -> Iterator[list[bytes]]:
    """Consecutive texts of less than BYTES together, with their ends; a longer one alone."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        raw = t.encode("utf-8", "replace")
        if part and size + len(raw) + 1 > BYTES:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield part


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bytes_ = ByteHashes()
    for b in batches:
        prints, keys = sketches(b.column(2).to_pylist(), bytes_)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists], ["id", "digest", "low", "high", "keys"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From rows sorted by key and part, in which ``role`` is 0 for an entry of the tree, 1 for a probe and 2 for both:
    the columns, and probe, entry and distance of the pairs of two components within the radius, in slices."""
    for t in runs(batches, 2):
        key, part, role, comp = (t.column(c).to_numpy() for c in ("key", "part", "role", "comp"))
        prints = np.stack([t.column(c).to_numpy() for c in ("low", "high")], axis=1).view(np.uint64)
        shard = numbered(key, part)
        inside = np.flatnonzero(role != 1)
        # entries of one fingerprint are one node
        order = inside[np.lexsort((inside, prints[inside, 1], prints[inside, 0], shard[inside]))]
        node = numbered(shard[order].astype(np.uint64), prints[order, 0], prints[order, 1])
        first = np.flatnonzero(np.diff(node, prepend=-1))
        held = np.diff(first, append=len(order))
        forest = Forest(prints[order[first]], shard[order[first]])
        roots = np.full(int(shard[-1]) + 1, -1, np.int64)
        roots[shard[order[first]]] = forest.root
        probes = np.flatnonzero((role != 0) & (roots[shard] >= 0))
        size = np.bincount(shard[inside], minlength=len(roots))
        for part in slices(size[shard[probes]]):
            own = probes[part]
            at, hit, d = forest.near(prints[own], roots[shard[own]], RADIUS)
            at, d, entry = np.repeat(own[at], held[hit]), np.repeat(d, held[hit]), order[np.arange(int(held[hit].sum())) + np.repeat(first[hit] - np.cumsum(held[hit]) + held[hit], held[hit])]
            other = comp[at] != comp[entry]
            yield t, at[other], entry[other], d[other]


def _pairs(t: pa.Table, a: np.ndarray, b: np.ndarray, d: np.ndarray, last: bool = False) -> pa.RecordBatch:
    digest = t.column("digest").combine_chunks()
    return pa.RecordBatch.from_arrays([digest.take(pa.array(a)), digest.take(pa.array(b)), pa.array(d.astype(np.int32)), pa.array(np.full(len(a), last))], ["a", "b", "distance", "last"])


def _attached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each probe two entries (a) of the tree: the first and the last within SURE bits, else at the least distance."""
    for t, probe, entry, d in _trees(batches):
        rank = np.where(d <= SURE, 0, d)
        for last in (False, True):
            order = np.lexsort((-entry if last else entry, rank, probe))
            chosen = order[np.flatnonzero(np.diff(probe[order], prepend=-1))]
            yield _pairs(t, entry[chosen], probe[chosen], d[chosen], last)


PAIR, ROW = "a binary, b binary, distance int, last boolean", ("key", "part", "role", "digest", "low", "high", "comp")


def _walked(rows: DataFrame, walk, schema: str, *more: str) -> DataFrame:
    return rows.select(*ROW, *more).repartition("key", "part").sortWithinPartitions("key", "part", "digest").mapInArrow(trimming(walk), schema)


def _parts(n, bucket: int):
    return F.ceil(F.col(n) / bucket).cast("int")


def filed(entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """key, n, part, digest, low, high: a row for each key that an entry (digest, low, high, keys) shares with ``n`` - 1 others."""
    rows = entries.select(F.explode("keys").alias("key"), "digest", "low", "high")
    counts = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    # rows of a hot key meet its count in as many places as it has parts
    hot = sized(counts.filter(F.col("n") > bucket).select("key", _parts("n", bucket).alias("parts")))
    rows = rows.join(hot, "key", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("digest", "key"), F.col("parts"))).cast("int")).drop("parts")
    spread = counts.select("key", "n", F.explode(F.sequence(F.lit(0), _parts("n", bucket) - 1)).alias("part"))
    return stored(rows.join(spread, ["key", "part"]))


def attach(rows: DataFrame, bucket: int = BUCKET, leaders: int = LEADERS) -> DataFrame:
    """a, b: for each entry of ``rows`` (as ``filed``, with comp) two entries at most to check: those within SURE bits of the least and of
    the greatest digest over all its shards, else the nearest ones. So all of a family meet the same few entries."""
    whole = rows.filter(F.col("n") <= bucket).withColumn("role", F.lit(2))
    large = rows.filter(F.col("n") > bucket)
    chosen = large.filter(F.pmod(F.xxhash64("digest"), F.col("n")) < leaders)
    given = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), _parts("n", bucket) - 1))).withColumn("role", F.lit(0))
    tried = _walked(whole.unionByName(large.withColumn("role", F.lit(1))).unionByName(given), _attached, PAIR)
    rank = F.when(F.col("distance") <= SURE, 0).otherwise(F.col("distance"))
    first = F.min(F.when(~F.col("last"), F.struct(rank.alias("rank"), "a")))["a"]
    last = F.max(F.when(F.col("last"), F.struct((-rank).alias("rank"), "a")))["a"]
    best = tried.groupBy("b").agg(F.array_distinct(F.array(first, last)).alias("best")).select(F.explode("best").alias("a"), "b")
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bytes_ = ByteHashes()
    for b in batches:
        sets = list(shingle_sets(b.column(1).to_pylist(), bytes_))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), lists], ["no", "n", "hs"])


def prefixes(lists: DataFrame) -> DataFrame:
    """h, no, n, i, recent: the shingles by which an entry of ``lists`` (no, n, hs) can meet another: those of its first n - ceil(0.8 n) + 1, from rare to
    common, that stand in another entry too; ``i`` counts the rarer ones of the entry, ``recent`` holds the last of these that others have."""
    rows = lists.select("no", "n", F.explode("hs").alias("h"))
    shared = stored(rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"))
    own = rows.join(shared, "h").groupBy("no", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    # shingles of no other entry are the rarest
    own = own.withColumn("alone", F.col("n") - F.size("s")).withColumn("keep", F.expr("n - (4 * n + 4) DIV 5 + 1 - alone"))
    own = own.filter("keep > 0").withColumn("first", F.transform(F.slice("s", F.lit(1), F.greatest(F.col("keep"), F.lit(0)).cast("int")), lambda x: x["h"]))
    first = own.select("no", "n", "alone", "first", F.posexplode("first").alias("at", "h"))
    recent = F.slice("first", F.greatest(F.col("at") - RECENT + 1, F.lit(1)), F.least(F.col("at"), F.lit(RECENT)))
    return first.select("h", "no", "n", (F.col("alone") + F.col("at")).alias("i"), recent.alias("recent"))


def candidates(meetings: DataFrame, members: int = MEMBERS) -> DataFrame:
    """a, b: pairs of entries of two families that meet in ``meetings`` (h, no, n, i, recent, comp, low, high) and could be near copies there.

    Entries outside of the shard's largest family are compared, by size and what is left behind the shingle; a shard is dealt in parts of ``members`` entries.
    """
    sizes = meetings.groupBy("h", "comp").agg(F.count("*").alias("held"), F.min("n").alias("least"), F.max("n").alias("most"))
    shards = sizes.groupBy("h").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("held", "comp")).alias("main"), F.min("least").alias("least"), F.max("most").alias("most"), F.ceil(F.sum("held") / members).cast("int").alias("parts"))
    open_ = stored(shards.filter("comps > 1").drop("comps"))
    # 9 times what both share is at least 4 times their sizes' sum; what one shares is at most what is left to it, and at most the other
    room = F.expr("9 * (n - i) - 4 * n")
    rows = meetings.join(open_, "h").filter((room >= 4 * F.col("least")) & F.expr("4 * n <= 5 * most")).drop("least", "most")
    rows = stored(rows)
    held = rows.withColumn("part", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int")).withColumn("role", F.lit(0))
    tried = rows.filter("comp <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("role", F.lit(1))
    both = held.unionByName(tried).select("h", "part", "role", "no", "n", "i", "comp", "low", "high", "recent")
    return both.repartition("h", "part").sortWithinPartitions("h", "part", "role", "n").mapInArrow(trimming(_compared), "a long, b long").distinct()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by h, part, role and n: entries of the part (role 0), then those to compare with them."""
    for t in runs(batches, 2):
        h, part, role, no, n, i, comp, low, high = (c.to_numpy() for c in t.columns[:9])
        low, high = low.view(np.uint64), high.view(np.uint64)  # bits of a signed number are counted without its sign
        recent = _padded(t.column("recent").combine_chunks())
        shard = numbered(h, part)
        inside, probes = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        wide = int(n.max()) + 2
        at = shard[inside] * wide + n[inside]  # sorted
        # partners have 0.8 to 1.25 times the size, and no more than what is left to the probe allows
        least, most = -(-4 * n[probes] // 5), np.minimum(5 * n[probes] // 4, (9 * (n[probes] - i[probes]) - 4 * n[probes]) // 4)
        start = np.searchsorted(at, shard[probes] * wide + least)
        stop = np.searchsorted(at, shard[probes] * wide + np.clip(most, 0, wide - 1), side="right")
        count = np.maximum(stop - start, 0)
        for own in slices(count, COMPARED):
            c = count[own]
            x = np.repeat(probes[own], c)
            y = inside[np.arange(len(x)) + np.repeat(start[own] - np.cumsum(c) + c, c)]
            ok = (comp[x] != comp[y]) & (9 * (n[y] - i[y]) >= 4 * (n[x] + n[y]))
            x, y = x[ok], y[ok]
            ok = np.bitwise_count(low[x] ^ low[y]).astype(np.int64) + np.bitwise_count(high[x] ^ high[y]) <= FAR
            x, y = x[ok], y[ok]
            met = [_share(recent[x[at : at + CHUNK]], recent[y[at : at + CHUNK]]) for at in range(0, len(x), CHUNK)]  # they have met before
            first = ~np.concatenate([*met, np.zeros(0, bool)])
            x, y = no[x[first]], no[y[first]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _padded(lists: pa.ListArray) -> np.ndarray:
    """A row of ``RECENT`` numbers for each list, filled up with 0."""
    size = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), RECENT), np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def _share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of the same place have a number other than 0 in common."""
    return ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] != 0)).any(axis=(1, 2))


def prefix_links(active: DataFrame, texts: DataFrame, members: int = MEMBERS) -> DataFrame:
    """a, b: the near copies of two families (comp) among the entries ``active`` (digest, comp, low, high), by digest."""
    named = stored(active.withColumn("no", F.monotonically_increasing_id()))
    lists = stored(named.select("no", "digest").join(texts, "digest").select("no", "text").mapInArrow(trimming(_listed, TEXTS), "no long, n long, hs array<long>"))
    pairs = stored(candidates(prefixes(lists).join(named.drop("digest"), "no"), members))
    own = lambda side: lists.select(F.col("no").alias(side), F.col("hs").alias(f"h_{side}"))
    both = F.size(F.array_intersect("h_a", "h_b"))
    near = pairs.join(own("a"), "a").join(own("b"), "b").filter(9 * both >= 4 * (F.size("h_a") + F.size("h_b"))).select("a", "b")
    digest = lambda side: named.select(F.col("no").alias(side), F.col("digest").alias(f"d_{side}"))
    return near.join(digest("a"), "a").join(digest("b"), "b").select(F.col("d_a").alias("a"), F.col("d_b").alias("b"))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y):
        return len(x) == len(y)
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, first, second (texts) -> the pairs that are near copies. The first text's shingles serve its next pair."""
    known, held, own = WordHashes(), None, np.zeros(0, np.uint64)
    for batch in batches:
        good = []
        for a, x, y in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
            if a != held:
                held, own = a, shingle_set(x.as_py(), known)
            good.append(similar(own, shingle_set(y.as_py(), known)))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts (digest, text) are near copies. Both joins are of plain rows, so Spark may split a hot side."""
    second = pairs.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("second")), "b")
    both = second.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("first")), "a")
    return both.select("a", "b", "first", "second").mapInArrow(trimming(_checked, TEXTS), "a binary, b binary")


def groups(entries: DataFrame, docs: DataFrame, bucket: int = BUCKET, leaders: int = LEADERS, members: int = MEMBERS) -> DataFrame:
    """node, root: the digests of all entries that have a near copy, with the least one of their group."""
    rows = filed(entries, bucket)
    wanted = rows.select("digest").distinct()
    texts = stored(docs.select(_digest().alias("digest"), clean_text().alias("text")).join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text")))
    active, links = rows.withColumn("comp", F.xxhash64("digest")), None
    for _ in range(ROUNDS):
        found = verified(stored(attach(active, bucket, leaders)), texts)
        links = stored(found if links is None else links.union(found))
        own = components.roots(links)
        label = own.select(F.col("node").alias("digest"), F.xxhash64("root").alias("label"))
        labelled = rows.join(label, "digest", "left").withColumn("comp", F.coalesce("label", F.xxhash64("digest"))).drop("label")
        open_keys = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
        active = stored(labelled.join(sized(stored(open_keys)), "key", "left_semi"))
        if active.isEmpty():
            return own
    entry = active.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("comp", "low", "high")])
    return components.roots(links.union(prefix_links(entry, texts, members)))


def _digest():
    return F.unhex(F.md5(clean_text()))


def keep_one(docs: DataFrame, bucket: int = BUCKET, leaders: int = LEADERS, members: int = MEMBERS) -> DataFrame:
    """``docs`` with one row of each group of exact and near copies: that of the least doc_id (null comes last).

    Null and empty texts are one group. Of rows alike in doc_id and text one stays, chosen by a hash of its columns. Columns are those of
    ``docs``, whatever their names. Empty tables stay empty.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    entries = batched(docs).select(order.alias("id"), _digest().alias("digest"), clean_text().alias("text")).mapInArrow(trimming(_sketches, TEXTS), "id long, digest binary, low long, high long, keys array<long>")
    entries = stored(entries.groupBy("digest").agg(F.min("id").alias("id"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("keys").alias("keys")))
    group = groups(entries, docs, bucket, leaders, members)
    grouped = entries.select("digest", "id").join(group.withColumnRenamed("node", "digest"), "digest")
    keepers = grouped.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("k"))
    losers = grouped.join(keepers, "root").filter(F.col("digest") != F.col("k.digest")).select("digest")
    # a document travels as one value, so that its columns may have any names
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = F.xxhash64(F.to_json(F.struct(F.lit(0), *[c for c, n in zip(columns, docs.columns, strict=True) if n != "text"])))
    rows = docs.select(_digest().alias("digest"), order.alias("id"), rest.alias("rest"), F.struct(*columns).alias("row"))
    alone = rows.groupBy("digest").agg(F.min_by("row", F.struct("id", "rest")).alias("row"))
    return alone.join(losers, "digest", "left_anti").select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of exact and near copies."""
    return keep_one(docs)
