"""Commitments and sampled checks of a batch: Merkle roots, challenges and budgets, with SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.scalar import miss_probability

MAX_CHUNK, V_MAX, U_MAX = 16, 1, 8


def chunks(n: int, limit: int = MAX_CHUNK) -> tuple[int, int]:
    """(count, size) of the fewest equal chunks of at most ``limit``."""
    count = max(1, -(-n // limit))
    return count, -(-n // count)


def chunked_hash(values: list[Column], extra: Column | None = None) -> Column:
    """SHA-256 over the digests of equal chunks of the values (padded with 0) and one further element."""
    count, size = chunks(len(values))
    padded = values + [F.lit(0)] * (count * size - len(values))
    text = lambda cs: F.concat_ws(",", *[c.cast("string") for c in cs])
    digests = [F.sha2(text(padded[i * size : (i + 1) * size]), 256) for i in range(count)]
    return F.sha2(F.concat(*digests, *([extra] if extra is not None else [])), 256)


def leaf(rule_channels: list[Column], others: list[Column]) -> Column:
    """A row's leaf: its rule channels in the open, the rest as one digest."""
    return chunked_hash(rule_channels, chunked_hash(others) if others else F.sha2(F.lit(""), 256))


def levels(leaves: DataFrame, key: list[str], depth: int) -> DataFrame:
    """key, level, pos, hash of all nodes of trees of 2^depth leaves (pos from 0); level 0 are the leaves.

    A tree's leaves are 2^depth at most by construction, so a group gathers them and hashes level after level, once.
    """
    held = _gathered(leaves, key).withColumn("l0", F.col("h"))
    for d in range(1, depth + 1):
        held = held.withColumn("h", _parents()).withColumn(f"l{d}", F.col("h"))
    nodes = F.array(*[F.struct(F.lit(d).alias("level"), F.col(f"l{d}").alias("hs")) for d in range(depth + 1)])
    each = held.select(*key, F.explode(nodes).alias("x"))
    return each.select(*key, F.col("x.level").alias("level"), F.posexplode("x.hs").alias("pos", "hash"))


def _gathered(leaves: DataFrame, key: list[str]) -> DataFrame:
    return leaves.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("h"))


def _parents():
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size("h"), 1) - 1), lambda i: F.sha2(F.concat(F.get("h", 2 * i), F.get("h", 2 * i + 1)), 256))


def padded(leaves: DataFrame, key: list[str], depth: int) -> DataFrame:
    """key, pos, hash, v, u with the missing last leaves of a tree: hash of 64 zeros, no counts. A tree's rows are gathered once, so what is grouped by ``key`` next is dealt already."""
    leaf_ = F.struct(F.col("pos").cast("long").alias("pos"), "hash", F.col("v").cast("int").alias("v"), F.col("u").cast("int").alias("u"))
    held = leaves.groupBy(*key).agg(F.collect_list(leaf_).alias("x"))
    short = F.size("x") < 2**depth
    rest = F.transform(F.sequence(F.size("x"), F.lit(2**depth - 1)), lambda i: F.struct(i.cast("long").alias("pos"), F.lit("0" * 64).alias("hash"), F.lit(0).alias("v"), F.lit(0).alias("u")))
    return held.select(*key, F.explode(F.when(short, F.concat("x", rest)).otherwise(F.col("x"))).alias("x")).select(*key, "x.*")


def openings(leaves: DataFrame, key: list[str], depth: int) -> DataFrame:
    """key, leaf, hash, siblings (lowest first), root: the path of every leaf. A tree is gathered once and gives all paths of its leaves."""
    held = _gathered(leaves, key).withColumn("l0", F.col("h"))
    for d in range(1, depth + 1):
        held = held.withColumn("h", _parents()).withColumn(f"l{d}", F.col("h"))
    each = held.select(*key, *[f"l{d}" for d in range(depth)], F.col("h")[0].alias("root"), F.posexplode("l0").alias("leaf", "hash"))
    siblings = F.array(*[F.get(f"l{d}", F.shiftright("leaf", d).bitwiseXOR(F.lit(1))) for d in range(depth)])
    return each.select(*key, "leaf", "hash", siblings.alias("siblings"), "root")


def roots(leaves: DataFrame, key: list[str], depth: int) -> DataFrame:
    """key, root."""
    held = _gathered(leaves, key)
    for _ in range(depth):
        held = held.withColumn("h", _parents())
    return held.select(*key, F.col("h")[0].alias("root"))


def folded(leaf_hash: Column, pos: Column, siblings: Column, depth: int) -> Column:
    """The root from a leaf and its sibling path, lowest first; bit 0 of pos: the running hash on the left."""
    step = lambda h, i: F.when(F.floor(pos / F.pow(F.lit(2), i)) % 2 == 0, F.sha2(F.concat(h, F.get(siblings, i)), 256)).otherwise(F.sha2(F.concat(F.get(siblings, i), h), 256))
    return F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), leaf_hash, step)


def challenges(committed: DataFrame, key: list[str], n: int, k: int, tries: int) -> DataFrame:
    """key, idx, ctr: the first k distinct of H(root, nonce, ctr) mod (n - 1) + 1 by ascending ctr; committed: key, root, nonce.

    The query fails where ``tries`` counters give fewer than k distinct indices, instead of returning a shorter challenge.
    """
    each = committed.withColumn("ctr", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    h = F.sha2(F.concat_ws("/", F.col("root"), F.col("nonce").cast("string"), F.col("ctr").cast("string")), 256)
    # 15 hex digits are 60 bits: a long
    each = each.withColumn("idx", F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % (n - 1) + 1)
    first = each.groupBy(*key, "idx").agg(F.min("ctr").alias("ctr"))
    ranked = first.withColumns({"r": F.row_number().over(Window.partitionBy(*key).orderBy("ctr")), "c": F.count("*").over(Window.partitionBy(*key))})
    enough = F.when(F.col("c") >= k, F.col("ctr")).otherwise(F.raise_error("too few tries for the challenge").cast("int"))
    return ranked.filter(F.col("r") <= k).select(*key, "idx", enough.alias("ctr"))


def sampled_check(rows: DataFrame, sample: DataFrame, key: list[str], v_max: int = V_MAX, u_max: int = U_MAX) -> DataFrame:
    """key, v, u, accepted: the sums over the sampled rows (idx) against the public budgets."""
    s = rows.join(sample, [*key, "idx"]).groupBy(*key).agg(F.sum("v").alias("v"), F.sum("u").alias("u"))
    return s.withColumn("accepted", (F.col("v") <= v_max) & (F.col("u") <= u_max))


def detection(n: Column, bad: Column, k: Column) -> Column:
    """Chance that a sample of k meets a violating row."""
    return 1 - miss_probability(n, bad, k)
