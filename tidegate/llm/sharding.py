"""Hierarchical weighted hash tree: region, rack, shard.

A row's key is drawn against every child of a node: child ``c`` of weight ``w`` scores
``-ln(u) / w`` with ``u`` uniform in (0, 1) from MD5(key, path of c); the least score wins, so a
child is chosen with probability ``w / sum(w)``. The draw of a child depends on its own path and
weight alone. A change of weights below one node therefore moves rows only between the subtrees
whose weights changed; draws between other children keep their winners.

Growth by one shard joins it as a subtree of its own at the root (a region with one rack with one
shard). No older weight changes, so the only rows that move are those that the new subtree wins,
and they go to the new shard: the law is ``key``.

All of it is column expressions; the only shuffle carries five small columns, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm.common import clean_text, table

SHARDS, REGIONS, RACKS = 40, 4, 2
#: Slots are dealt within this many hash buckets of each shard; bounds the table of offsets.
SLOT_BUCKETS = 1024

Tree = list[list[list[tuple[int, float]]]]


def topology(shards: int = SHARDS, regions: int = REGIONS, racks: int = RACKS, extra: int = 0, weights: dict[int, float] | None = None) -> Tree:
    """regions[racks[(shard, weight)]]: ``shards`` dealt evenly, then ``extra`` regions of one shard each."""
    leaf = lambda s: (s, float((weights or {}).get(s, 1.0)))
    cells = [[[] for _ in range(racks)] for _ in range(regions)]
    for s in range(shards):
        place = s * regions * racks // shards
        cells[place // racks][place % racks].append(leaf(s))
    tree = [[rack for rack in region if rack] for region in cells]
    return [region for region in tree if region] + [[[leaf(s)]] for s in range(shards, shards + extra)]


def _unit(key: Column, path: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, path)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def _winner(key: Column, children: Column) -> Column:
    """children: array of struct(path, weight, at); the ``at`` of the least score, ties to the least ``at``."""
    drawn = F.transform(children, lambda c: F.struct((-F.ln(_unit(key, c["path"])) / c["weight"]).alias("score"), c["at"].alias("at")))
    return F.array_min(drawn)["at"]


def _nodes(rows: list[tuple[str, float, int]]) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight"), F.lit(at).alias("at")) for p, w, at in rows])


def levels(tree: Tree) -> tuple[list, list, list]:
    """The children of the root, of each region, and of each rack of each region, as (path, weight, at)."""
    if any(w <= 0 for region in tree for rack in region for _, w in rack):
        raise ValueError("weights must be positive")
    total = lambda rack: sum(w for _, w in rack)
    root = [(f"r{i}", sum(map(total, region)), i) for i, region in enumerate(tree)]
    racks = [[(f"r{i}.k{j}", total(rack), j) for j, rack in enumerate(region)] for i, region in enumerate(tree)]
    leaves = [[[(f"r{i}.k{j}.s{s}", w, s) for s, w in rack] for j, rack in enumerate(region)] for i, region in enumerate(tree)]
    return root, racks, leaves


def place(df: DataFrame, key: str, tree: Tree, out: str = "shard") -> DataFrame:
    """``df`` with column ``out``: the shard that the tree gives to ``key`` (a string column; null reads as "null")."""
    root, racks, leaves = levels(tree)
    at = F.coalesce(F.col(key), F.lit("null"))
    region, rack = f"__{out}_region", f"__{out}_rack"
    df = df.withColumn(region, _winner(at, _nodes(root)))
    df = df.withColumn(rack, _winner(at, F.element_at(F.array(*[_nodes(x) for x in racks]), F.col(region) + 1)))
    below = F.element_at(F.element_at(F.array(*[F.array(*[_nodes(x) for x in y]) for y in leaves]), F.col(region) + 1), F.col(rack) + 1)
    return df.withColumn(out, _winner(at, below)).drop(region, rack)


def assign(docs: DataFrame, shards: int = SHARDS, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots number a shard's rows from 0 without gaps, by (hash bucket, doc_id, size, crc). Counts per
    (shard, bucket) - at most (shards) x (buckets) rows - give each bucket its first slot, so no task
    ever orders a whole shard, nor all texts of one repeated or null id. A null text has size 16 and crc 0; a null doc_id is keyed as "null";
    repeated ids share a shard and get slots of their own; an empty table gives no rows.
    """
    text = clean_text()
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col("doc_id").cast("string").alias("__key"))
    drawn = F.md5(F.concat_ws("/", F.coalesce("__key", F.lit("null")), F.lit("slot"), F.col("size").cast("string"), F.col("text_crc32").cast("string")))
    rows = place(rows, "__key", topology(shards)).withColumn("__bucket", (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "size", "text_crc32")
    rows = rows.withColumn("__n", F.row_number().over(within)).join(F.broadcast(first), ["shard", "__bucket"])
    rows = place(rows, "__key", topology(shards, extra=1), "grown_shard")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__first") + F.col("__n") - 1).cast("long").alias("slot"), "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _sql_place(tree: Tree, name: str) -> str:
    root, racks, leaves = levels(tree)
    a = _values((p, w, i) for p, w, i in root)
    b = _values((i, p, w, j) for i, region in enumerate(racks) for p, w, j in region)
    c = _values((i, j, p, w, s) for i, region in enumerate(leaves) for j, rack in enumerate(region) for p, w, s in rack)
    u = "((('0x' || substr(md5(key || '/' || path), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"
    best = lambda at: f"arg_min({at}, {{'score': -ln({u}) / weight, 'tie': {at}}})"
    return f"""
{name}_a AS (SELECT key, {best('node')} AS region FROM keys, (VALUES {a}) AS n(path, weight, node) GROUP BY key),
{name}_b AS (SELECT key, k.region, {best('node')} AS rack FROM {name}_a AS k JOIN (VALUES {b}) AS n(region, path, weight, node) ON n.region = k.region GROUP BY key, k.region),
{name} AS (SELECT key, {best('node')} AS {name} FROM {name}_b AS k JOIN (VALUES {c}) AS n(region, rack, path, weight, node) ON n.region = k.region AND n.rack = k.rack GROUP BY key)"""


def sql() -> str:
    table_sql = "(SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8)::BIGINT[], lambda acc, b: xor(acc >> 1, (acc & 1) * 3988292384), i::BIGINT) AS v FROM range(0, 256) AS r(i)))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, coalesce(text, '') AS text FROM documents),
keys AS (SELECT DISTINCT key FROM docs),{_sql_place(topology(), 'shard')},{_sql_place(topology(extra=1), 'grown_shard')},
crc AS (SELECT rid, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT), lambda acc, b: xor(acc >> 8, c.t[xor(acc & 255, b) + 1]), 4294967295), 4294967295) AS text_crc32 FROM docs, {table_sql} AS c),
placed AS (SELECT d.doc_id, (octet_length(encode(d.text)) + 16)::BIGINT AS size, text_crc32, s.shard, g.grown_shard,
  (('0x' || substr(md5(d.key || '/slot/' || (octet_length(encode(d.text)) + 16) || '/' || text_crc32), 1, 8))::BIGINT) % {SLOT_BUCKETS} AS bucket
  FROM docs AS d JOIN crc USING (rid) JOIN shard AS s ON s.key = d.key JOIN grown_shard AS g ON g.key = d.key)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard
FROM placed"""
