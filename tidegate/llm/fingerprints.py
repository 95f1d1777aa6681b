r"""Merkle-tree fingerprints of documents over sections and paragraphs.

A text splits into sections at ``\n\n``, a section into paragraphs at ``\n``, a paragraph into leaves
of up to ``LEAF_WORDS`` space-separated words with the spaces that follow; joining the parts back
gives the text, so nothing escapes the tree. Leaves carry SHA-256 of their text, each inner node
SHA-256 of its children's digests. Roots are equal exactly where texts are equal (up to SHA-256), and
comparing the nodes of two trees from the root down locates an edit: equal roots end the walk, equal sections are not entered,
and the paragraphs that differ are the places (``changed_paragraphs``).

The fingerprint is ``root|section|section...``: 32 hex digits of the root, then each section's
paragraphs joined by ``;``, each paragraph its leaves' first 8 hex digits. Likeness of two
fingerprints is 1 for equal roots, else distinct leaves in common over the larger number of leaves.

Everything is column expressions over the built-in functions.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm.common import clean_text, table

LEAF_WORDS, LEAF_HEX, ROOT_HEX = 8, 8, 32
LEAF = rf"(?:[^ ]++ *+| ++){{1,{LEAF_WORDS}}}+"
#: Rows of one range of ids that a task holds together, and the most ranges (bounds the table of heads and the splits).
RANGE_ROWS, MAX_RANGES = 256, 16_384
#: Parts of one id's range are numbered below this.
PARTS = 1 << 20


def tree(text: Column) -> Column:
    """sections<paragraphs<leaves<SHA-256 hex>>> of a text."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ","), 256)


def fingerprint_of(tree_: Column) -> Column:
    root = node(F.transform(tree_, lambda s: node(F.transform(s, node))))
    short = lambda leaves: F.array_join(F.transform(leaves, lambda h: F.substring(h, 1, LEAF_HEX)), "")
    body = F.array_join(F.transform(tree_, lambda s: F.array_join(F.transform(s, short), ";")), "|")
    return F.concat(F.substring(root, 1, ROOT_HEX), F.lit("|"), body)


def leaves_of(fingerprint: Column) -> Column:
    return F.regexp_extract_all(F.substring(fingerprint, ROOT_HEX + 2, 2**31 - 1), F.lit(f"[0-9a-f]{{{LEAF_HEX}}}"), F.lit(0))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with ``out``: 0 to 1 for the fingerprints in columns a and b; 1 exactly for equal ones."""
    # the distinct leaves stand as columns of their own, so that each list is made once
    df = df.withColumns({"__x": F.array_distinct(leaves_of(F.col(a))), "__y": F.array_distinct(leaves_of(F.col(b)))})
    common = F.size(F.array_intersect("__x", "__y")) / F.greatest(F.size("__x"), F.size("__y"), F.lit(1))
    same = F.substring(a, 1, ROOT_HEX) == F.substring(b, 1, ROOT_HEX)
    return df.withColumn(out, F.when(same, F.lit(1.0)).otherwise(F.least(common, F.lit(1.0 - 1e-9)))).drop("__x", "__y")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn("__tree", tree(F.col(text))).withColumn(out, fingerprint_of(F.col("__tree"))).drop("__tree")


def branches(fingerprint: Column) -> Column:
    """The sections of a fingerprint, each as text that stands for its branch."""
    return F.split(F.substring(fingerprint, ROOT_HEX + 2, 2**31 - 1), r"\|", -1)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Array of struct(section, paragraph) of the places, from 0, where two trees differ, from their ``branches``.

    A branch that only one tree has differs in each of its paragraphs.
    """
    pairs = F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda z, i: F.struct(i.alias("i"), z["x"].alias("x"), z["y"].alias("y")))
    entered = F.filter(pairs, lambda z: ~z["x"].eqNullSafe(z["y"]))
    split = lambda x: F.split(F.coalesce(x, F.lit("-")), ";", -1)

    def places(z: Column) -> Column:
        differs = F.zip_with(split(z["x"]), split(z["y"]), lambda p, q: ~p.eqNullSafe(q))
        marked = F.transform(differs, lambda d, j: F.struct(z["i"].alias("section"), j.alias("paragraph"), d.alias("differs")))
        return F.transform(F.filter(marked, lambda m: m["differs"]), lambda m: F.struct(m["section"], m["paragraph"]))

    return F.flatten(F.transform(entered, places))


def id_ranges(docs: DataFrame, tie: str) -> Column:
    """A column that numbers ranges of (doc_id, ``tie``), ascending with both, each of about RANGE_ROWS rows; null ids come first.

    Splits are quantiles of the ids, so outliers and dense spots make no large range. Ids (null is one) with more rows than a
    range are ranges of their own, in parts by the leading hexadecimal digits of ``tie``. Driver and expressions hold some
    3 * MAX_RANGES numbers at every size. Rows alike in id and ``tie`` stay together.
    """
    n = docs.count()
    target = max(RANGE_ROWS, -(-n // MAX_RANGES))
    many = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().filter(F.col("count") > target).collect()}
    parts = max(1, -(-n // target))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 4 * parts + 100)).first()[0] or []
    splits = sorted({*cuts, *(x for i in many if i is not None for x in (i, min(i + 1, 2**63 - 1)))})
    text = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  folded to a literal array
    # binary search: the number of splits at or under the id
    steps = [1 << k for k in range(len(splits).bit_length() - 1, -1, -1)]
    held = text(splits) if splits else F.array().cast("array<bigint>")
    under = F.aggregate(F.array(*map(F.lit, steps or [1])), F.lit(0), lambda at, step: F.when((at + step <= len(splits)) & (F.get(held, at + step - 1) <= F.col("doc_id")), at + step).otherwise(at))
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(under + 1)
    of = [1] * (len(splits) + 2)
    for i, count in many.items():
        of[0 if i is None else bisect_right(splits, i) + 1] = min(-(-count // target), PARTS)
    part = F.floor(F.conv(F.substring(tie, 1, 8), 16, 10).cast("long") * F.get(text(of), place) / 2**32)
    return place.cast("long") * PARTS + part


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint with next_text and next_fingerprint: the following row by descending doc_id.

    Rows meet in ranges of ids. The head of each range (its largest id) is also dealt to the range
    before it, to follow that range's last row; the very first head follows the very last row. So
    each text is moved once. Null ids come last; rows that share an id go by descending fingerprint.
    """
    ranged = with_fingerprint(docs.select("doc_id", clean_text().alias("text")), "text", "fingerprint")
    ranged = ranged.withColumn("__range", id_ranges(docs, "fingerprint"))
    # heads need ids and roots alone
    heads = ranged.select("__range", F.struct("doc_id", F.substring("fingerprint", 1, ROOT_HEX).alias("root")).alias("__id")).groupBy("__range").agg(F.max("__id").alias("__head"))
    order = Window.orderBy(F.desc("__range"))  # over some 2 * MAX_RANGES rows
    last = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("__range", "__head", F.coalesce(F.lag("__range").over(order), F.last("__range").over(last)).alias("__before"))
    rows = ranged.join(F.broadcast(heads), "__range")
    copies = F.when(F.struct("doc_id", F.substring("fingerprint", 1, ROOT_HEX).alias("root")).eqNullSafe(F.col("__head")), F.array(F.struct(F.col("__range").alias("at"), F.lit(0).alias("copy")), F.struct(F.col("__before").alias("at"), F.lit(1).alias("copy")))).otherwise(
        F.array(F.struct(F.col("__range").alias("at"), F.lit(0).alias("copy")))
    )
    dealt = rows.select("doc_id", "text", "fingerprint", F.explode(copies).alias("__to")).select("doc_id", "text", "fingerprint", "__to.at", "__to.copy")
    down = Window.partitionBy("at").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("fingerprint"))
    following = dealt.select("doc_id", "text", "fingerprint", "copy", F.lead("text").over(down).alias("next_text"), F.lead("fingerprint").over(down).alias("next_fingerprint"))
    return following.filter("copy = 0").drop("copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, changed.

    ``changed`` lists the places (section, paragraph) where the document's tree and that of its edited text differ.

    The edited text replaces the last floor(n_chars / 3) code points by as many from the start of the
    next document (all of it where it is shorter). A null text is empty; a single row follows itself.
    """
    rows = with_next(docs.select("doc_id", "text"))
    third = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.length("text") - third), F.col("next_text").substr(F.lit(1), third)))
    rows = with_fingerprint(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fingerprint")
    rows = with_likeness(rows, "fingerprint", "edited_fingerprint", "near_edited")
    rows = with_likeness(rows, "fingerprint", "next_fingerprint", "near_next")
    rows = rows.withColumns({"__a": branches(F.col("fingerprint")), "__b": branches(F.col("edited_fingerprint"))})
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", changed_paragraphs(F.col("__a"), F.col("__b")).alias("changed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``fingerprints``, with the changed places written ``section:paragraph,section:paragraph``."""
    rows = fingerprints(table(spark, sf_dir, "documents"))
    return rows.withColumn("changed", F.array_join(F.transform("changed", lambda c: F.concat_ws(":", c["section"].cast("string"), c["paragraph"].cast("string"))), ","))


def sql() -> str:
    leaf = f"(?:[^ ]+ *| +){{1,{LEAF_WORDS}}}"
    tree_ = lambda t: f"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{leaf}'), lambda x: sha256(x))))"
    node_ = lambda c: f"sha256(coalesce(array_to_string({c}, ','), ''))"
    root = lambda t: node_(f"list_transform({t}, lambda s: {node_(f'list_transform(s, lambda p: {node_('p')})')})")
    body = lambda t: f"array_to_string(list_transform({t}, lambda s: coalesce(array_to_string(list_transform(s, lambda p: coalesce(array_to_string(list_transform(p, lambda h: substr(h, 1, {LEAF_HEX})), ''), '')), ';'), '')), '|')"
    fp = lambda t: f"substr({root(t)}, 1, {ROOT_HEX}) || '|' || {body(t)}"
    leaves = lambda f: f"list_distinct(regexp_extract_all(substr({f}, {ROOT_HEX + 2}), '[0-9a-f]{{{LEAF_HEX}}}'))"
    near = lambda a, b: f"CASE WHEN substr({a}, 1, {ROOT_HEX}) = substr({b}, 1, {ROOT_HEX}) THEN 1.0::DOUBLE ELSE least(len(list_intersect({leaves(a)}, {leaves(b)}))::DOUBLE / greatest(len({leaves(a)}), len({leaves(b)}), 1), 1.0::DOUBLE - 1e-9) END"
    branches_ = lambda f: f"string_split(substr({f}, {ROOT_HEX + 2}), '|')"
    paragraphs = lambda x: f"string_split(coalesce({x}[i + 1], '-'), ';')"
    inside = f"list_transform(list_filter(range(0, greatest(len({paragraphs('a')}), len({paragraphs('b')}))), lambda j: {paragraphs('a')}[j + 1] IS DISTINCT FROM {paragraphs('b')}[j + 1]), lambda j: i || ':' || j)"
    changed = f"array_to_string(flatten(list_transform(list_filter(range(0, greatest(len(a), len(b))), lambda i: a[i + 1] IS DISTINCT FROM b[i + 1]), lambda i: {inside})), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {tree_("coalesce(text, '')")} AS tree FROM documents),
f AS (SELECT doc_id, text, {fp('tree')} AS fingerprint FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, fingerprint DESC) AS pos, count(*) OVER () AS n FROM f),
e AS (SELECT a.doc_id, length(a.text) AS n_chars, a.fingerprint, b.fingerprint AS next_fingerprint,
  substr(a.text, 1, length(a.text) - length(a.text) // 3) || substr(b.text, 1, length(a.text) // 3) AS edited FROM o AS a JOIN o AS b ON b.pos = a.pos % a.n + 1),
t AS (SELECT *, {tree_('edited')} AS tree FROM e),
h AS (SELECT *, {fp('tree')} AS edited_fingerprint FROM t),
g AS (SELECT *, {branches_('fingerprint')} AS a, {branches_('edited_fingerprint')} AS b FROM h)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  {near('fingerprint', 'edited_fingerprint')} AS near_edited, {near('fingerprint', 'next_fingerprint')} AS near_next, coalesce({changed}, '') AS changed FROM g"""
