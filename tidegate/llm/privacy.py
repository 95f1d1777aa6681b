r"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give them away.

Patterns (leftmost, non-overlapping for each kind; a match that fails its test goes): e-mail, IPv4, card
(14 to 19 digits passing Luhn), phone (``+``, 10 to 15 digits). The expressions below find exactly those matches with
possessive groups and look-behinds, so that no text makes them backtrack without end or recurse deeply.

Terms: runs of four or more letters in a document with a protected value, outside of its values. A value stands for entities: itself
(cards and phones by their digits, so that spellings are one) and whose it is, namely an address's domain, an IPv4 network of 256, a
card's issuer (6 digits), a phone's exchange (all but 4 digits). For term t and
entity e, with document counts over the whole corpus (copies included), the disclosure is the pointwise mutual
information log2(n(t, e) N / (n(t) n(e))), and the share n(t, e) / n(t) is how surely t means e. A term
seen with e in ``SUPPORT`` different texts or more, with a share of ``SHARE`` and ``BITS`` bits, is generalised; from a
share of ``CERTAIN`` on it is removed. It is sanitised in all documents that hold e: there the
masked value could be told from it.

Entities and terms that cannot pass with any partner are left out before they are paired, which loses nothing: n(t, e) is
at most n(t), n(e) and the count of t in documents with values, so that ``BITS`` bounds n(t) and n(e), and ``SHARE`` n(t). The corpus's
words are counted for the terms that are left alone.

All of it is built-in column functions; the patterns are sought once, and only documents with protected values move. Places are running
sums in blocks and texts are rebuilt from pieces of 1,024 characters, so that work is in proportion to a text's length and spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import clean_text, cut, stored, table

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{4,}+"
SUPPORT, SHARE, CERTAIN, BITS = 3, 0.5, 0.9, 6.0
#: The largest table of possible terms that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 16_000_000
SPAN = "array<struct<start:int,kind:int,end:int,said:string>>"


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _luhn(said: Column) -> Column:
    digits = F.reverse(_digits(said))
    value = lambda i: digits.substr(i + 1, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + doubled(i)) % 10 == 0


TESTS = {
    "email": lambda said: F.lit(True),
    "ip": lambda said: F.forall(F.split(said, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255)),
    "card": _luhn,
    "phone": lambda said: F.length(_digits(said)).between(10, 15),
}


#: Elements of a block of a running sum; characters of a piece of text.
BLOCK, PIECE = 256, 1024


def with_running(df: DataFrame, column: str, out: str, op) -> DataFrame:
    """``df`` with ``out``: for each element of an integer array, ``op`` over it and all before it. Blocks, then the blocks' totals."""
    step = lambda acc, x: F.concat(acc, F.array(F.coalesce(op(F.element_at(acc, -1), x), x)))
    scanned = lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(F.aggregate(F.slice(xs, F.lit(2), F.size(xs)), F.slice(xs, 1, 1), step))
    places = F.when(F.size(column) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((F.size(column) - 1) / BLOCK).cast("int")))
    df = df.withColumn("__blocks", F.transform(places, lambda i: scanned(F.slice(column, i * BLOCK + 1, BLOCK))))
    df = df.withColumn("__totals", scanned(F.transform("__blocks", lambda b: F.element_at(b, -1))))
    # what each block starts from comes as an argument: a column that only a lambda names is computed anew for each element
    before = F.slice(F.concat(F.array(F.lit(None).cast("int")), "__totals"), F.lit(1), F.size("__blocks"))
    shifted = F.zip_with("__blocks", before, lambda b, o: F.transform(b, lambda x: F.coalesce(op(o, x), x)))
    return df.withColumn(out, F.flatten(shifted)).drop("__blocks", "__totals")


def with_located(df: DataFrame, text: str, pattern: str, kind: int, out: str, when=None) -> DataFrame:
    """``df`` with ``out``: the spans of all matches of a pattern; the pieces between them give their places."""
    none = F.array().cast("array<struct<gap:int,said:string>>")
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn("__said", found if when is None else F.when(when, found).otherwise(F.array().cast("array<string>")))
    pieces = F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size("__said"))
    df = df.withColumn("__met", F.when(F.size("__said") == 0, none).otherwise(F.zip_with(pieces, "__said", lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("said")))))
    df = df.withColumn("__step", F.transform("__met", lambda x: x["gap"] + F.length(x["said"])))
    df = with_running(df, "__step", "__end", lambda a, b: a + b)
    spans = F.zip_with("__met", "__end", lambda x, e: F.struct((e - F.length(x["said"])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), x["said"].alias("said")))
    return df.withColumn(out, spans.cast(SPAN)).drop("__said", "__met", "__step", "__end")


def with_base(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``base``: the patterns' spans by (start, kind)."""
    for i, (k, p) in enumerate(PATTERNS.items()):
        df = with_located(df, text, p, i, f"__{k}")
    passing = lambda spans, test: F.filter(spans, lambda s: test(s["said"]))
    return df.withColumn("base", F.array_sort(F.concat(*[passing(f"__{k}", TESTS[k]) for k in PATTERNS]))).drop(*[f"__{k}" for k in PATTERNS])


def with_rebuilt(df: DataFrame, text: str, spans: str, out: str, put) -> DataFrame:
    """``df`` with ``out``: the text with ``put(span)`` for each span; overlaps go to the first."""
    df = df.withColumn("__ends", F.transform(spans, lambda s: s["end"]))
    df = with_running(df, "__ends", "__upto", F.greatest)
    df = df.withColumn("__pieces", F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))

    def between(start: Column, end: Column) -> Column:
        at = F.when(end > start, F.sequence(F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(at, lambda c: F.get("__pieces", c).substr(F.greatest(start - c * PIECE, F.lit(0)) + 1, F.least(end, (c + 1) * PIECE) - F.greatest(start, c * PIECE))), "")

    before = lambda i: F.coalesce(F.get("__upto", i - 1), F.lit(0))
    laid = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(between(before(i), s["start"]), put(s))).otherwise(F.lit("")))
    rebuilt = F.concat(F.array_join(laid, ""), between(F.coalesce(F.element_at("__upto", -1), F.lit(0)), F.length(text)))
    return df.withColumn(out, F.when(F.size(spans) == 0, F.col(text)).otherwise(rebuilt)).drop("__ends", "__upto", "__pieces")


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def entities_of(base: Column) -> Column:
    """Whom the spans of a text stand for: each value, and whose it is."""

    def forms(s: Column) -> Column:
        said, digits = F.lower(s["said"]), _digits(s["said"])
        both = [
            (said, F.regexp_extract(said, "@.*$", 0)),
            (said, F.concat(F.regexp_extract(said, r"^([0-9]+\.[0-9]+\.[0-9]+\.)", 1), F.lit("*"))),
            (digits, F.concat(F.lit("card "), digits.substr(1, 6))),
            (F.concat(F.lit("+"), digits), F.concat(F.lit("+"), digits.substr(F.lit(1), F.length(digits) - 4), F.lit("*"))),
        ]
        return F.element_at(F.array(*[F.array(*x) for x in both]), s["kind"] + 1)

    return F.array_distinct(F.flatten(F.transform(base, forms)))


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """digest, value (an entity), term, share, bits, removed: a row for each text of ``found`` (digest, text, base; a row for each
    document) that holds the entity and a term of it that exceeds the thresholds; counts are documents of all ``docs``."""
    # equal texts are one row with their number, so that copies are counted but not paired
    texts = cut(found.groupBy("digest").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count("*").alias("copies")))
    # one row, so the products are no larger than their left sides
    n = F.broadcast(cut(docs.agg(F.count("*").alias("n"))))
    rare = lambda c: F.col(c) * (2**BITS * (1 - 1e-9)) <= F.col("n")
    often = lambda df, c, count: df.groupBy(c).agg(F.count("*").alias("texts"), F.sum("copies").alias(count)).filter(F.col("texts") >= SUPPORT).drop("texts")
    values = texts.select("digest", "copies", F.explode(entities_of(F.col("base"))).alias("value"))
    values = cut(values.join(often(values, "value", "n_value").crossJoin(n).filter(rare("n_value")), "value"))
    # a text without such a value pairs nothing, but its terms count
    open_texts = with_rebuilt(texts, "text", "base", "outside", lambda s: F.lit("\n"))
    terms = cut(open_texts.select("digest", "copies", F.explode(terms_of(F.col("outside"))).alias("term")))
    # a term is in as many documents at least as it was found in
    frequent = stored(often(terms, "term", "n_found").crossJoin(n).filter(rare("n_found")).drop("n"))
    words = docs.select(F.explode(terms_of(clean_text())).alias("term"))
    size = frequent.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    if size.rows <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES:  # only words that may be terms are counted over the corpus
        words = words.join(F.broadcast(frequent.select("term")), "term", "left_semi")
    words = words.groupBy("term").agg(F.count("*").alias("n_term"))
    told = frequent.join(words, "term").crossJoin(n).filter(rare("n_term") & (F.col("n_found") >= SHARE * F.col("n_term")))
    terms = terms.join(values.select("digest").distinct(), "digest", "left_semi").join(told.select("term", "n_term"), "term")
    pairs = cut(values.join(terms.drop("copies"), "digest"))
    counts = pairs.groupBy("value", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_both"), F.first("n_value").alias("n_value"), F.first("n_term").alias("n_term"), F.first("n").alias("n"))
    share = F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0))
    bits = F.log2(F.col("n_both") * F.col("n") / (F.col("n_term") * F.col("n_value")))
    known = counts.filter(F.col("texts") >= SUPPORT).withColumns({"share": share, "bits": bits}).filter((F.col("share") >= SHARE) & (F.col("bits") >= BITS))
    return pairs.select("digest", "value", "term").join(known.select("value", "term", "share", "bits", (F.col("share") >= CERTAIN).alias("removed")), ["value", "term"])


def _rows(docs: DataFrame) -> DataFrame:
    """row (the document as one value, so that its columns may have any names), base, spans, sanitised."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), clean_text().alias("text"))
    # the patterns are sought once; what they found serves four times below
    rows = stored(with_base(rows, "text").select("row", "base")).withColumn("text", F.coalesce("row.text", F.lit("")))
    without = rows.filter(F.size("base") == 0).select("row", "base", F.col("base").alias("spans"), F.col("text").alias("sanitised"))
    having = rows.filter(F.size("base") > 0).withColumn("digest", F.md5("text"))
    own = disclosures(docs, having.select("digest", "text", "base")).groupBy("digest").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("removed"))
    joined = having.join(own, "digest", "left")
    empty = F.array().cast("array<string>")
    joined = joined.withColumns({"terms": F.coalesce("terms", empty), "removed": F.coalesce("removed", empty)})
    joined = with_located(joined, "text", TERM, len(KINDS) - 1, "words", F.size("terms") > 0)
    joined = joined.withColumn("spans", F.array_sort(F.concat("base", F.filter("words", lambda s: F.array_contains(F.col("terms"), F.lower(s["said"]))))))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    gone = lambda s: (s["kind"] == len(KINDS) - 1) & F.array_contains(F.col("removed"), F.lower(s["said"]))
    done = with_rebuilt(joined, "text", "spans", "sanitised", lambda s: F.when(gone(s), F.lit("")).otherwise(F.element_at(names, s["kind"] + 1)))
    return without.unionByName(done.select("row", "base", "spans", "sanitised"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base (the patterns' spans), spans (with the revealing terms) and sanitised (the text without them: each
    span's kind in angle brackets, removed terms leave nothing, overlaps go to the first).

    A null text is empty and stays so; equal rows get equal results; an empty table gives no rows.
    Columns of docs keep their names and values, but for columns named base, spans or sanitised, which these replace.
    """
    return _rows(docs.drop("base", "spans", "sanitised")).select("row.*", "base", "spans", "sanitised")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: doc_id, counts by kind, base_sha256, spans, n_term."""
    rows = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda spans, i: F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")
    return rows.select("doc_id", *[count("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:-1])], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count("spans", len(KINDS) - 1).alias("n_term"))


def sanitise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, with its text sanitised and n_chars of the new text."""
    rows = _rows(docs)
    new = {"text": F.col("sanitised"), "n_chars": F.length("sanitised")}
    return rows.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
