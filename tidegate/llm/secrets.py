r"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty for what they miss.

Patterns (leftmost, non-overlapping for each kind; a match that fails its length goes):
``assign``, ``access`` and ``hex`` as in ``PATTERNS``.

Novelty: a candidate is a run of 16 or more of ``[A-Za-z0-9+/_=-]`` with a digit and a letter that lies in no
pattern's span and starts within ``REACH`` characters after a sensitive word (or is what follows the last such word
in the run, if 16 characters do). zstandard, primed with a dictionary of identifiers, compresses the text around the candidate with
and without it; the difference is the candidate's marginal cost. Repeated or ordinary identifiers cost little; a string
of at least the threshold's bits a character is reported as ``novel``. The patterns' own spans are measured alike, which tells real secrets from
placeholders (``n_incompressible``, ``bits``); they stay whatever they cost.

The dictionary holds the identifiers of most documents of the whole corpus (letters only, so that no secret enters it), the threshold lies
between the costs of such identifiers and of random strings, measured once for a scan. A text is gone through once: words, candidates and
spans are merged by place, so that work is in proportion to its length.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import TEXTS, batched, table, trimming

KINDS = ("assign", "access", "hex", "novel")
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|private.?key|access.?key|credential|bearer|authorization|signature|client.?id|pwd|salt", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
LEAST, REACH, AROUND = 16, 48, 256
#: Identifiers as code has them, of letters alone; the most that a dictionary holds.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])(?:[A-Za-z]{2,24}_(?:[A-Za-z]{2,24}_?){1,4}|[a-z]{2,24}(?:[A-Z][a-z]{1,24}){1,4})(?![A-Za-z0-9_])")
DICTIONARY = 4096
#: Words of the dictionary whatever the corpus holds: placeholders and alphabets.
ALWAYS = ("your_api_key_here", "changeme", "xxxxxxxxxxxxxxxx", "0000000000000000", "example", "placeholder", "password", "secret", "token", string.digits, string.ascii_lowercase, string.ascii_uppercase)

OUT = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, n_incompressible long, base_sha256 string, spans string, bits string"
#: start, place of the kind, end, start of the secret itself
Span = tuple[int, int, int, int]


class Novelty:
    """Marginal compressed size of a string against the text around it and a dictionary of identifiers, the most common first."""

    def __init__(self, identifiers: list[str], level: int = 12):
        # zstandard reaches the end of a dictionary most cheaply
        words = zstandard.ZstdCompressionDict("\n".join([*reversed(identifiers), *ALWAYS]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        self.press = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

    def bits(self, before: str, candidate: str, after: str) -> float:
        """Bits a character that ``candidate`` adds between ``before`` and ``after``."""
        with_it = len(self.press.compress((before + after + candidate).encode("utf-8", "replace")))
        without = len(self.press.compress((before + after).encode("utf-8", "replace")))
        return 8 * (with_it - without) / len(candidate)

    def at(self, text: str, start: int, end: int) -> float:
        return self.bits(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND])

    def threshold(self, identifiers: list[str], draws: int = 200) -> float:
        """Halfway between what ordinary names (95th percentile) and random strings (5th percentile) of 16 to 40 characters cost."""
        rng = random.Random(7)
        known = [x for x in (*identifiers, *ALWAYS) if len(x) >= 6]
        ordinary, chance = [], []
        for _ in range(draws):
            said = f"config.{rng.choice(known)} credentials = "
            ordinary.append(self.bits(said, f"{rng.choice(known)}_{rng.choice(known)}{rng.randrange(10)}", "\n"))
            chance.append(self.bits(said, "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randrange(16, 41))), "\n"))
        return (sorted(ordinary)[draws * 95 // 100] + sorted(chance)[draws * 5 // 100]) / 2


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, sorted."""
    found = [(m.start(), k, m.end(), m.start(group)) for k, (pattern, group, least) in enumerate(PATTERNS.values()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """start, end of the candidates outside of the spans ``taken``, in order."""
    words = [m.end() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, ends = [], []  # the spans' union
    for s, _, e, _ in taken:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        i = bisect_right(words, e - LEAST)  # words[i - 1] is the last word with LEAST characters of the run behind it
        if not i or words[i - 1] + REACH < s:
            continue
        s = max(s, words[i - 1])
        i = bisect_left(ends, s + 1)
        if (i == len(ends) or starts[i] >= e) and DIGIT.search(text, s, e) and LETTER.search(text, s, e):
            out.append((s, e))
    return out


def novel_spans(text: str, taken: list[Span], novelty: Novelty, threshold: float) -> list[tuple[Span, float]]:
    """The candidates that cost at least ``threshold`` bits a character, with their costs."""
    found = [((s, len(KINDS) - 1, e, s), novelty.at(text, s, e)) for s, e in candidates(text, taken)]
    return [x for x in found if x[1] >= threshold]


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter(x for t in batch.column(0).to_pylist() if t for x in set(IDENTIFIER.findall(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["said", "n"])


def identifiers(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The ``most`` identifiers that stand in most documents (two at least), counted over all of them: a bounded dictionary."""
    counts = batched(docs).select("text").mapInArrow(trimming(_identifiers, TEXTS), "said string, n long").groupBy("said").agg(F.sum("n").alias("n")).filter("n > 1")
    return [r.said for r in counts.orderBy(F.desc("n"), "said").limit(most).collect()]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, counts by kind, n_incompressible (all spans at or over the threshold), base_sha256 of the
    patterns' spans, spans (all), bits (of each span, a character).

    Spans are kind:start:end in code points, end exclusive, by start, then kind. A null text is
    empty; equal rows give equal rows; an empty table gives none. Other columns are not read.
    """
    own = identifiers(docs)
    threshold = Novelty(own).threshold(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(own)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                costs = sorted([(x, novelty.at(text, x[3], x[2])) for x in base] + novel_spans(text, base, novelty, threshold))
                n = Counter(x[1] for x, _ in costs)
                spans = [x for x, _ in costs]
                rows.append((doc_id, *[n[k] for k in range(4)], sum(c >= threshold for _, c in costs), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), ",".join(f"{c:.2f}" for _, c in costs)))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i > 5 else pa.int64()) for i, c in enumerate(columns)], [x.split()[0] for x in OUT.split(", ")])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(trimming(run, TEXTS), OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
