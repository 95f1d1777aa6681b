r"""License scan: fuzzy search for short notices.

A text's words are runs of ``WORD`` after A-Z are lower-cased; joined by single spaces they are what is searched. A notice of
n characters may have n // ``PER_ERROR`` edits (characters put in, left out or changed). Cut into one piece more than that, any text within so many edits
holds a piece unchanged: the pieces of all notices are the seeds of one Aho-Corasick automaton, and each seed found gives the stretch
where its notice can lie. Stretches of a notice that overlap are joined; in each the regex library's bounded-error matching
looks for the notice and reports the edits and the place. A phrase without edits is its own seed; its places are those where its words stand
consecutively, however they overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidegate.llm.common import TEXTS, table, trimming

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PER_ERROR = 16

# Phrases sought word for word, and opening words of public notices, with their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person"),
    ("mit", "spdx license identifier mit"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "spdx license identifier apache 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license"),
    ("gpl", "spdx license identifier gpl 3 0"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("bsd", "spdx license identifier bsd 3 clause"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("epl", "under the terms of the eclipse public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "waived all copyright and related or neighboring rights"),
    ("unlicense", "free and unencumbered software released into the public domain"),
)

OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"


@dataclass(frozen=True)
class Notice:
    label: str
    said: str
    errors: int
    base: bool = False

    def pieces(self) -> list[tuple[int, str]]:
        """Offsets and texts of one piece more than there may be edits."""
        n = self.errors + 1
        ends = [len(self.said) * i // n for i in range(n + 1)]
        return [(s, self.said[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]

    def pattern(self) -> regex.Pattern:
        return regex.compile(f"(?e)(?:{regex.escape(self.said, special_only=True)}){{e<={self.errors}}}")


class Scanner:
    """Finds notices in texts; (label, words) each. ``exact`` ones are phrases of whole words."""

    def __init__(self, exact: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, per_error: int = PER_ERROR):
        self.notices = [Notice(label, f" {said} ", 0, True) for label, said in exact] + [Notice(label, said, len(said) // per_error) for label, said in notices]
        self.patterns = [x.pattern() for x in self.notices]
        seeds = defaultdict(list)
        for i, x in enumerate(self.notices):
            for offset, piece in x.pieces():
                seeds[piece].append((i, offset, len(piece)))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, places)
        self.seeds.make_automaton()

    def matches(self, said: str) -> list[tuple[int, int, int, int]]:
        """start, end, place of the notice, edits in ``said``, which is words joined by and between single spaces."""
        found, stretches = [], defaultdict(list)
        for last, places in self.seeds.iter(said):
            for i, offset, size in places:
                x, start = self.notices[i], last + 1 - size - offset
                if x.base:
                    found.append((start + 1, start + len(x.said) - 1, i, 0))
                    continue
                low, high, known = max(0, start - x.errors), start + len(x.said) + x.errors, stretches[i]
                if known and low <= known[-1][1]:
                    known[-1][1] = max(known[-1][1], high)
                    known[-1][0] = min(known[-1][0], low)
                else:
                    known.append([low, high])
        for i, known in stretches.items():
            for low, high in _joined(known):
                found += [(m.start(), m.end(), i, sum(m.fuzzy_counts)) for m in self.patterns[i].finditer(said, low, high)]
        return sorted(found)

    def row(self, doc_id: int | None, text: str) -> tuple:
        low = text.encode("utf-8", "replace").lower().decode()
        words = WORD.findall(low)
        found = self.matches(f" {' '.join(words)} ") if words else []
        if not found:
            return (doc_id, len(words), 0, None, None, "", "", 0.0, "")
        spans = [m.span() for m in WORD.finditer(low)]
        starts, at = [], 1
        for w in words:
            starts.append(at)
            at += len(w) + 1
        word = lambda place: max(0, bisect_right(starts, place) - 1)
        base = [word(s) for s, _, i, _ in found if self.notices[i].base]
        labels = lambda keep: ",".join(sorted({self.notices[i].label for _, _, i, _ in found if keep(self.notices[i])}))
        told = ",".join(f"{self.notices[i].label}:{spans[word(s)][0]}:{spans[word(e - 1)][1]}:{errors}" for s, e, i, errors in found)
        score = max(1 - errors / len(self.notices[i].said) for _, _, i, errors in found)
        return (doc_id, len(words), len(base), min(base, default=None), max(base, default=None), labels(lambda x: x.base), labels(lambda x: True), score, told)


def _joined(stretches: list[list[int]]) -> list[list[int]]:
    """The union of stretches, in order."""
    out: list[list[int]] = []
    for low, high in sorted(stretches):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def scan(docs: DataFrame, exact: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """A row per document: doc_id, n_words, n_base (places of the exact phrases), first_word and last_word (least and greatest start of
    these, words from 0; null without any), base_labels, labels (of phrases and notices), score (1 less the edits' share of the best
    match's length; 0 without any), notices (label:start:end:edits of each match, in code points of the text, whole words).

    A notice is found exactly where some stretch of the words' text lies within its edits; matches of one notice do not overlap, the first one
    stands. A null text is empty; equal rows give equal rows; an empty table gives none. Other columns are not read. A text is gone through
    once, notices are sought only around their seeds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(exact, notices)
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        names, kinds = zip(*[x.split() for x in OUT.split(", ")], strict=True)
        for batch in batches:
            rows = [scanner.row(i.as_py(), t.as_py() or "") for i, t in zip(batch.column(0), batch.column(1), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(trimming(run, TEXTS), OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
