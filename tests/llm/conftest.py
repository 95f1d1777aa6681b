from __future__ import annotations

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


LONG = " ".join(f"w{i % 977}" for i in range(60_000))
CASES = [
    (1, "one two three four five six"),
    (1, "one two three four five six"),
    (2, None),
    (3, ""),
    (None, "without an id"),
    (None, None),
    (4, LONG),
    (5, "Ünï cödé 😀 a\u0000b ▁mark line x"),
    (6, "   \n\n\t "),
    (7, "one two three four five six"),
    (8, "x" * 50_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and further columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, base int, fingerprint long, shard int, digest string, sanitised string, kept string, label int, `odd name` string"
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 0.5, "s", 1, 2, 3, "d", "z", "k", 0, "o") for i, t in CASES], schema)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
