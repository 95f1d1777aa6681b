"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are taken in Arrow batches. Training reads at most ``SAMPLE`` labelled
rows (those of the least hash of doc_id, so the same rows every time); their bounded matrix is
binned at quantiles and boosted on gradient histograms. The trees are complete binary trees flattened into two
arrays, and scoring walks all trees of a batch at once by array indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import TEXTS, WORD, batched, table, trimming

#: Labelled rows that training reads at most; a stated bound, the same at every input size.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, L2 = 100, 4, 64, 0.15, 2.0, 1.0
THRESHOLD = 0.3
STATISTICS = (
    "log_bytes", "log_words", "bytes_a_word", "word_sd", "upper", "digit", "space", "newline", "punct", "symbol", "high",
    "entropy", "unique_words", "unique_lines", "top_word", "words_a_line", "ends_sentence", "capital_words", "upper_words",
    "pressed", "adjacent_same", "pipe", "bang", "longest_word",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([_mask(bytes(range(65, 91))), _mask(b"0123456789"), _mask(b" \t"), _mask(b"\n\r"), _mask(b".,;:?'\"()-"), _mask(b"*#$%&@^~_=<>{}[]\\/|!+`"), _mask(bytes(range(128, 256))), _mask(b"|"), _mask(b"!")])


def statistics(text: str, press: zstandard.ZstdCompressor) -> list[float]:
    """The numbers of ``STATISTICS`` for one whole text."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, space, newline, punct, symbol, high, pipe, bang = (_CLASSES @ hist) / n
    p = hist[hist > 0] / n
    words = WORD.findall(text)
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / m, sizes.std(), upper, digit, space, newline, punct, symbol, high,
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0, len(counts) / m, len(set(lines)) / max(1, len(lines)), max(counts.values(), default=0) / m,
        m / max(1, len(lines)), sum(x.rstrip()[-1:] in ".!?" for x in lines) / max(1, len(lines)), sum(w[0].isupper() for w in words) / m,
        sum(w.isupper() for w in words) / m, len(press.compress(raw)) / n, sum(map(str.__eq__, words, words[1:])) / m, pipe, bang, sizes.max(),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    press = zstandard.ZstdCompressor(level=1)
    return np.array([statistics(t or "", press) for t in texts], dtype=float).reshape(len(texts), len(STATISTICS))


#: Rows that walk the trees together.
ROWS = 1024


@dataclass
class Forest:
    """Complete trees: node i has children 2i+1 and 2i+2; rows with value > cut go right."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        if len(self.leaf):
            trees = np.arange(len(self.leaf))[None, :]
            for start in range(0, len(x), ROWS):  # bounds the places held at once
                part = x[start : start + ROWS]
                rows, at = np.arange(len(part))[:, None], np.zeros((len(part), len(self.leaf)), dtype=int)
                for _ in range(int(np.log2(self.leaf.shape[1]))):
                    at = 2 * at + 1 + (part[rows, self.feature[trees, at]] > self.cut[trees, at])
                raw[start : start + ROWS] += self.leaf[trees, at - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost logistic loss; without rows, or with one class, the score is the constant share of label 1."""
    none = np.zeros((0, 2**DEPTH - 1))
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(base, none.astype(int), none, np.zeros((0, 2**DEPTH)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # value > cut[b] iff bin > b
    offset = bins + np.arange(x.shape[1]) * BINS
    width = x.shape[1] * BINS
    raw = np.full(len(y), base)
    features, places, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=int)  # within its level
        feature, cut = np.zeros(2**DEPTH - 1, dtype=int), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            key = (node[:, None] * width + offset).ravel()
            both = [np.bincount(key, np.repeat(v, x.shape[1]), 2**level * width).reshape(2**level, x.shape[1], BINS).cumsum(axis=2) for v in (g, h)]
            gl, hl = both
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = -1
            best = gain.reshape(2**level, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            split = gain.reshape(2**level, -1)[np.arange(2**level), best] > 1e-9
            i = 2**level - 1 + np.arange(2**level)
            feature[i] = f
            cut[i] = [cuts[ff][bb] if ok and bb < len(cuts[ff]) else np.inf for ff, bb, ok in zip(f, b, split, strict=True)]
            node = 2 * node + (x[np.arange(len(y)), feature[i][node]] > cut[i][node])
        gs, hs = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
        leaf = -RATE * gs / (hs + L2)
        raw += leaf[node]
        features.append(feature), places.append(cut), leaves.append(leaf)
    return Forest(base, np.array(features), np.array(places), np.array(leaves))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0; a null id counts as held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled rows that are not held out; null texts are empty, null labels are skipped.

    Of documents that repeat an id the least text is learnt from.
    """
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # at most `sample` ids, so their broadcast is bounded
    rows = batched(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).mapInArrow(trimming(measured, TEXTS), "doc_id long, quality int, x array<double>")
    got = sorted((r.doc_id, r.quality, r.x) for r in rows.collect())
    return fit(np.array([r[2] for r in got]).reshape(len(got), len(STATISTICS)), np.array([r[1] for r in got], dtype=float))


def score(docs: DataFrame, forest: Forest, keep: list[str], out: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``out``, 0 to 1, higher for better text; it takes the place of a kept column of its name."""
    keep = [c for c in keep if c.lower() != out.lower()]
    rows = batched(docs).select(*keep, *(["text"] if "text" not in keep else []))
    at, schema = rows.columns.index("text"), ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = forest.score(matrix(b.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s, pa.float64())], [*keep, out])

    return rows.mapInArrow(trimming(run, TEXTS), f"{schema}, `{out}` double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted (score >= 0.3)."""
    docs = table(spark, sf_dir, "documents")
    rows = score(docs.withColumn("held_out", held_out()), train(docs, table(spark, sf_dir, "labels")), ["doc_id", "held_out"])
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose score reaches the threshold, with the columns of documents."""
    forest, at = train(docs, table(spark, sf_dir, "labels")), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(forest.score(matrix(b.column(at).to_pylist())) >= THRESHOLD, pa.bool_()))

    return batched(docs).mapInArrow(trimming(run, TEXTS), docs.schema)
