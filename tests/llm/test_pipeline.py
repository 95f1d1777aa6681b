"""The stages of the pipeline: columns, order and effect."""

from __future__ import annotations

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import words
from tidegate.llm import decontamination, neardedup, privacy, quality, sentencepieces


def one_of_each_group(texts):
    """The least id of each group of near copies, by comparing all texts."""
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t, lower=True)) else frozenset() for k, t in texts.items()}
    parent = {k: k for k in texts}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if (len(x & y) >= 0.8 * len(x | y)) if x and y else x == y:
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {k for k in ids if top(k) == k}


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), stage(spark, docs, data).schema)
        kept.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            forest = quality.train(before, spark.read.parquet(f"{data}/labels.parquet"))
            good = {r.doc_id for r in quality.score(before, forest, ["doc_id"]).filter(f"score >= {quality.THRESHOLD}").collect()}
            assert {r.doc_id for r in docs.collect()} == good
        if i == 1:
            assert {r.doc_id for r in docs.collect()} == one_of_each_group({r.doc_id: r.text for r in before.collect()})
        if i == 2:
            assert decontamination.contaminated(docs, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0
        if i == 3:
            assert privacy.with_base(docs, "text").filter("size(base) > 0").count() == 0
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if i == 4:
            sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.ids == sp.encode(texts[r.doc_id]) for r in docs.collect())
    assert kept[0] > kept[1] > kept[2] > kept[3] == kept[4] == kept[5]


def test_run(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.count() > 0 and "ids" in got.columns


def test_awkward_tables_pass_all_stages(spark, data, odd, none):
    for table in (odd, none):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
        docs.collect()


def test_columns_keep_their_values_whatever_their_names(spark, data):
    names = ["__digest", "digest", "id", "row", "__text", "__terms", "__email", "__matches", "__score", "root", "key", "comp", "part", "base", "spans", "sanitised"]
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id % 4 = 0").select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, data)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)


def test_a_family_that_straddles_the_threshold(spark):
    """1,000 copies of one text with up to four edits: with three or more they are no near copies of most others."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = {}
    for i in range(1000):
        w = list(base)
        for j in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            w[j] = f"e{rng.integers(0, 10**6)}"
        texts[i] = " ".join(w)
    want = one_of_each_group(texts)
    for bucket, members in ((256, 1024), (64, 100)):
        got = {r.doc_id for r in neardedup.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bucket, members=members).collect()}
        assert got == want and 100 < len(want) < 900
