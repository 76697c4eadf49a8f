"""The pipeline, stage by stage, against brute force."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from labelloom.llm import mixing, quality
from tests.llm.test_contamination import windows
from tests.llm.test_joins import brute


def test_stages_on_the_whole_table(spark, sf_dir, monkeypatch):
    seen = []
    stage = corpus_pipeline.stage

    def kept(df, name):
        out = stage(df, name)
        seen.append(out)
        return out

    monkeypatch.setattr(corpus_pipeline, "stage", kept)
    final = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(seen) == len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == docs.columns for s in seen[:-1])

    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id: r.text for r in docs.where(quality.score(F.col("text"), model) >= 0.7).collect()}
    assert {r.doc_id for r in seen[0].collect()} == set(good)

    groups = {}
    for i, _, c in brute(list(good.items()), 5, 80):
        groups.setdefault(c, []).append(i)
    firsts = {min(g) for g in groups.values()}
    assert {r.doc_id for r in seen[1].collect()} == firsts

    items = [set(windows(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    def leaks(text):
        own = set(windows(text))
        return any(2 * len(i & own) >= len(i) for i in items if i)

    clean = {i for i in firsts if not leaks(good[i])}
    assert {r.doc_id for r in seen[2].collect()} == clean

    drawn = Counter(r.doc_id for r in seen[3].collect())
    want = {r.doc_id: len(r.draws) for r in mixing.mix(seen[2]).collect() if r.draws}
    assert drawn == want

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted((tuple(r) for r in final.collect()), key=lambda r: r[1])
    start = 0
    for (i, s, n, crc), j in zip(rows, sorted(drawn.elements()), strict=True):
        ids = [*library.encode(good[i], add_special_tokens=False).ids, 1]
        assert (i, s, n, crc) == (j, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += n


def test_stages_take_rows_with_nulls_and_repeats(spark, sf_dir):
    docs = spark.createDataFrame(
        [(1, "some text here", "en", "a", 1), (1, "some text here", "en", "a", 1), (None, "x", None, None, None), (2, None, "en", "b", 0),
         (3, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = [step(spark, docs, sf_dir).count() for _, step in corpus_pipeline.STAGES]
    assert 0 <= rows[0] <= 5 and rows[1:3] == [4, 5] and rows[4] == 5  # the row that stands twice is one document
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs.limit(0), sf_dir)
        assert out.columns == docs.columns and out.count() == 0
