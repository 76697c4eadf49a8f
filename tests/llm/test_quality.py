"""Classifier: held-out accuracy, label hygiene, edge cases."""

import zlib

import duckdb
from pyspark.sql import functions as F

from labelloom.llm import queries, quality


def test_held_out_accuracy_and_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op1_quality"](spark, sf).collect()
    con = duckdb.connect()
    labels = dict(con.execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    docs = {i for (i,) in con.execute(f"SELECT doc_id FROM '{sf}/documents.parquet'").fetchall()}
    assert {r.doc_id for r in rows} == docs and len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_nulls_ties_contradictions_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, "good text here", 1.0), (1, "good text here", 2.0), (2, None, 0.0), (3, "", 0.0), (None, "bad bad bad", 0.0)],
        "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)  # one kind of label only: the share of label 1
    got = docs.select("doc_id", quality.score(F.col("text"), model).alias("p")).collect()
    assert len(got) == 5 and len({r.p for r in got}) == 1
    none = quality.fit(docs.limit(0), labels)
    assert docs.limit(0).select(quality.score(F.col("text"), none).alias("p")).collect() == []
    assert docs.select(quality.score(F.col("text"), none).alias("p")).first().p == 0.5


def test_the_driver_gets_the_model_only(spark, monkeypatch):
    """The counts of the sample stay in a task."""
    from pyspark.sql import DataFrame

    def refused(self):
        raise AssertionError("counts on the driver")

    monkeypatch.setattr(DataFrame, "toArrow", refused)
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "bad text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(docs, labels, bits=10)
    assert len(model.scores) == 1 << 10 and quality.logits([b"good words"], model.scores, model.bias) > quality.logits([b"bad text"], model.scores, model.bias)


def test_the_sample_stays_compressed_and_trains_alike():
    import numpy as np

    long = " ".join(f"word{i * i}" for i in range(2000)).encode()
    texts = [long, b"", b"bad bad text"] * 6
    rows = quality.counted(texts, 12)
    cells = quality.Packed([quality.packed(*r) for r in rows], np.array([len(r[0]) for r in rows]))
    assert all((a == c).all() and (b == d).all() and c.dtype == a.dtype and d.dtype == b.dtype
               for (a, b), (c, d) in zip(rows, cells, strict=True))
    assert sum(map(len, cells.cells)) < sum(a.nbytes + b.nbytes for a, b in rows) / 2
    how = {"bits": 12, "dim": 4, "epochs": 2, "rate": 0.5, "batch": 4, "seed": 1}
    labels = np.array([1, 0, 0] * 6)
    one, two = quality.train(rows, labels, **how), quality.train(cells, labels, **how)
    assert (one.scores == two.scores).all() and one.bias == two.bias
