"""Features are made once and shared by teacher, student and checks."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from labelloom.operators import training as T


def test_distillation_reads_and_counts_the_texts_once(spark, tmp_path, monkeypatch):
    from catalogue import model_queries as Q

    r = random.Random(3)
    docs = [(i, " ".join(r.choices([["red", "rose"], ["blue", "sea"], ["green", "leaf"]][i % 3] + ["and", f"w{chr(97 + i % 20)}"], k=12)))
            for i in range(90)] + [(90, "zz zz"), (91, ""), (92, None), (93, "unlabelled")]
    labels = [(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(93)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    made, normalised = [], []
    features, text = T.text_features, Q.model_text
    monkeypatch.setattr(T, "text_features", lambda *a: (made.append(1), features(*a))[1])
    monkeypatch.setattr(Q, "model_text", lambda: (normalised.append(1), text())[1])
    got = {x.doc_id: x for x in Q.distill_scores(spark, str(tmp_path)).collect()}
    assert len(made) == len(normalised) == 1

    digit = {i: hashlib.md5(f"{i}:42".encode()).hexdigest()[0] for i in range(93)}
    split = {i: "test" if d in "012" else "val" if d in "345" else "train" for i, d in digit.items()}
    known = {w for i, t in docs if split.get(i) == "train" for w in (t or "").split()}
    assert set(got) == set(range(93))
    for i, t in docs[:93]:
        words = [w for w in (t or "").split() if w in known]
        x = got[i]
        assert (x.split, x.n_distinct, x.n_known) == (split[i], len(set(words)), len(words))
        assert x.probs_are_softmax and x.pred_is_argmax and x.right_more_often_than_not


def test_features_of_shared_and_null_ids(spark):
    """Texts of an id count together, in each of its rows; a row without an id has no words."""
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, idx long")
    rows = [(1, "a b b c zz"), (1, "b"), (2, "zz"), (None, "a"), (3, None), (4, "a\ta  b")]
    got = T.text_features(spark.createDataFrame(rows, "uid long, t string"), "uid", F.col("t"), vocab, 2)
    found = Counter((r.uid, tuple(r.features.toArray().tolist()), r.n_distinct, r.n_known) for r in got.collect())
    assert found == {
        (1, (1.0, 3.0), 2, 4): 2, (2, (0.0, 0.0), 0, 0): 1, (None, (0.0, 0.0), 0, 0): 1, (3, (0.0, 0.0), 0, 0): 1, (4, (2.0, 1.0), 2, 3): 1}


def test_words_are_counted_where_their_texts_were_dealt(spark, monkeypatch):
    """No word is shuffled, only texts and ids."""
    plans = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, *a, **k: (
        plans.append(w._df._jdf.queryExecution().executedPlan().toString()), write(w, *a, **k))[1])
    df = spark.createDataFrame([(i, "a b b") for i in range(50)], "uid long, t string").repartition(4)
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "word string, idx long")
    assert T.text_features(df, "uid", F.col("t"), vocab, 2).count() == 50
    dealt = [line for line in plans[0].splitlines() if "Exchange " in line and "BroadcastExchange" not in line]
    assert dealt and not any("token" in line or "at#" in line for line in dealt)
