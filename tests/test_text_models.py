"""Vocabulary, MLlib stage, attributions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import attribution as X
from labelloom.operators import training as T
from labelloom.operators import vocab as V


def test_vocabulary_and_encoding_match_brute_force(spark):
    rng = random.Random(3)
    words = ["Aa", "bb", "c'c", "dd.ee", "f\tg", "hh", "zz zz"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")

    def split(t):
        t = "".join(" " if c in V.FILTERS else c for c in (t or "").lower())
        return [w for w in t.split(" ") if w]

    assert len(V.FILTERS) == 33
    counts = Counter()
    for t in texts[:40]:
        counts.update(split(t))
    order = sorted(counts.items(), key=lambda kv: -kv[1])          # stable: first appearance
    vocab = V.fit_vocabulary(df.filter("i < 40"), "t", "i")
    assert [(r.word, r.n) for r in vocab.orderBy("idx").collect()] == order
    assert V.vocabulary_size(vocab, 5).first()[0] == 5
    assert V.vocabulary_size(vocab, 500).first()[0] == len(order) + 1
    index = {w: k + 1 for k, (w, _) in enumerate(order)}
    got = {r.i: list(r.ids) for r in V.encode(df, "i", "t", vocab, 6, 4).collect()}
    for i, t in enumerate(texts):
        ids = [index[w] for w in split(t) if index.get(w, 99) < 6][-4:]
        assert got[i] == [0] * (4 - len(ids)) + ids


def corpus(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        y = i % 3
        base = [["red", "rose"], ["blue", "sea"], ["green", "leaf"]][y]
        rows.append((i, " ".join(rng.choices([*base, *base, "and", "the"], k=8)), y))
    return spark.createDataFrame(rows, "uid int, t string, y int")


def test_encoding_has_no_python_and_wide_row_numbers_give_the_same_index(spark):
    df = spark.createDataFrame([(i, " ".join("abcdef"[: 1 + i % 6])) for i in range(30)], "i long, t string")
    near = V.fit_vocabulary(df, "t", "i")
    far = V.fit_vocabulary(df.withColumn("i", F.col("i") + (1 << 50)), "t", "i")
    shift = F.col("first_row") - (1 << 50)
    assert sorted(near.collect()) == sorted(far.withColumn("first_row", shift).collect())
    plan = V.encode(df, "i", "t", near, 100, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_train_predict_distil_and_explain(spark):
    df = corpus(spark)
    model = T.fit_text_model(df, "uid", F.col("t"), "y")
    assert model.size == 8
    out = model.predict(df, F.col("t"), ["uid", "y"])
    r = out.first()
    assert len(r.logits) == len(r.probs) == 3 and sum(r.probs) == pytest.approx(1.0)
    from labelloom.functions.arrays import argmax

    assert out.filter(argmax("probs") == F.col("y")).count() > 110
    small = T.fit_text_model(df, "uid", F.col("t"), "y", num_words=3)
    assert small.size == 3 and len(small.coefficients(df).collect()) == 9

    soft = T.soft_label_rows(df, out.select("uid", "logits"), "uid", "y", 3)
    assert soft.count() == 360
    assert soft.groupBy("uid").agg(F.sum("soft_weight").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0
    texts = df.withColumnRenamed("y", "soft_label")
    student = T.fit_text_model(texts, "uid", F.col("t"), "soft_label", soft=soft, weight="soft_weight", like=model)
    assert student.predict(df, F.col("t"), ["uid", "y"]).filter(argmax("probs") == F.col("y")).count() > 110
    with pytest.raises(Exception, match="without teacher scores"):
        T.soft_label_rows(df, out.filter("uid > 5").select("uid", "logits"), "uid", "y", 3).collect()

    # Values of the words present and of all absent ones are the distance to the mean logit.
    counts = T.word_counts(df, F.col("t"), "uid")
    means = T.mean_counts(counts, F.lit(120))
    coefs = model.coefficients(df)
    parts = X.absent_words(counts, coefs, means, df.select("uid"), 3)
    shift = {(r.uid, r.cls): r.logit_shift for r in parts.collect()}
    logits = {r.uid: r.logits for r in out.collect()}
    middle = [np.mean([v[c] for v in logits.values()]) for c in range(3)]
    for (uid, c), value in shift.items():
        assert value == pytest.approx(logits[uid][c] - middle[c], abs=1e-9)
    attr = X.linear_attributions(counts, coefs, means)
    present = attr.select("uid", F.posexplode("values").alias("cls", "v")).groupBy("uid", "cls").agg(F.sum("v").alias("v"))
    assert present.join(parts, ["uid", "cls"]).filter("abs(v - present) > 1e-9").isEmpty()


def test_texts_without_a_known_word_have_features_and_remainders(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "word string, idx long")
    df = spark.createDataFrame([(1, "a b b zz"), (2, "zz"), (3, None), (4, "")], "uid long, t string")
    got = {r.uid: r.features for r in T.text_features(df, "uid", F.col("t"), vocab, 2).collect()}
    assert {k: v.toArray().tolist() for k, v in got.items()} == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}
    coefs = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 10.0)], "token string, cls int, coef double")
    means = spark.createDataFrame([("a", 0.5)], "token string, mean double")
    parts = X.absent_words(T.word_counts(df, F.col("t"), "uid"), coefs, means, df, 1)
    assert {r.uid: (r.present, r.absent, r.logit_shift) for r in parts.collect()} == {
        1: (20.5, 0.0, 20.5), 2: (0.0, -0.5, -0.5), 3: (0.0, -0.5, -0.5), 4: (0.0, -0.5, -0.5)}


def test_importance_skips_blanks_and_breaks_ties_by_token(spark):
    rows = [("u", i, t, c, v) for i, (t, v) in enumerate([(" b ", 1.0), ("a", -1.0), ("", 9.0), (" ", 9.0), ("b", 1.0)]) for c in (0, 1)]
    df = X.occurrences(spark.createDataFrame(rows, "uid string, pos int, token string, cls int, value double"), (0, 1))
    got = [(r.token, r.mean_abs, r["count"]) for r in X.global_importance(df, 10).collect()]
    assert got == [("a", 2.0, 1), ("b", 2.0, 2)]
    per = X.class_importance(df, 10, min_count=2).collect()
    assert {(r.cls, r.token, r["count"]) for r in per} == {(0, "b", 2), (1, "b", 2)}


def test_explanations_compared(spark):
    base = [("u", i, t, w) for i, (t, w) in enumerate([("a", 0.9), ("b", -0.8), ("c", 0.1), ("d", 0.1)])]
    other = [("u", i, t, w) for i, (t, w) in enumerate([("b", 0.7), ("a", 0.6), ("c", 0.2), ("x", 0.1)])]
    schema = "uid string, pos int, token string, weight double"
    pairs = X.token_pairs(spark.createDataFrame(base, schema), spark.createDataFrame(other, schema), 2)
    d = {r.token: r.delta for r in pairs.collect()}
    assert d["d"] is None and d["x"] is None and d["a"] == pytest.approx(-0.3)
    r = X.compare_explanations(pairs).first()
    ranks = np.corrcoef([3, 1, 2], [2, 3, 1])[0, 1]
    assert (r.jaccard, r.n_shared) == (1.0, 3) and r.spearman == pytest.approx(ranks)
    few = X.token_pairs(spark.createDataFrame(base[:2], schema), spark.createDataFrame(other[:2], schema), 2)
    assert X.compare_explanations(few).first().spearman is None


def test_explanations_whose_shared_weights_all_tie_have_no_correlation(spark):
    schema = "uid string, pos int, token string, weight double"
    rows = [(u, i, t, w) for u, n, w in (("two", 2, 1.0), ("four", 4, 1.0), ("one", 1, 2.0)) for i, t in enumerate("abcd"[:n])]
    rises = [("half", i, t, float(i)) for i, t in enumerate("abcd")]
    base = spark.createDataFrame(rows + [("half", i, t, 1.0) for i, t in enumerate("abcd")], schema)
    compared = X.compare_explanations(X.token_pairs(base, spark.createDataFrame(rows + rises, schema), 2))
    assert {r.uid: (r.n_shared, r.spearman) for r in compared.collect()} == {
        "two": (2, None), "four": (4, None), "one": (1, None), "half": (4, None)}
    assert tuple(X.comparison_summary(compared).first())[::2] == (4, None)


def test_explanations_are_paired_where_the_texts_were_dealt(spark, sf_dir):
    """Only whole texts are shuffled; their words, weights and ranks are not."""
    from catalogue.explanation_queries import token_delta

    plan = token_delta(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange " in line]
    assert dealt and all("REPARTITION_BY_NUM" in line and "token" not in line for line in dealt)


def test_pairs_of_equal_and_missing_weights(spark):
    schema = "uid long, pos int, token string, weight double"
    base = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", -1.0), (1, 2, "c", None), (2, 0, "a", None)], schema)
    other = spark.createDataFrame([(1, 5, "b", 2.0), (1, 6, "d", 3.0), (3, 0, "z", 0.0)], schema)
    got = {(r.uid, r.token): tuple(r)[2:] for r in X.token_pairs(base, other, 1).collect()}
    assert got == {
        (1, "a"): (1.0, None, True, False, None), (1, "b"): (-1.0, 2.0, False, False, 3.0), (1, "c"): (None, None, False, False, None),
        (1, "d"): (None, 3.0, False, True, None), (2, "a"): (None, None, True, False, None), (3, "z"): (None, 0.0, False, True, None)}
