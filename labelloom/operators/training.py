"""Text classifiers on MLlib, so that prediction tables exist.

Words are numbered by frequency in a distributed index, texts become sparse counts by a grouped aggregate, and multinomial
logistic regression is fitted on them.  Index, counts and training data stay tables; the driver holds the model's
matrix alone, at most ``num_words`` x classes numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.arrays import softmax
from labelloom.functions.staging import fresh_path, stage
from labelloom.functions.text import words
from labelloom.operators.vocab import fit_vocabulary, vocabulary_size

#: Words a model has weights for, at most; the most frequent ones of the training texts.
NUM_WORDS = 1 << 16


def text_features(df: DataFrame, id_col: str, text: Column, vocabulary: DataFrame, size: int) -> DataFrame:
    """``(id, features, n_distinct, n_known)`` for every row: counts of the words with an index up to ``size``, as sparse vectors, and how many
    such words and places of them there are.

    Written once.  The texts are dealt by id; their words meet the index, which is no longer than ``size``, and are counted where they are.  The
    vectors are made as plain structures and read back as vectors, so they never leave the JVM.
    """
    known = vocabulary.filter(F.col("idx") <= size).select(F.col("word").alias("token"), (F.col("idx") - 1).cast("int").alias("at"))
    known = F.broadcast(known) if size <= NUM_WORDS else known
    dealt = df.select(id_col, text.alias("_text")).filter(F.col(id_col).isNotNull()).repartition(id_col)
    places = dealt.select(id_col, F.explode(words(F.col("_text"))).alias("token")).join(known, "token")
    counts = places.groupBy(id_col, "at").agg(F.count(F.lit(1)).cast("double").alias("x"))
    rows = counts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("_f"), F.sum("x").cast("long").alias("n_known"))
    rows = df.select(id_col).join(rows, id_col, "left").withColumn("_f", F.coalesce("_f", F.array().cast("array<struct<at:int,x:double>>")))
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                      F.transform("_f", lambda p: p["at"]).alias("indices"), F.transform("_f", lambda p: p["x"]).alias("values"))
    path = fresh_path(df.sparkSession, "features")
    written = rows.select(id_col, vector.alias("features"), F.size("_f").cast("long").alias("n_distinct"),
                          F.coalesce("n_known", F.lit(0).cast("long")).alias("n_known"))
    written.write.parquet(path)
    schema = T.StructType([f if f.name != "features" else T.StructField("features", VectorUDT()) for f in written.schema])
    return df.sparkSession.read.schema(schema).parquet(path)


@dataclass(frozen=True)
class TextWords:
    """The words a model has weights for: index and how many of it count."""

    vocabulary: DataFrame
    size: int


@dataclass(frozen=True)
class TextModel(TextWords):
    classifier: LogisticRegressionModel

    def predict(self, df: DataFrame, text: Column, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns (the first tells rows apart), ``logits`` and ``probs``."""
        return self.score(df, text_features(df, keep[0], text, self.vocabulary, self.size), keep)

    def score(self, df: DataFrame, features: DataFrame, keep: Sequence[str]) -> DataFrame:
        """As ``predict``, with features that were made before."""
        rows = df.select(*keep).join(features.select(keep[0], "features"), keep[0])
        return self.classifier.transform(rows).select(
            *keep, vector_to_array("rawPrediction").alias("logits"), vector_to_array("probability").alias("probs"))

    def coefficients(self, df: DataFrame) -> DataFrame:
        """``(token, cls, coef)``: words x classes rows."""
        matrix = self.classifier.coefficientMatrix.toArray()  # one row per class (multinomial family)
        each = df.sparkSession.createDataFrame(
            pd.DataFrame({"idx": range(1, self.size + 1), "coef": matrix.T.tolist()}), "idx long, coef array<double>")
        named = each.join(self.vocabulary.select(F.col("word").alias("token"), "idx"), "idx")
        return named.select("token", F.posexplode("coef").alias("cls", "coef"))


def fit_words(texts: DataFrame, id_col: str, text: Column | str, num_words: int = NUM_WORDS) -> TextWords:
    """The most frequent words of the training texts (runs jobs)."""
    vocabulary = stage(fit_vocabulary(texts, text, id_col), "vocabulary")
    return TextWords(vocabulary, max(1, vocabulary_size(vocabulary, num_words + 1).first()[0] - 1))


def fit_text_model(
    train: DataFrame, id_col: str, text: Column, label: str, num_words: int = NUM_WORDS, max_iter: int = 20, reg: float = 0.01,
    soft: DataFrame | None = None, weight: str | None = None, like: TextWords | None = None, features: DataFrame | None = None,
) -> TextModel:
    """Fit on the training partition (runs jobs).

    The texts are normalised once and written; the index and the features read them from there.  ``soft`` holds labels and
    weights of its own (several rows a text, by id), ``like`` a model (or words) whose words are taken over, ``features`` the texts' features
    with these words, which then are not made again.
    """
    if features is not None and like is None:
        raise ValueError("features need the words they were made with")
    texts = train if features is not None else stage(train.select(id_col, label, text.alias("_text")), "texts")
    like = fit_words(texts, id_col, "_text", num_words) if like is None else like
    if features is None:
        features = text_features(texts, id_col, F.col("_text"), like.vocabulary, like.size)
    lr = LogisticRegression(
        featuresCol="features", labelCol=label, maxIter=max_iter, regParam=reg, family="multinomial", standardization=False,
    )
    if weight:
        lr = lr.setWeightCol(weight)
    labels = (texts if soft is None else soft).select(id_col, label, *([weight] if weight else []))
    training = stage(labels.join(features.select(id_col, "features"), id_col), "training")
    return TextModel(like.vocabulary, like.size, lr.fit(training))


def soft_label_rows(
    train: DataFrame, teacher: DataFrame, uid: str, label: str, n_classes: int,
    temperature: float = 4.0, alpha: float = 0.5,
) -> DataFrame:
    """Each training row once per class, weighted alpha * teacher + (1 - alpha) * truth.

    ``teacher``: (uid, logits) of the selected teacher on the training partition; a training
    row without teacher scores stops the job.
    """
    soft = teacher.select(uid, softmax("logits", temperature).alias("_soft"))
    joined = train.join(soft, uid, "left")
    classes = F.array(*[
        F.struct(
            F.lit(float(c)).alias("soft_label"),
            (
                F.lit(alpha) * F.coalesce(
                    F.get("_soft", F.lit(c)),
                    F.raise_error(F.lit("training row without teacher scores")).cast("double"),
                )
                + F.lit(1.0 - alpha) * (F.col(label) == c).cast("double")
            ).alias("soft_weight"),
        )
        for c in range(n_classes)
    ])
    return joined.select(*train.columns, F.inline(classes))


def word_counts(df: DataFrame, text: Column, uid: str) -> DataFrame:
    """``(uid, token, x)``: words of each text with their counts."""
    return (
        df.select(uid, F.explode(words(text)).alias("token"))
        .groupBy(uid, "token")
        .agg(F.count(F.lit(1)).alias("x"))
    )


def mean_counts(counts: DataFrame, n_texts: Column) -> DataFrame:
    """``(token, mean)``: mean count of every token over the background texts (absent ones count 0)."""
    return counts.groupBy("token").agg((F.sum("x") / n_texts).alias("mean"))
