"""Aggregating token attributions, and producing them for linear text models.

Attributions are a table of occurrences ``(uid, pos, token, values)``, with one value for each class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.arrays import argmax
from labelloom.functions.text import WS

DIGITS = 12


def _clean(attributions: DataFrame) -> DataFrame:
    """Tokens without the white space around them; empty ones are left out."""
    token = F.regexp_replace("token", rf"^[{WS}]+|[{WS}]+$", "")
    return attributions.withColumn("token", token).filter(F.col("token") != "")


def occurrences(attributions: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Attributions listed by class, ``(uid, pos, token, cls, value)``, as one row for each occurrence (a shuffle by place).

    A class without a value at a place has null there."""
    place = [c for c in ("uid", "pos") if c in attributions.columns]
    each = [F.sum(F.when(F.col("cls") == c, F.col("value"))) for c in classes]
    return attributions.groupBy(*place, "token").agg(F.array(*each).alias("values"))


def global_importance(attributions: DataFrame, k: int = 100) -> DataFrame:
    """Top k tokens by mean over occurrences of the absolute value summed over classes.

    Each row is an occurrence, so the rows shrink to one record per token in every task; null values count nothing.
    Ties are listed by token.  The trim to k happens in every task before the last merge."""
    value = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + F.abs(F.coalesce(v, F.lit(0.0))))
    # Cleaned after the first sums: once for each spelling, not for each occurrence.
    spelled = attributions.select("token", value.alias("_value")).groupBy("token").agg(
        F.sum("_value").alias("_total"), F.count(F.lit(1)).alias("count"))
    per_token = _clean(spelled).groupBy("token").agg(F.sum("_total").alias("_total"), F.sum("count").alias("count"))
    mean = F.round(F.col("_total") / F.col("count"), DIGITS)
    return per_token.select("token", mean.alias("mean_abs"), "count").orderBy(
        F.desc("mean_abs"), "token"
    ).limit(k)


def class_importance(attributions: DataFrame, k: int = 30, min_count: int = 3) -> DataFrame:
    """Top k tokens per class by mean signed value, tokens seen fewer than ``min_count`` times left out."""
    listed = attributions.select("token", F.posexplode("values").alias("cls", "value")).filter(F.col("value").isNotNull())
    spelled = listed.groupBy("cls", "token").agg(F.sum("value").alias("_total"), F.count(F.lit(1)).alias("count"))
    summed = _clean(spelled).groupBy("cls", "token").agg(F.sum("_total").alias("_total"), F.sum("count").alias("count"))
    per_token = summed.select("cls", "token", F.round(F.col("_total") / F.col("count"), DIGITS).alias("mean_value"), "count")
    w = Window.partitionBy("cls").orderBy(F.desc("mean_value"), "token")
    return (
        per_token.filter(F.col("count") >= min_count)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )


def tag_examples(examples: DataFrame, labels: Sequence[str], probs: str = "probs", y: str = "y") -> DataFrame:
    """Names of the true and the predicted class and whether they agree."""
    names = F.array(*[F.lit(n) for n in labels])
    pred = argmax(probs)
    return examples.select(
        "*", F.get(names, F.col(y).cast("int")).alias("true_label"),
        F.get(names, pred).alias("pred_label"), (pred == F.col(y)).alias("correct"),
    )


# ------------------------------------------------------------------------ model comparison
def token_pairs(base: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """Tokens of either explanation per text: both weights, delta, membership of the top k.

    Inputs: ``(uid, pos, token, weight)``, one row per text and token, of the class to explain.
    The top k are the largest absolute weights, equal ones in listing order.
    """
    both = base.withColumn("model", F.lit(0)).unionByName(other.withColumn("model", F.lit(1)))

    def of(model: int, col: Column) -> Column:
        return F.max(F.when(F.col("model") == model, col))

    names = ("base", "other")
    each = [of(m, value).alias(f"{kind}_{n}") for m, n in enumerate(names) for kind, value in (
        ("w", F.col("weight")), ("_pos", F.col("pos")), ("_in", F.lit(True)))]
    # Paired first: one row a token is ranked, not one for each model.  Inputs dealt by text are not shuffled again.
    paired = both.groupBy("uid", "token").agg(*each)
    for n in names:
        order = Window.partitionBy("uid").orderBy(F.desc_nulls_last(f"_in_{n}"), F.desc(F.abs(f"w_{n}")), f"_pos_{n}")
        paired = paired.withColumn(f"top_{n}", F.col(f"_in_{n}").isNotNull() & (F.row_number().over(order) <= k))
    return paired.select(
        "uid", "token", "w_base", "w_other", "top_base", "top_other", (F.col("w_other") - F.col("w_base")).alias("delta"))


def compare_explanations(pairs: DataFrame) -> DataFrame:
    """Per text: Jaccard overlap of the top-k tokens and Spearman correlation of the shared
    tokens (average ranks; null below three shared tokens or without variation)."""
    shared = F.col("w_base").isNotNull() & F.col("w_other").isNotNull()
    s = pairs.withColumn("_s", shared)

    def average_rank(c: str) -> Column:
        w = Window.partitionBy("uid", "_s").orderBy(c)
        ties = F.count(F.lit(1)).over(Window.partitionBy("uid", "_s", c))
        return F.rank().over(w) + (ties - 1) / F.lit(2.0)

    ranked = s.withColumn("_ra", average_rank("w_base")).withColumn("_rb", average_rank("w_other"))
    inter = F.count_if(F.col("top_base") & F.col("top_other"))
    union = F.count_if(F.col("top_base") | F.col("top_other"))
    n_shared = F.count_if("_s")
    ra, rb = F.when(F.col("_s"), F.col("_ra")), F.when(F.col("_s"), F.col("_rb"))
    # An aggregate is finished for every text, also behind a condition, and corr divides by zero where all ranks tie.
    rho = F.covar_pop(ra, rb) / F.nullif(F.sqrt(F.var_pop(ra) * F.var_pop(rb)), F.lit(0.0))
    return ranked.groupBy("uid").agg(
        (inter / F.greatest(union, F.lit(1))).alias("jaccard"),
        n_shared.alias("n_shared"),
        F.when(
            (n_shared >= 3) & (F.var_pop(ra) > 0) & (F.var_pop(rb) > 0), rho
        ).alias("spearman"),
    )


def comparison_summary(per_text: DataFrame) -> DataFrame:
    return per_text.agg(
        F.count(F.lit(1)).alias("n_instances"),
        F.avg("jaccard").alias("mean_jaccard"),
        F.avg("spearman").alias("mean_spearman"),
    )


# ------------------------------------------------------------------ linear-model producers
def linear_attributions(counts: DataFrame, coefficients: DataFrame, means: DataFrame) -> DataFrame:
    """``(uid, token, values)``: Shapley values of the words present, for a linear text model in logit space, coef * (count - mean
    count) for every class.

    Words that are absent from a text have a value too, -coef * mean; :func:`absent_words` gives their sum.
    ``counts``: (uid, token, x), all words of the texts; ``coefficients``: (token, cls, coef); ``means``: (token, mean).
    A word the model does not know is worth nothing, one without a mean has the mean 0.
    """
    return _linear(counts, coefficients, means).select("uid", "token", "values")


def _model_table(coefficients: DataFrame, means: DataFrame) -> DataFrame:
    """``(token, mean, coefs)``: one row for each word of the model, coefficients in class order."""
    rows = coefficients.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("cls", "coef"))).alias("c"))  # one entry a class
    rows = rows.select("token", F.transform("c", lambda e: e["coef"]).alias("coefs"))
    return rows.join(means, "token", "left").select("token", F.coalesce("mean", F.lit(0.0)).alias("mean"), "coefs")


def _linear(counts: DataFrame, coefficients: DataFrame, means: DataFrame) -> DataFrame:
    """Words of the texts with ``values`` and ``means`` (coef * mean), null for words the model does not know."""
    both = counts.join(_model_table(coefficients, means), "token", "left")
    return both.select(
        "uid", "token", F.transform("coefs", lambda c: c * (F.col("x") - F.col("mean"))).alias("values"),
        F.transform("coefs", lambda c: c * F.col("mean")).alias("means"))


def absent_words(counts: DataFrame, coefficients: DataFrame, means: DataFrame, uids: DataFrame, n_classes: int) -> DataFrame:
    """``(uid, cls, present, absent, logit_shift)`` for every text of ``uids`` and class.

    ``present`` sums the values of the words that stand in the text, ``absent`` those of all other words of the model: the sum of
    coef * mean over the whole model is one number for each class, and a text takes off what its own words have of it.
    Together they are the distance of the text's logit from the mean logit.
    """
    total = _model_table(coefficients, means).agg(F.array(*[
        F.coalesce(F.sum(F.get("coefs", F.lit(c)) * F.col("mean")), F.lit(0.0)) for c in range(n_classes)]).alias("t"))
    per_text = _linear(counts, coefficients, means).groupBy("uid").agg(*[
        F.sum(F.get(name, F.lit(c))).alias(f"{name}{c}") for name in ("values", "means") for c in range(n_classes)])
    rows = F.array(*[F.struct(F.lit(c).alias("cls"), F.coalesce(f"values{c}", F.lit(0.0)).alias("present"),
                              F.coalesce(f"means{c}", F.lit(0.0)).alias("own")) for c in range(n_classes)])
    each = uids.select("uid").join(per_text, "uid", "left").select("uid", F.inline(rows))
    each = each.crossJoin(total)  # one row
    absent = F.col("own") - F.get("t", F.col("cls"))
    return each.select("uid", "cls", "present", absent.alias("absent"), (F.col("present") + absent).alias("logit_shift"))
