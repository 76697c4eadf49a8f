"""Classification metrics over prediction tables, any number of runs at once.

A prediction table is long: run columns, ``uid``, truth ``y`` and ``probs`` (or a ``pred``
column).  It is read once and reduced map-side to confusion cells; everything else is
arithmetic on runs x classes x classes rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import argmax


def predicted(df: DataFrame, probs: str = "probs") -> DataFrame:
    """Add ``pred``: the first class with the largest probability."""
    return df.withColumn("pred", argmax(probs))


def confusion_cells(df: DataFrame, run: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Non-empty cells of every run's confusion matrix."""
    return df.groupBy(*run, F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(cells: DataFrame, run: Sequence[str], n_classes: int) -> DataFrame:
    """All cells, empty ones as 0: each run's few rows plus one explicit zero per cell."""
    cls = F.sequence(F.lit(0), F.lit(n_classes - 1))
    zeros = (
        cells.select(*run).distinct()
        .withColumn("y", F.explode(cls)).withColumn("pred", F.explode(cls))
        .withColumn("n", F.lit(0).cast("long"))
    )
    return cells.unionByName(zeros).groupBy(*run, "y", "pred").agg(F.sum("n").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(cells: DataFrame, run: Sequence[str], n_classes: int) -> DataFrame:
    """Precision, recall, F1 and support per listed class; absent classes appear with zeros."""
    n, zero = F.col("n"), F.lit(0).cast("long")

    def entry(cls: Column, support: Column, predicted_n: Column, hit: Column) -> Column:
        return F.struct(
            cls.cast("int").alias("cls"), support.alias("support"),
            predicted_n.alias("n_pred"), hit.alias("tp"),
        )

    hit = F.when(F.col("y") == F.col("pred"), n).otherwise(zero)
    entries = F.array(
        entry(F.col("y"), n, zero, hit),
        entry(F.col("pred"), zero, n, zero),
        *[entry(F.lit(c), zero, zero, zero) for c in range(n_classes)],
    )
    sums = (
        cells.select(*run, F.inline(entries))
        .groupBy(*run, "cls")
        .agg(F.sum("support").alias("support"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"))
    )
    scored = sums.select(
        *run, "cls", "support", "n_pred", "tp",
        _ratio(F.col("tp"), F.col("n_pred")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.select(
        *run, "cls", "precision", "recall", _ratio(F.lit(2.0) * p * r, p + r).alias("f1"),
        "support", "n_pred", "tp",
    )


def run_metrics(cells: DataFrame, run: Sequence[str], n_classes: int) -> DataFrame:
    """n, accuracy and macro precision / recall / F1 (unweighted over all listed classes)."""
    classes = per_class(cells, run, n_classes)

    def macro(c: str) -> Column:
        # Added in class order, so that the value does not depend on the shuffle.
        values = F.array_sort(F.collect_list(F.struct("cls", c)))
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x[c]) / F.lit(float(n_classes))

    return classes.groupBy(*run).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        macro("precision").alias("macro_precision"),
        macro("recall").alias("macro_recall"),
        macro("f1").alias("macro_f1"),
    )


def mean_sd(metrics: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation over runs (0 for a single run)."""
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"),
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_sd") for c in columns],
    )


def mean_score(
    metrics: DataFrame, by: Sequence[str], n_runs: int, score: str = "macro_f1"
) -> DataFrame:
    """Mean score per candidate; a candidate with a missing run stops the job."""
    counted = metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), F.avg(score).alias("score"))
    complete = F.when(F.col("n_runs") == n_runs, F.col("score")).otherwise(
        F.raise_error(F.lit("a candidate lacks a finished run")).cast("double")
    )
    return counted.select(*by, complete.alias("score"))


def systems_from_patterns(
    predictions: DataFrame, run_id: str, catalogue: dict[str, str]
) -> DataFrame:
    """Attach display names: ``catalogue`` maps a system name to a pattern of run ids.

    A run that matches several patterns appears once under each."""
    matches = F.filter(
        F.array(*[
            F.when(F.col(run_id).rlike(f"^(?:{pattern})$"), F.lit(name)) for name, pattern in catalogue.items()
        ]),
        lambda s: s.isNotNull(),
    )
    return predictions.withColumn("system", F.explode(matches))
