"""Choosing models on validation scores only, writing the choice once, freezing all choices.

Candidate tables are small (one row per candidate and run).  Every choice names an explicit
order, so that equal scores resolve the same way on every engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.functions.staging import publish
from labelloom.operators.integrity import framed


def validation_only(predictions: DataFrame, split: str = "split") -> DataFrame:
    """Selectors see the validation partition and nothing else."""
    return predictions.filter(F.col(split) == "val")


def listed(candidates: DataFrame, column: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the place of each candidate in the declared list; others are dropped."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(column)).cast("int")
    return candidates.withColumn(name, place - 1).filter(F.col(name) >= 0)


def top_k(scores: DataFrame, by: Sequence[str], k: int, score: str = "score",
          position: str = "position") -> DataFrame:
    """The k best candidates per group, equal scores in listing order, with their ``rank``."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), position))).filter(
        F.col("rank") <= k
    )


def best(scores: DataFrame, by: Sequence[str], score: str = "score",
         position: str = "position") -> DataFrame:
    """First maximum per group."""
    return top_k(scores, by, 1, score, position).drop("rank")


def score_array(scores: DataFrame, column: str, members: Sequence[str], score: str = "score") -> Column:
    """Scores of the listed members as one array (scalar subquery), in listing order."""
    row = scores.agg(
        F.array(*[F.max(F.when(F.col(column) == m, F.col(score))) for m in members]).alias("a")
    )
    return row.select("a").scalar()


def selection_digest(selections: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """``(name, digest)`` over the content of each selection."""
    return selections.select(F.col(name).alias("name"), F.sha2(framed([name, *columns]), 256).alias("digest"))


def write_once(selection: DataFrame, path: str, name: str = "name") -> DataFrame:
    """Store a selection table unless it exists; an existing one must agree.

    ``selection`` needs ``name``, ``chosen`` and ``inputs_sha256``.  A repeat with other inputs
    or another choice raises, also when two write at once: one of them stores its table.  Runs jobs; the table has one
    row per selection.
    """
    spark: SparkSession = selection.sparkSession
    new = selection.select(name, "chosen", "inputs_sha256")
    if publish(new.withColumn("frozen_at", F.current_timestamp()), path):
        return spark.read.parquet(path)
    old = spark.read.schema(new.schema).parquet(path)
    a = old.select(name, F.col("chosen").alias("c0"), F.col("inputs_sha256").alias("i0"))
    differing = (
        a.join(new, name, "full")
        .select(
            name,
            F.col("i0").eqNullSafe(F.col("inputs_sha256")).alias("same_inputs"),
            F.col("c0").eqNullSafe(F.col("chosen")).alias("same_choice"),
        )
        .filter(~(F.col("same_inputs") & F.col("same_choice")))
        .orderBy(name)
        .collect()
    )
    if differing:
        what = ", ".join(
            f"{r[name]}: {'choice' if r.same_inputs else 'inputs'} changed" for r in differing
        )
        raise RuntimeError(f"selection differs from the stored one ({what})")
    return spark.read.parquet(path)


def resolve_runs(predictions: DataFrame, selection: DataFrame, on: Sequence[str], chosen: str) -> DataFrame:
    """Rows of the selected variant only: join on the group and the chosen setting.

    ``selection`` holds one row per group, so it is tiny and the join keeps every prediction
    row of the selected variant exactly once."""
    return predictions.join(selection.select(*on, chosen), [*on, chosen], "left_semi")


# ------------------------------------------------------------------------ early stopping
def early_stop(history: DataFrame, run: Sequence[str], epoch: str, score: str, patience: int) -> DataFrame:
    """Per training run: best epoch (first strict maximum before the stop), its score, and how
    many epochs were run.

    Training stops at the first epoch that ends ``patience`` epochs in a row without a new
    strict maximum; patience 0 never stops.
    """
    past = Window.partitionBy(*run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    improved = F.col(score) > F.coalesce(F.max(score).over(past), F.lit(float("-inf")))
    marked = history.select(
        *run, F.col(epoch).alias("_e"), F.col(score).alias("_s"), improved.alias("_up"),
        F.row_number().over(Window.partitionBy(*run).orderBy(epoch)).alias("_i"),
        F.count(F.lit(1)).over(Window.partitionBy(*run)).alias("_n"),
    )
    upto_e = Window.partitionBy(*run).orderBy("_i").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    last_up = F.coalesce(F.max(F.when(F.col("_up"), F.col("_i"))).over(upto_e), F.lit(0))
    flat = marked.withColumn("_bad", F.col("_i") - last_up)
    all_epochs = Window.partitionBy(*run)
    stop = (
        F.min(F.when(F.col("_bad") >= patience, F.col("_i"))).over(all_epochs)
        if patience
        else F.lit(None).cast("int")
    )
    per_run = flat.withColumn("_stop", F.coalesce(stop, F.col("_n").cast("int")))
    seen = per_run.filter(F.col("_i") <= F.col("_stop"))
    # Improvements grow in epoch and score alike, so the last one is the best one.
    return seen.groupBy(*run).agg(
        F.max(F.when(F.col("_up"), F.col("_e"))).alias("best_epoch"),
        F.max(F.when(F.col("_up"), F.col("_s"))).alias("best_score"),
        F.max("_stop").cast("int").alias("epochs_run"),
        (F.max("_stop") < F.max("_n")).alias("stopped_early"),
    )
