"""Selection on validation, freeze, test ensembles, statistics and report.

One prediction table in, report tables out.  The prediction rows are read a handful of times,
each time reduced map-side; everything after that has systems x runs rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.arrays import log_probs
from labelloom.operators import ensemble, metrics, selection, stats

METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1")


@dataclass(frozen=True)
class EnsemblePlan:
    candidates: Sequence[str]
    n_classes: int
    seeds: Sequence[int]
    size: int = 3
    rules: Sequence[str] = ("uniform_prob_mean", "hard_majority", "valf1_weighted_prob_mean")
    exhaustive: bool = False


def run_scores(predictions: DataFrame, run: Sequence[str], n_classes: int) -> DataFrame:
    cells = metrics.confusion_cells(metrics.predicted(predictions), run)
    return metrics.run_metrics(cells, run, n_classes)


def single_scores(predictions: DataFrame, plan: EnsemblePlan) -> DataFrame:
    """``(system, score, position)``: mean validation macro-F1 over all seeds."""
    val = selection.validation_only(predictions).filter(F.col("system").isin(*plan.candidates))
    scores = metrics.mean_score(
        run_scores(val, ["system", "seed"], plan.n_classes), ["system"], len(plan.seeds)
    )
    return selection.listed(scores, "system", plan.candidates)


def select_ensemble(predictions: DataFrame, plan: EnsemblePlan) -> DataFrame:
    """Score every (member subset, rule) candidate on validation; ``rank`` 1 is the choice.

    With top-k member choice only the k best single systems form a subset: those few scores
    are read first (a job over systems x seeds rows).  Equal scores keep candidate order.
    """
    singles = single_scores(predictions, plan)
    if plan.exhaustive:
        chosen = ensemble.subsets(plan.candidates, plan.size)
    else:
        top = selection.top_k(singles, [], plan.size).orderBy("rank").collect()
        chosen = [tuple(r.system for r in top)]
    candidates = [(s, r) for s in chosen for r in plan.rules]
    val = selection.validation_only(predictions)
    matrix = ensemble.member_matrix(val, plan.candidates, plan.n_classes, ["seed"])
    cells = ensemble.candidate_cells(
        matrix, plan.candidates, candidates,
        selection.score_array(singles, "system", plan.candidates), plan.n_classes, ["seed"],
    )
    per_run = metrics.run_metrics(cells, ["candidate", "seed"], plan.n_classes)
    mean = per_run.groupBy("candidate").agg(
        F.round(F.avg("macro_f1"), ensemble.DIGITS).alias("mean_val_macro_f1")
    )
    members = F.array(*[F.lit("+".join(s)) for s, _ in candidates])
    rules = F.array(*[F.lit(r) for _, r in candidates])
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_val_macro_f1"), "candidate")
    return mean.select(
        "candidate", F.get(members, F.col("candidate")).alias("members"),
        F.get(rules, F.col("candidate")).alias("rule"), "mean_val_macro_f1",
        F.row_number().over(w).alias("rank"),
    )


def materialise_ensemble(
    predictions: DataFrame, members: Sequence[str], rule: str, n_classes: int, name: str,
    weights: dict[str, float] | None = None, run: Sequence[str] = ("seed", "split"),
) -> DataFrame:
    """An ensemble as one more system: same columns as its members, ``logits`` = log of its
    probabilities.  Call it for the test partition only after the freeze is asserted."""
    combined = ensemble.combine(predictions, members, rule, n_classes, list(run), weights)
    return ensemble.as_system(combined, name).withColumn("logits", log_probs("probs"))


def system_report(
    predictions: DataFrame, n_classes: int, level: float = 0.95,
    seeds: Sequence[int] | None = None, replicates: int = 2000, run: Sequence[str] = ("seed",),
) -> DataFrame:
    """Per system: runs, mean and SD of the four headline metrics, t interval of macro-F1 and,
    when ``seeds`` are listed, the bootstrap interval over items.

    ``run`` names the columns that tell the runs of a system apart; with folds ``("seed", "fold")``.
    The bootstrap needs runs over the same items, so folds have none.
    """
    if seeds is not None and tuple(run) != ("seed",):
        raise ValueError("runs on different items cannot be resampled jointly")
    scores = run_scores(predictions, ["system", *run], n_classes)
    report = stats.t_interval(metrics.mean_sd(scores, ["system"], METRICS), "macro_f1", level)
    if seeds is None:
        return report
    boot = stats.bootstrap_interval(
        metrics.predicted(predictions), ["system"], "seed", seeds, n_classes, replicates, level)
    return report.join(boot, "system", "left")


def campaign_report(
    predictions: DataFrame, n_classes: Mapping[str, int], systems: Mapping[str, str], run_id: str = "run_id", level: float = 0.95,
) -> DataFrame:
    """The system report of all tasks in one table: ``task``, the report's columns and ``place`` by mean macro-F1 in the task.

    ``n_classes``: classes of each task; ``systems``: name -> pattern of the run ids that make it up, over all tasks.  A system
    without runs in a task has no row there.
    """
    named = metrics.systems_from_patterns(predictions, run_id, dict(systems))
    report = None
    for task, n in n_classes.items():
        own = system_report(named.filter(F.col("task") == task), n, level).withColumn("task", F.lit(task))
        report = own if report is None else report.unionByName(own)
    w = Window.partitionBy("task").orderBy(F.desc("macro_f1_mean"), "system")
    return report.withColumn("place", F.row_number().over(w))


def class_report(predictions: DataFrame, n_classes: int, run: Sequence[str] = ("seed",)) -> DataFrame:
    """Per system and class: mean and SD of precision, recall and F1 over runs."""
    run = ["system", *run]
    cells = metrics.confusion_cells(metrics.predicted(predictions), run)
    return metrics.mean_sd(
        metrics.per_class(cells, run, n_classes), ["system", "cls"], ("precision", "recall", "f1")
    )


def task_report(
    predictions: DataFrame, pairs: Sequence[tuple[str, str]], n_classes: int,
    seeds: Sequence[int], n_train: int, n_test: int, replicates: int = 2000,
) -> dict[str, DataFrame]:
    """Everything the report of one task shows, from its test predictions."""
    return {
        "systems": system_report(predictions, n_classes, seeds=seeds, replicates=replicates),
        "classes": class_report(predictions, n_classes),
        "comparisons": comparison_report(predictions, pairs, n_classes, n_train, n_test),
    }


def comparison_report(
    predictions: DataFrame, pairs: Sequence[tuple[str, str]], n_classes: int, n_train: int | Column, n_test: int | Column,
    run: Sequence[str] = ("seed",),
) -> DataFrame:
    """Corrected t test with Holm adjustment and per-run McNemar p-values for declared pairs.

    Runs of two systems are paired on all ``run`` columns.  The sizes may be scalar subqueries.
    """
    spark, run = predictions.sparkSession, list(run)
    scores = run_scores(predictions, ["system", *run], n_classes).withColumn("task", F.lit("t"))
    table = spark.createDataFrame([("t", a, b) for a, b in pairs], "task string, a string, b string")
    diffs = stats.paired_differences(scores, table, "task", "system", run)
    diffs = diffs.withColumn("n_train", F.lit(n_train)).withColumn("n_test", F.lit(n_test))
    tests = stats.corrected_ttest(diffs, ["task", "a", "b"], F.col("n_train"), F.col("n_test"))
    adjusted = stats.holm(tests, ["task"], "p", ["a", "b"]).drop("task")
    systems = sorted({s for pair in pairs for s in pair})
    masks = stats.correctness_masks(metrics.predicted(predictions), systems, run)
    per_run = stats.mcnemar(stats.mcnemar_counts(masks, systems, pairs, run))
    listed = per_run.groupBy("a", F.col("b_system").alias("b")).agg(
        F.array_sort(F.collect_list(F.struct(*run, "p"))).alias("mcnemar")
    )
    return adjusted.join(listed, ["a", "b"], "left")
