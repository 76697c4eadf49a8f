"""One record of all selections, and what may only be done under it.

``gather`` makes the selections of a task from validation scores, ``freeze`` writes them once together with the
names that had to be there, ``comparison_families`` and ``materialise`` read that record: comparisons follow from what was selected,
and test rows of an ensemble can only be read while the record still holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.arrays import log_probs
from labelloom.functions.staging import publish
from labelloom.operators import ensemble, integrity, selection
from labelloom.plans import evaluation

RECORD = "name string, task string, role string, chosen string, inputs_sha256 string, digest string"


def gather(
    predictions: DataFrame, task: str, plan: evaluation.EnsemblePlan, teachers: Mapping[str, Sequence[str]], inputs_sha256: str,
) -> DataFrame:
    """``(name, task, role, chosen, inputs_sha256)``: best single system, teachers from their candidate lists, and the ensemble
    as ``members|rule``.  Names are ``role_task``.  Runs the jobs of the ensemble selection."""
    singles = evaluation.single_scores(predictions, plan)
    lists = {"best_single": list(plan.candidates), **{f"teacher_{k}": list(v) for k, v in teachers.items()}}
    rows = None
    for role, candidates in lists.items():
        own = selection.best(selection.listed(singles.drop("position"), "system", candidates), [])
        own = own.select(F.lit(role).alias("role"), F.col("system").alias("chosen"))
        rows = own if rows is None else rows.unionByName(own)
    top = evaluation.select_ensemble(predictions, plan).filter(F.col("rank") == 1)
    rows = rows.unionByName(top.select(F.lit("ensemble").alias("role"), F.concat_ws("|", "members", "rule").alias("chosen")))
    return rows.select(F.concat_ws("_", "role", F.lit(task)).alias("name"), F.lit(task).alias("task"), "role", "chosen",
                       F.lit(inputs_sha256).alias("inputs_sha256"))


def _digested(selections: DataFrame) -> DataFrame:
    digests = selection.selection_digest(selections, "name", ["task", "role", "chosen", "inputs_sha256"])
    return selections.join(digests, "name").select("name", "task", "role", "chosen", "inputs_sha256", "digest")


def freeze(selections: DataFrame, path: str, expected: Sequence[str]) -> DataFrame:
    """Write the record of all selections once and return it; a later call must find the same selections.

    Raises when an expected selection is missing or when the stored record differs.  Runs jobs; one row per selection.
    """
    spark = selections.sparkSession
    new = _digested(selections)
    have = {r["name"] for r in new.select("name").collect()}
    missing = sorted(set(expected) - have)
    if missing:
        raise RuntimeError("selections missing: " + ", ".join(missing))
    publish(new, path)
    record = spark.read.schema(RECORD).parquet(path)
    bad = integrity.freeze_check(record.select("name", "digest"), new.select("name", "digest"), sorted(have)).filter(
        "status <> 'ok'").orderBy("name").collect()
    if bad:
        raise RuntimeError("selections differ from the frozen record: " + ", ".join(f"{r['name']} {r.status}" for r in bad))
    return record


def frozen_record(spark: SparkSession, path: str) -> DataFrame:
    """The record, which has to exist."""
    try:
        return spark.read.schema(RECORD).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise RuntimeError(f"test data stays closed, no selection is frozen at {path}") from e


def violations(record: DataFrame, selections: DataFrame) -> Column:
    """Number of frozen selections that are no longer as they were, as a scalar subquery."""
    now = _digested(selections).select("name", F.col("digest").alias("_now"))
    both = record.select("name", "digest").join(now, "name", "left")
    return both.agg(F.count_if(~F.col("digest").eqNullSafe(F.col("_now"))).alias("n")).scalar()


def materialise(
    predictions: DataFrame, record: DataFrame, selections: DataFrame, task: str, n_classes: int, name: str = "ens",
    weights: Mapping[str, float] | None = None, members: Sequence[str] | None = None, run: Sequence[str] = ("seed", "split"),
) -> DataFrame:
    """The selected ensemble of a task as one more system: ``run``, uid, y, ``probs``, ``logits`` and ``system``.

    With ``members`` an ensemble declared beforehand instead (even means, no selection).  Either way every row passes the
    record: where a frozen selection has changed or gone since, reading a row raises.
    """
    if members is None:
        own = record.filter((F.col("task") == task) & (F.col("role") == "ensemble")).collect()
        if len(own) != 1:
            raise RuntimeError(f"no ensemble of {task} is frozen")
        listed, rule = own[0].chosen.split("|")
        members = listed.split("+")
    else:
        rule = "uniform_prob_mean"
    combined = ensemble.combine(predictions, members, rule, n_classes, list(run), dict(weights or {}))
    broken = F.raise_error(F.lit("test data stays closed, selections are not as frozen")).cast("array<double>")
    held = combined.withColumn("probs", F.when(violations(record, selections) == 0, F.col("probs")).otherwise(broken))
    return ensemble.as_system(held, name).withColumn("logits", log_probs("probs"))


def comparison_families(record: DataFrame, declared: DataFrame) -> DataFrame:
    """``(task, a, b)`` from declared pairs ``(task, a, b)`` in which ``@role`` stands for what that role's selection of the task
    chose.  Pairs whose selection does not exist or that name one system twice are left out."""
    chosen = record.select("task", F.concat(F.lit("@"), F.col("role")).alias("ref"), "chosen")
    out = declared
    for side in ("a", "b"):
        refs = chosen.select(F.col("task").alias("_task"), F.col("ref").alias("_ref"), "chosen")
        out = out.join(refs, (F.col("task") == F.col("_task")) & (F.col(side) == F.col("_ref")), "left")
        named = F.when(F.startswith(F.col(side), F.lit("@")), F.col("chosen")).otherwise(F.col(side))
        out = out.withColumn(side, named).drop("_task", "_ref", "chosen")
    return out.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("task", "a", "b").distinct()
