"""Combining the predictions of several systems.

Members are filtered first, then one aggregation per text key sums class scores as plain
columns (map-side combined); nothing is collected per key.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import argmax, let

RULES = ("uniform_prob_mean", "valf1_weighted_prob_mean", "hard_majority")  # fixed values
DIGITS = 12


def _rounded(scores: Column) -> Column:
    """Sums of doubles depend on the order of addition in the last bits; settle them before
    any comparison."""
    return F.transform(scores, lambda s: F.round(s, DIGITS))


def _pick(rule: str, probs: Column, weighted: Column, votes: Column, k: int) -> Column:
    """Scores of one rule from member sums.  ``votes`` ties fall back to the uniform mean."""
    if rule == "uniform_prob_mean":
        return probs
    if rule == "valf1_weighted_prob_mean":
        return weighted
    if rule == "hard_majority":

        def settle(v: Column) -> Column:
            leaders = let(F.array_max(v), lambda top: F.filter(v, lambda x: x == top))
            return F.when(F.size(leaders) > 1, probs).otherwise(
                F.transform(v, lambda x: x / F.lit(float(k)))
            )

        return let(votes, settle)
    raise ValueError(f"unknown ensemble rule: {rule}")


def combine(
    predictions: DataFrame,
    members: Sequence[str],
    rule: str,
    n_classes: int,
    run: Sequence[str],
    weights: dict[str, float] | None = None,
    system: str = "system",
    uid: str = "uid",
) -> DataFrame:
    """``run``, uid, y and the combined ``probs`` of the members."""
    classes = range(n_classes)
    k = len(members)
    w = F.lit(0.0)
    for m in members:
        w = F.when(F.col(system) == m, F.lit(float((weights or {}).get(m, 1.0)))).otherwise(w)
    chosen = predictions.filter(F.col(system).isin(*members)).select(
        *run, uid, "y", w.alias("_w"), argmax("probs").alias("_vote"),
        *[F.get("probs", F.lit(c)).cast("double").alias(f"_p{c}") for c in classes],
    )
    sums = chosen.groupBy(*run, uid).agg(
        F.max("y").alias("y"),
        F.array(*[F.sum(f"_p{c}") / F.lit(float(k)) for c in classes]).alias("_uniform"),
        F.array(*[F.sum(F.col("_w") * F.col(f"_p{c}")) / F.sum("_w") for c in classes]).alias("_weighted"),
        F.array(*[F.count_if(F.col("_vote") == c).cast("double") for c in classes]).alias("_votes"),
    )
    scores = _pick(rule, F.col("_uniform"), F.col("_weighted"), F.col("_votes"), k)
    return sums.select(*run, uid, "y", _rounded(scores).alias("probs"))


def _cell(member: int, cls: int) -> str:
    return f"p{member}_{cls}"


def member_matrix(
    predictions: DataFrame, members: Sequence[str], n_classes: int, run: Sequence[str],
    system: str = "system", uid: str = "uid",
) -> DataFrame:
    """One row per text key: ``run``, uid, y and a column per member and class (``p0_0`` ...)."""
    return (
        predictions.filter(F.col(system).isin(*members))
        .groupBy(*run, uid)
        .agg(
            F.max("y").alias("y"),
            *[
                F.max(F.when(F.col(system) == m, F.get("probs", F.lit(c)).cast("double"))).alias(_cell(i, c))
                for i, m in enumerate(members) for c in range(n_classes)
            ],
        )
    )


def subsets(members: Sequence[str], size: int) -> list[tuple[str, ...]]:
    """All member subsets in listing order; the number of systems is small and fixed."""
    return list(combinations(members, size))


def candidate_cells(
    matrix: DataFrame,
    members: Sequence[str],
    candidates: Sequence[tuple[tuple[str, ...], str]],
    weights: Column,
    n_classes: int,
    run: Sequence[str],
) -> DataFrame:
    """Confusion cells of every (member subset, rule) candidate.

    Candidates are data, not plan: each Arrow batch of the member matrix is scored for all of
    them with array arithmetic and leaves the task as confusion cells, so hundreds of subsets
    cost neither plan size nor shuffle.  ``weights`` is an array in member order (a scalar
    subquery over the validation scores).  A text some member lacks stops the job.
    """
    place = {m: i for i, m in enumerate(members)}
    todo = [([place[m] for m in subset], rule) for subset, rule in candidates]
    if unknown := {rule for _, rule in todo} - set(RULES):
        raise ValueError(f"unknown ensemble rule: {', '.join(sorted(unknown))}")
    m = len(members)
    score_columns = [_cell(i, c) for i in range(m) for c in range(n_classes)]
    weight_columns = [f"w{i}" for i in range(m)]
    keys = list(run)
    types = dict(matrix.select(*keys).dtypes)
    schema = ", ".join(["candidate int", *[f"{k} {types[k]}" for k in keys], "y int", "pred int", "n long"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            probs = batch[score_columns].to_numpy().reshape(len(batch), m, n_classes)
            if np.isnan(probs).any():
                raise ValueError("members do not cover the same texts")
            w = batch[weight_columns].iloc[0].to_numpy()
            run_of, runs = pd.factorize(pd.MultiIndex.from_frame(batch[keys]))
            base = (run_of * n_classes + batch["y"].to_numpy()) * n_classes
            for i, (subset, rule) in enumerate(todo):
                pred = np.round(subset_scores(probs[:, subset], w[subset], rule), DIGITS).argmax(axis=1)
                counts = np.bincount(base + pred, minlength=len(runs) * n_classes * n_classes)
                hit = np.flatnonzero(counts)
                cells = pd.DataFrame([runs[h // n_classes**2] for h in hit], columns=keys)
                cells.insert(0, "candidate", i)
                yield cells.assign(y=hit // n_classes % n_classes, pred=hit % n_classes, n=counts[hit])

    weighed = matrix.withColumn("_w", weights).select(
        *keys, "y", *score_columns, *[F.get("_w", F.lit(i)).alias(f"w{i}") for i in range(m)]
    )
    return weighed.mapInPandas(score, schema).groupBy("candidate", *keys, "y", "pred").agg(
        F.sum("n").alias("n")
    )


def subset_scores(probs: np.ndarray, weights: np.ndarray, rule: str) -> np.ndarray:
    """Class scores (texts x classes) of one subset; ``probs`` is texts x members x classes.

    Every rule is a weighted sum over members, of their scores or of their ballots.
    """
    even = np.full(probs.shape[1], 1.0 / probs.shape[1])

    def blend(values: np.ndarray, share: np.ndarray) -> np.ndarray:
        return np.tensordot(values, share, axes=(1, 0))

    if rule != "hard_majority":
        return blend(probs, even if rule == "uniform_prob_mean" else weights / np.sum(weights))
    ballots = np.eye(probs.shape[2])[np.argmax(probs, axis=2)]
    scores = blend(ballots, even)
    ranked = np.sort(np.sum(ballots, axis=1), axis=1)
    undecided = ranked[:, -1] == ranked[:, -2] if ranked.shape[1] > 1 else np.zeros(len(ranked), dtype=bool)
    scores[undecided] = blend(probs[undecided], even)
    return scores


def as_system(combined: DataFrame, name: str, system: str = "system") -> DataFrame:
    """Combined predictions as rows of a further system."""
    return combined.withColumn(system, F.lit(name))


def alias_system(predictions: DataFrame, source: str, name: str, system: str = "system") -> DataFrame:
    """A system that shares another one's predictions (same teacher, same training)."""
    return predictions.filter(F.col(system) == source).withColumn(system, F.lit(name))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
