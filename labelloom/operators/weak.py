"""Weak supervision: rule analysis, majority vote, inverse-coverage weighted vote.

Input everywhere is a table with a ``votes`` array (one tinyint per rule, -1 = abstain).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import let
from labelloom.operators.rules import ABSTAIN

COVERAGE_SMOOTHING = 0.005  # fixed value
LOW_CONFIDENCE, HIGH_CONFIDENCE, MEDIUM_SHARE = 0.6, 0.8, 0.25  # fixed values


# ------------------------------------------------------------------------------- analysis
def vote_patterns(votes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct vote vectors with their number of texts.

    The rules produce few distinct vectors, so this one map-side-combined aggregate is all
    that the analyses below ever shuffle of the corpus.
    """
    return votes.groupBy(*by, "votes").agg(F.count(F.lit(1)).alias("n"))


def rule_analysis(votes: DataFrame, names: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Per rule: texts labelled, coverage in percent, votes per class."""
    per_rule = (
        vote_patterns(votes)
        .select("n", F.posexplode_outer("votes").alias("rule", "vote"))
        .groupBy("rule")
        .agg(
            F.sum("n").alias("n_texts"),
            F.sum(F.when(F.col("vote") != ABSTAIN, F.col("n")).otherwise(0)).alias("labeled"),
            *[
                F.sum(F.when(F.col("vote") == i, F.col("n")).otherwise(0)).alias(f"n_{c.lower()}")
                for i, c in enumerate(classes)
            ],
        )
    )
    return per_rule.select(
        "rule",
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("rule") + 1).alias("rule_name"),
        "labeled",
        (F.lit(100.0) * F.col("labeled") / F.col("n_texts")).alias("coverage"),
        *[f"n_{c.lower()}" for c in classes],
    )


def matrix_summary(votes: DataFrame) -> DataFrame:
    """Texts with at least one vote, with none, and with conflicting votes."""
    cast = F.array_distinct(F.filter("votes", lambda v: v != ABSTAIN))
    n = F.col("n")
    return (
        vote_patterns(votes)
        .select("n", F.size(cast).alias("kinds"))
        .agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("n_texts"),
            F.coalesce(F.sum(F.when(F.col("kinds") > 0, n)), F.lit(0)).alias("any_vote"),
            F.coalesce(F.sum(F.when(F.col("kinds") == 0, n)), F.lit(0)).alias("no_vote"),
            F.coalesce(F.sum(F.when(F.col("kinds") > 1, n)), F.lit(0)).alias("conflicts"),
        )
    )


# --------------------------------------------------------------------------------- voting
def _is_class(code: int) -> Callable[[Column], Column]:
    return lambda vote: vote == code


def majority_vote(votes: DataFrame, n_classes: int, default: int) -> DataFrame:
    """Most frequent class among the votes cast, with its share as confidence.

    A tie goes to the class whose first vote comes earliest in rule order; a text without
    votes gets ``default`` with confidence 0.
    """
    cast = F.filter("votes", lambda v: v != ABSTAIN)
    counts = F.array(*[F.size(F.filter("votes", _is_class(c))) for c in range(n_classes)])
    tallied = votes.select("*", cast.alias("_cast"), counts.alias("_counts"))
    best = F.array_max("_counts")
    leaders = let(
        best,
        lambda top: F.filter(
            "_cast", lambda v: F.element_at(F.col("_counts"), v.cast("int") + 1) == top
        ),
    )
    return tallied.select(
        *votes.columns,
        F.coalesce(F.get(leaders, F.lit(0)).cast("int"), F.lit(default)).alias("mv_label"),
        F.when(F.size("_cast") > 0, best / F.size("_cast")).otherwise(0.0).alias("mv_conf"),
    )


def rule_weights(votes: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per rule: w_j = 1 / (coverage_j + 0.005), scaled so that the weights sum to m.

    Fit on a partition by filtering ``votes`` first.
    """
    return _weights_row(votes, len(names)).select(
        F.posexplode(
            F.arrays_zip(
                F.array(*[F.lit(n) for n in names]).alias("rule_name"), F.col("labeled"),
                F.col("coverage"), F.col("weights").alias("weight"),
            )
        ).alias("rule", "r")
    ).select("rule", "r.rule_name", "r.labeled", "r.coverage", "r.weight")


def _weights_row(votes: DataFrame, m: int) -> DataFrame:
    """The same weights as arrays in rule order, in a single row."""
    patterns = vote_patterns(votes)
    cast = [
        F.sum(F.when(F.get("votes", F.lit(j)) != ABSTAIN, F.col("n")).otherwise(0))
        for j in range(m)
    ]
    counted = patterns.agg(F.sum("n").alias("n"), F.array(*cast).alias("labeled"))
    covered = counted.withColumn("coverage", F.transform("labeled", lambda k: k / F.col("n")))
    inverse = covered.withColumn(
        "_inv", F.transform("coverage", lambda c: F.lit(1.0) / (c + F.lit(COVERAGE_SMOOTHING)))
    ).withColumn("_sum", F.aggregate("_inv", F.lit(0.0), lambda acc, w: acc + w))
    return inverse.select(
        "labeled",
        "coverage",
        F.transform("_inv", lambda w: w / F.col("_sum") * F.lit(float(m))).alias("weights"),
    )


def weight_array(votes: DataFrame, m: int) -> Column:
    """Weights as a scalar subquery: m numbers, evaluated once, inlined in every task."""
    return _weights_row(votes, m).select("weights").scalar()


def weighted_vote(
    votes: DataFrame, weights: Column, n_classes: int, default: int, prefix: str = "wv"
) -> DataFrame:
    """Class with the largest sum of weights of its voting rules (summed in rule order).

    Confidence is its share of the total.  A tie goes to the lower class code; a text without
    votes gets ``default``, confidence 0 and ``<prefix>_novote`` = 1.
    """
    def weight_of(counts_vote: Callable[[Column], Column]) -> Column:
        parts = F.zip_with(
            "votes", "_w", lambda v, w: F.when(counts_vote(v), w).otherwise(F.lit(0.0))
        )
        return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)

    weighed = votes.withColumn("_w", weights)
    scored = weighed.select(
        "*",
        F.array(*[weight_of(_is_class(c)) for c in range(n_classes)]).alias("_scores"),
        weight_of(lambda v: v != ABSTAIN).alias("_total"),
    )
    voted = F.col("_total") > 0
    top = F.array_max("_scores")
    return scored.select(
        *votes.columns,
        F.when(voted, F.array_position("_scores", top).cast("int") - 1)
        .otherwise(F.lit(default))
        .alias(f"{prefix}_label"),
        F.when(voted, top / F.col("_total")).otherwise(0.0).alias(f"{prefix}_conf"),
        F.when(voted, 0).otherwise(1).alias(f"{prefix}_novote"),
    )


def fit_and_vote(
    votes: DataFrame, names: Sequence[str], n_classes: int, default: int,
    fit_on: Column | None = None, prefix: str = "wv",
) -> DataFrame:
    """Weighted vote of all rows with weights fitted on ``fit_on`` (all rows when None)."""
    base = votes if fit_on is None else votes.filter(fit_on)
    return weighted_vote(votes, weight_array(base, len(names)), n_classes, default, prefix)


def weight_drift(fitted: DataFrame, full: DataFrame) -> DataFrame:
    """Largest relative difference between two weight tables."""
    a = fitted.select("rule", F.col("weight").alias("a"))
    b = full.select("rule", F.col("weight").alias("b"))
    return a.join(b, "rule").agg(
        F.count(F.lit(1)).alias("n_rules"),
        F.max(F.abs(F.col("a") - F.col("b")) / F.col("b")).alias("max_abs_rel_diff"),
    )


# -------------------------------------------------------------------------------- reports
def label_distribution(
    labelled: DataFrame, methods: dict[str, tuple[str, str]], classes: Sequence[str]
) -> DataFrame:
    """Texts and mean confidence per method and class; absent classes appear with 0.

    ``methods``: name -> (label column, confidence column).
    """
    grid = F.array(*[F.struct(F.lit(i).alias("label"), F.lit(c).alias("label_name"))
                     for i, c in enumerate(classes)])
    sums = labelled.agg(
        F.count(F.lit(1)).alias("n_texts"),
        *[
            F.array(*[
                F.struct(
                    F.count_if(F.col(lab) == i).alias("n"),
                    F.avg(F.when(F.col(lab) == i, F.col(conf))).alias("mean_conf"),
                )
                for i in range(len(classes))
            ]).alias(method)
            for method, (lab, conf) in methods.items()
        ],
    )
    rows = sums.select(
        "n_texts",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("method"), F.arrays_zip(grid.alias("c"), F.col(m).alias("s")).alias("z"))
            for m in methods
        ])).alias("m"),
    ).select("n_texts", "m.method", F.explode("m.z").alias("z"))
    return rows.select(
        "method", "z.c.label", "z.c.label_name", "z.s.n",
        F.when(F.col("n_texts") > 0, F.lit(100.0) * F.col("z.s.n") / F.col("n_texts")).alias("pct"),
        F.coalesce("z.s.mean_conf", F.lit(0.0)).alias("mean_conf"),
    )


def agreement(labelled: DataFrame, a: str, b: str) -> DataFrame:
    """How often two label columns agree."""
    same = F.count_if(F.col(a) == F.col(b))
    return labelled.agg(
        F.count(F.lit(1)).alias("n"),
        same.alias("n_agree"),
        (same / F.count(F.lit(1))).alias("agreement"),
    )


def review_plan(labelled: DataFrame, conf: str) -> DataFrame:
    """Confidence buckets and the number of texts a human should read."""
    c = F.col(conf)
    low = F.count_if(c < LOW_CONFIDENCE)
    mid = F.count_if((c >= LOW_CONFIDENCE) & (c < HIGH_CONFIDENCE))
    return labelled.agg(
        F.count_if(c >= HIGH_CONFIDENCE).alias("high"),
        mid.alias("medium"),
        low.alias("low"),
        (low + F.floor(mid * F.lit(MEDIUM_SHARE))).cast("long").alias("effort"),
    )


def label_flips(df: DataFrame, split: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Changed labels per split and over all rows (split ``all``).

    ``pairs``: output column -> (old label column, new label column).
    """
    aggs = [F.count(F.lit(1)).alias("n")] + [
        F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias(name)
        for name, (old, new) in pairs.items()
    ]
    # One row per split first; the total is the sum of those few rows.
    per_split = df.groupBy(split).agg(*aggs)
    sums = [F.sum(c).alias(c) for c in ["n", *pairs]]
    return (
        per_split.rollup(split).agg(F.grouping(split).alias("_all"), *sums)
        .select(F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(split)).alias(split),
                "n", *pairs)
    )


def reproduction(labelled: DataFrame, recomputed: str, stored: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, and rows whose recomputed label equals the stored one; ``stored`` comes from elsewhere than the votes."""
    same = F.count_if(F.coalesce(F.col(recomputed) == F.col(stored), F.lit(False)))
    return labelled.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), same.alias("n_equal")).withColumn(
        "reproduced", F.col("n") == F.col("n_equal")
    )
