"""Several annotators per text: majority, tie-breaker, label coarsening, table checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL, MAJORITY, TIEBREAK = "full_agreement", "majority_vote", "gpt_tiebreaker"  # fixed values


def resolve(annotators: Sequence[str], tie_breaker: str) -> tuple[Column, Column]:
    """(label, method) of three annotators: all agree, two agree, or the tie-breaker decides."""
    a, b, c = (F.col(x) for x in annotators)
    label = F.when((a == b) | (a == c), a).when(b == c, b).otherwise(F.col(tie_breaker))
    method = (
        F.when((a == b) & (b == c), F.lit(FULL))
        .when((a == b) | (a == c) | (b == c), F.lit(MAJORITY))
        .otherwise(F.lit(TIEBREAK))
    )
    return label, method


def consensus(
    df: DataFrame, annotators: Sequence[str], tie_breaker: str,
    label: str = "final_label", method: str = "method",
) -> DataFrame:
    resolved, how = resolve(annotators, tie_breaker)
    return df.select("*", resolved.alias(label), how.alias(method))


def coarsen(label: Column | str, mapping: Mapping[str, str], otherwise: str) -> Column:
    """Map fine labels to coarse ones; labels outside ``mapping`` become ``otherwise``."""
    c = F.col(label) if isinstance(label, str) else label
    out = None
    for coarse in dict.fromkeys(mapping.values()):
        fine = [f for f, t in mapping.items() if t == coarse]
        hit = c.isin(*fine)
        out = F.when(hit, coarse) if out is None else out.when(hit, coarse)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def table_checks(
    tables: Mapping[str, DataFrame],
    row_id: str,
    checks: Mapping[str, Column],
    report_only: Sequence[str] = (),
) -> DataFrame:
    """Row-aligned tables must agree.

    Every table is prefixed with its name (``name_column``) and joined on ``row_id``; each
    check is a boolean over the joined row.  One output row per check with the number of rows
    that satisfy it; ``ok`` demands all of them, except for ``report_only`` checks.  Give texts as
    hashes: every column travels through the joins.
    A row that is missing from one of the tables fails the checks that look at it.
    """
    joined = None
    for name, df in tables.items():
        t = df.select(
            F.col(row_id), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != row_id]
        )
        joined = t if joined is None else joined.join(t, row_id, "full")
    counted = joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[
            F.struct(F.lit(k).alias("check"), F.count_if(F.coalesce(c, F.lit(False))).alias("n_ok"),
                     F.lit(k in report_only).alias("free"))
            for k, c in checks.items()
        ]).alias("r"),
    )
    return counted.select("n", F.explode("r").alias("r")).select(
        "r.check", "n", "r.n_ok", (F.col("r.free") | (F.col("r.n_ok") == F.col("n"))).alias("ok")
    )
