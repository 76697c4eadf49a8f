"""Labelling texts as they arrive, with rule weights frozen beforehand.

Normalisation, hashing, rules and both votes are projections, so the batch operators run
unchanged on a streaming DataFrame: no state, no watermark, and a restarted query repeats
exactly the rows its checkpoint asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import ARABIC, TextProfile, text_id
from labelloom.operators.lexicon import Lexicons
from labelloom.operators.rules import Rule, apply_rules
from labelloom.operators.weak import majority_vote, weighted_vote


def label_stream(
    texts: DataFrame, text: str, keep: Sequence[str], lexicons: Lexicons, rules: Sequence[Rule],
    weights: Sequence[float], n_classes: int, default: int, profile: TextProfile = ARABIC,
) -> DataFrame:
    """``keep`` columns, ``uid``, votes and both labels for each arriving text."""
    keyed = texts.withColumn("uid", text_id(text, profile))
    votes = apply_rules(keyed, text, lexicons, rules, [*keep, "uid"])
    frozen = F.array(*[F.lit(float(w)) for w in weights])
    return weighted_vote(majority_vote(votes, n_classes, default), frozen, n_classes, default)
