"""Registered queries over the driver's tables, each with its SQL statement where SQL can say it."""

from catalogue import (  # noqa: F401
    consensus_queries,
    dedup_queries,
    evaluation_queries,
    explanation_queries,
    integrity_queries,
    model_queries,
    source_queries,
    split_queries,
    text_queries,
    weak_queries,
)
from catalogue.base import ORACLES, QUERIES  # noqa: F401
