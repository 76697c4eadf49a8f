"""Lexicon predicates: which term lists occur in a text, and how many of their entries.

Lexicons are data of the user: a dict of term lists, or a table ``(lexicon, term)``.  Matching is
plain substring search on the raw text, without word boundaries, on the JVM and in one pass
per lexicon.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import word_count

#: Terms of each lexicon, as literals or as a column of arrays.
Lexicons = Mapping[str, "Sequence[str] | Column"]


def lexicons_from_table(table: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """The named lexicons of a ``(lexicon, term)`` table as scalar subqueries.

    The terms stay in the plan: no row reaches the driver.  Repeated entries are kept, since each
    counts; null terms are not entries.
    """
    def terms(name: str) -> Column:
        own = table.where((F.col("lexicon") == name) & F.col("term").isNotNull())
        return own.agg(F.array_sort(F.collect_list("term")).alias("terms")).scalar()

    return {name: terms(name) for name in names}


def _terms(terms: Sequence[str] | Column) -> Column:
    if isinstance(terms, Column):
        return terms
    return F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")


def contains_any(text: Column, terms: Sequence[str] | Column) -> Column:
    """True when at least one term is a substring; stops at the first hit."""
    return F.exists(_terms(terms), lambda t: F.contains(text, t))


def count_terms(text: Column, terms: Sequence[str] | Column) -> Column:
    """Number of list entries that occur (not of occurrences); overlapping entries all count."""
    return F.size(F.filter(_terms(terms), lambda t: F.contains(text, t)))


def flag(name: str) -> str:
    return f"has_{name}"


def count(name: str) -> str:
    return f"n_{name}"


def lexicon_signals(df: DataFrame, text: str, lexicons: Lexicons, counted: Collection[str] = ()) -> DataFrame:
    """Add one boolean per lexicon, entry counts for the ``counted`` ones and the word count.

    Every lexicon is searched once: where a count is wanted the flag is read off the count.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    columns = df.columns
    # Term arrays that are subqueries become columns first: lambdas take no subqueries.
    held = {n: F.col(f"_terms_{n}") if isinstance(terms, Column) else terms for n, terms in lexicons.items()}
    df = df.select("*", *[terms.alias(f"_terms_{n}") for n, terms in lexicons.items() if isinstance(terms, Column)])
    searched = df.select(
        *columns,
        *[
            count_terms(t, terms).alias(count(n))
            if n in counted
            else contains_any(t, terms).alias(flag(n))
            for n, terms in held.items()
        ],
        word_count(text).alias("word_count"),
    )
    return searched.select(
        "*", *[(F.col(count(n)) > 0).alias(flag(n)) for n in lexicons if n in counted]
    )
