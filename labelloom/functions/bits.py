"""Sets of small numbers as long columns, ``WIDTH`` numbers a column, so that a set of any size is hash-aggregated by ``bit_or``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 60


def n_words(size: int) -> int:
    """Columns that hold the numbers below ``size``."""
    return max(1, -(-size // WIDTH))


def place(value: Column, names: Sequence[str]) -> Column:
    """0-based place of a value among the names; -1 where it is none of them."""
    return F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), value).cast("int"), F.lit(0)) - 1


def words(number: Column, size: int, where: Column | None = None) -> list[Column]:
    """The set of one number as columns; the empty set for a negative number or where ``where`` does not hold."""
    there = number >= 0 if where is None else (number >= 0) & where
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(WIDTH)).cast("int"))
    return [F.when(there & (F.floor(number / WIDTH) == w), one).otherwise(F.lit(0).cast("long")) for w in range(n_words(size))]


def names(prefix: str, size: int) -> list[str]:
    return [f"{prefix}{w}" for w in range(n_words(size))]


def has(prefix: str, number: int) -> Column:
    """Whether the set in the columns ``prefix``0, ``prefix``1, ... holds a number."""
    return F.col(f"{prefix}{number // WIDTH}").bitwiseAND(F.lit(1 << number % WIDTH)) != 0


def members(prefix: str, size: int) -> Column:
    """The numbers of a set, ascending."""
    held = F.array(*[F.col(n) for n in names(prefix, size)])
    return F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.getbit(
        F.get(held, F.floor(i / WIDTH).cast("int")), F.pmod(i, F.lit(WIDTH))) == 1)


def pairs(numbers: Column, group: int | None = None) -> Column:
    """All ``(i, j)`` with i before j of an array of numbers; with ``group`` only those in one block of that many numbers."""
    def near(i: Column, j: Column) -> Column:
        return (j > i) if group is None else (j > i) & (F.floor(i / group) == F.floor(j / group))

    return F.flatten(F.transform(numbers, lambda i: F.transform(
        F.filter(numbers, lambda j: near(i, j)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
