"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: str | Column) -> Column:
    """The space-separated terms of a text; null for a null text."""
    return F.split(column(c), " ")


def word_count(c: str | Column) -> Column:
    """Number of space-separated terms; null for a null text."""
    return F.size(words(c))


def unique_word_count(c: str | Column) -> Column:
    """Number of different space-separated terms; null for a null text."""
    return F.size(F.array_distinct(words(c)))


def leading_digit(c: str | Column) -> Column:
    """First character as a number, null when it is not a digit."""
    return F.substring(column(c), 1, 1).try_cast("int")
