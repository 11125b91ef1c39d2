"""Renames, casts, flags and unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.text import column


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by mapping; other columns pass through. Two columns may not end up with one name."""
    targets = [mapping.get(c, c) for c in df.columns]
    double = sorted({t for t in targets if sum(t.lower() == u.lower() for u in targets) > 1})
    if double:
        raise ValueError(f"several columns would be named {double}; drop or rename one of them first")
    return df.toDF(*targets)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; a value that does not fit becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def normalise_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower-case text columns."""
    return df.withColumns({c: F.lower(c) for c in columns})


def reciprocal(c: str | Column) -> Column:
    """``1 / c``, null at 0."""
    return F.try_divide(F.lit(1.0), column(c).cast("double"))


def flag(c: str | Column) -> Column:
    """1 where there is a value, else 0."""
    return column(c).isNotNull().cast("int")


def parse_flag(c: str | Column, true: str = "true", false: str = "false") -> Column:
    """1 for the text ``true``, 0 for ``false``, null for anything else."""
    return F.when(column(c) == true, 1).when(column(c) == false, 0)


def equals(c: str | Column, value) -> Column:
    """Comparison that treats text which is not a number as different from a number, instead of failing."""
    c = column(c)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return c == F.lit(value)
    return c.try_cast("long" if isinstance(value, int) else "double") == F.lit(value)


def null_if(c: str | Column, value) -> Column:
    """Null where the column equals a stand-in value."""
    return F.when(F.coalesce(equals(c, value), F.lit(False)), None).otherwise(column(c))


def fill_null(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill nulls per column. A value that does not fit the column's type is an error, not skipped."""
    types = dict(df.dtypes)
    for c, value in values.items():
        is_text, is_number = types[c] == "string", not isinstance(value, str)
        if is_text == is_number:
            raise TypeError(f"cannot fill {c} ({types[c]}) with {value!r}; cast the column first")
    return df.withColumns({c: F.coalesce(c, F.lit(v).cast(types[c])) for c, v in values.items()})


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column that one table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
