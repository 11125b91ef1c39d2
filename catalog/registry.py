"""Registration and small helpers shared by the queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that must give the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int | Mapping[str, int] = 6) -> DataFrame:
    """Round every double, so that the order of a sum does not show."""
    def to(c):
        return digits if isinstance(digits, int) else digits.get(c, 6)

    return df.withColumns({c: F.round(c, to(c)) for c, t in df.dtypes if t == "double"})


def with_(*ctes: str, select: str) -> str:
    """A statement from ``name AS (...)`` parts; a part that is needed twice is kept once."""
    return "WITH " + ",\n".join(dict.fromkeys(ctes)) + "\n" + select
