"""Table profiles in long form, each from one aggregation over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _name_table(df: DataFrame, table_name: str | None) -> DataFrame:
    return df if table_name is None else df.withColumn("table_name", F.lit(table_name))


def melt(df: DataFrame, value_vars: Sequence[str], id_vars: Sequence[str] = (), var_name: str = "variable",
         value_name: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def null_summary(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
                 table_name: str | None = None) -> DataFrame:
    """Per group and column: rows in the group, nulls, and the share of nulls."""
    columns = columns or [c for c in df.columns if c not in by]
    counts = df.groupBy(*by).agg(
        F.count("*").alias("count_in_group"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    long = melt(counts, columns, [*by, "count_in_group"], "column", "null_count")
    share = F.try_divide(F.col("null_count"), F.col("count_in_group"))
    return _name_table(long.withColumn("percent_of_group_null", share), table_name)


def distribution(df: DataFrame, by: Sequence[str], numeric_column: str | None = None,
                 include_count: bool = True) -> DataFrame:
    """Per group: row count, share of rows, sum of a column, share of its total.

    The totals come from the grouped rows as one scalar subquery, so the table is read once and nothing runs early.
    """
    aggregates = {"count": F.count("*")} if include_count else {}
    if numeric_column is not None:
        aggregates[f"sum_{numeric_column}"] = F.sum(numeric_column)
    groups = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()])
    totals = groups.agg(F.struct(*[F.sum(n).alias(n) for n in aggregates])).scalar()
    groups = groups.withColumn("_totals", totals)
    share_names = {"count": "count_percentage", f"sum_{numeric_column}": f"{numeric_column}_percentage"}
    shares = {share_names[n]: F.try_divide(F.col(n), F.col(f"_totals.{n}")) for n in aggregates}
    return groups.withColumns(shares).drop("_totals")


def long_distribution(df: DataFrame, categorical: str, numeric_column: str | None = None, include_count: bool = True,
                      table_name: str | None = None) -> DataFrame:
    """:func:`distribution` of one column with a row per value and statistic."""
    wide = distribution(df, [categorical], numeric_column, include_count)
    wide = wide.withColumn(categorical, F.col(categorical).cast("string"))
    statistics = [c for c in wide.columns if c != categorical]
    wide = wide.withColumns({c: F.col(c).cast("double") for c in statistics})
    long = melt(wide, statistics, [categorical], "statistic", "statistic_value")
    long = long.withColumnRenamed(categorical, "categorical_value").withColumn("categorical", F.lit(categorical))
    return _name_table(long, table_name)


def unique_summary(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
                   include_percent: bool = False, approx: bool = False, table_name: str | None = None) -> DataFrame:
    """Per group and column: distinct values and, with ``include_percent``, distinct over non-null.

    Exact counts of many columns multiply the rows in the shuffle; ``approx`` keeps a fixed-size sketch per group.
    """
    columns = columns or [c for c in df.columns if c not in by]
    count = F.approx_count_distinct if approx else F.count_distinct
    names = [f"count_unique_{c}" for c in columns]
    groups = df.groupBy(*by).agg(
        *[count(c).cast("double").alias(f"count_unique_{c}") for c in columns],
        *[F.count(c).alias(f"_filled_{c}") for c in columns],
    )
    if include_percent:
        share = {f"percent_unique_{c}": F.try_divide(F.col(f"count_unique_{c}"), F.col(f"_filled_{c}"))
                 for c in columns}
        groups = groups.withColumns(share)
        names += list(share)
    long = melt(groups, names, by, "column", "unique_count")
    kind = F.when(F.col("column").startswith("percent_unique_"), "percent").otherwise("count")
    return _name_table(long.withColumn("type", kind), table_name)


def numeric_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                    table_name: str | None = None) -> DataFrame:
    """Per group: min, average, stddev, max, sum and count of each column, named ``<statistic>_<column>``."""
    statistics = {"min": F.min, "average": F.avg, "stddev": F.stddev, "max": F.max, "sum": F.sum, "count": F.count}
    aggregates = {f"{s}_{c}": f(c).cast("double") for s, f in statistics.items() for c in columns}
    groups = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return _name_table(melt(groups, list(aggregates), by, "statistic", "statistic_value"), table_name)


def value_counts(df: DataFrame, by: Sequence[str], name: str = "count") -> DataFrame:
    """Rows per group."""
    return df.groupBy(*by).agg(F.count("*").alias(name))


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """First k rows in an order; every task keeps k rows and no full sort runs."""
    return df.orderBy(*order).limit(k)


def percentiles(df: DataFrame, columns: Sequence[str], ps: Sequence[float], by: Sequence[str] = (),
                accuracy: int = 10_000) -> DataFrame:
    """Approximate percentiles from a mergeable sketch, one row per group, column and percentile."""
    sketches = [F.percentile_approx(c, list(ps), accuracy).alias(c) for c in columns]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("percentile"),
                 F.col(c)[i].cast("double").alias("value"))
        for c in columns for i, p in enumerate(ps)
    ])
    return df.groupBy(*by).agg(*sketches).select(*by, F.inline(rows))


def global_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each column over the whole table, in one row."""
    return df.agg(*[F.avg(c).alias(f"average_{c}") for c in columns])


def key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and repeated rows. Null keys count as one key."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    counts = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))
    return counts.withColumn("n_repeats", F.col("n_rows") - F.col("n_keys"))
