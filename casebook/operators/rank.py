"""Ranks over a whole table without putting it in one task.

The distinct sort keys with their row counts are cut into ranges of nearly equal size; a running sum inside each
range plus the total of the ranges before it gives every rank. Equal rows are counted before the shuffle, so a value
that holds a third of the table is one row here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.operators.sizing import as_list, lookup_join, materialise, shuffle_partitions

RANGES_PER_PARTITION = 4


def range_buckets(distinct: DataFrame, keys: Sequence[str], name: str = "_bucket") -> DataFrame:
    """Add a range number that grows with ``keys``. ``distinct`` has one row per value of the keys.

    Spark's range partitioning picks the bounds from a sample of each range's worth of keys, so there are as many ranges
    as the session's shuffle partitions ask for and no list of bounds meets every row. The result is written once: all
    later steps read the same range numbers, also after a lost executor. Some ranges may be empty.
    """
    n_ranges = RANGES_PER_PARTITION * shuffle_partitions(distinct)
    return materialise(distinct.repartitionByRange(n_ranges, *keys).withColumn(name, F.spark_partition_id()))


def with_range_value(ranged: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Add, as a struct, the row of ``values`` that belongs to each row's range; null where there is none.

    ``values`` has at most one row per range. The join is on the range number, by which the rows are dealt out for the
    windows inside a range as well.
    """
    value = F.struct(*[c for c in values.columns if c != "_bucket"]).alias(name)
    return ranged.join(values.select("_bucket", value), "_bucket", "left")


def rank_distinct(distinct: DataFrame, keys: Sequence[str], weight: str, sums: Sequence[str] = ()) -> DataFrame:
    """Add ``before`` (rows with lower keys) and ``total`` to a table with one row per key value.

    Each column of ``sums`` also gets ``total_<name>``, its sum over the table.
    """
    keys = list(keys)
    ranged = range_buckets(distinct, keys)
    # One row per range in the windows without partitions.
    per_range = ranged.groupBy("_bucket").agg(F.sum(weight).alias("_n"), *[F.sum(c).alias(c) for c in sums])
    everything = Window.partitionBy()
    offsets = per_range.select(
        "_bucket",
        (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(everything).alias("total"),
        *[F.sum(c).over(everything).alias(f"total_{c}") for c in sums],
    )
    inside = Window.partitionBy("_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_range._offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return with_range_value(ranged, offsets, "_range").select(
        *distinct.columns,
        *[F.col(f"_range.{c}").alias(c) for c in offsets.columns if c.startswith("total")],
        before.alias("before"),
    )


def rank_table(df: DataFrame, keys: str | Sequence[str], **sums: str) -> DataFrame:
    """One row per distinct key value: ``cnt`` rows, ``before`` lower rows, ``total`` rows.

    ``sums`` names further columns to add up per key value and, as ``total_<name>``, over the table.
    """
    keys = as_list(keys)
    added = [F.sum(c).alias(name) for name, c in sums.items()]
    return rank_distinct(df.groupBy(*keys).agg(F.count("*").alias("cnt"), *added), keys, "cnt", list(sums))


def percent_rank(before: Column | None = None, total: Column | None = None) -> Column:
    """``before / (n - 1)``, 0 for a single row."""
    before = F.col("before") if before is None else before
    total = F.col("total") if total is None else total
    return F.when(total == 1, F.lit(0.0)).otherwise(before / (total - 1))


def average_rank() -> Column:
    """Mean of the positions that equal rows share."""
    return F.col("before") + (F.col("cnt") + 1) / 2


def global_rank(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Add ``rank``, ``average_rank`` and ``percent_rank`` over the whole table, ascending, nulls first.

    For descending numbers rank a negated column.
    """
    keys = as_list(keys)
    table = rank_table(df, keys).select(
        *keys,
        (F.col("before") + 1).alias("rank"),
        average_rank().alias("average_rank"),
        percent_rank().alias("percent_rank"),
    )
    return lookup_join(df, table, keys, "left", null_safe=True)
