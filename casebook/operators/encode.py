"""Categorical encoders.

Every encoder builds a table with one row per category from partial counts, and looks the rows up in it. The table is
broadcast only after its size was checked (``small``; by default a job finds out); a large one is joined with its hot
categories salted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.operators.clean import equals
from casebook.operators.rank import rank_distinct
from casebook.operators.sizing import (BROADCAST_BYTES, BROADCAST_ROWS, hot_hashes, lookup_join, materialise,
                                       small_columns)


def _is_small(df: DataFrame, c: str, small: bool | None) -> bool:
    return small_columns(df, [c]).get(c, True) if small is None else small


def label_table(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """Codes by falling frequency, 1 first; equal frequencies by value. Nulls get no code."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg((-F.count("*")).alias("_rarity"))
    ranked = rank_distinct(counts.withColumn("_one", F.lit(1)), ["_rarity", c], "_one")
    return ranked.select(c, (F.col("before") + 1).alias(name or f"label_encoded_{c}"))


def label_encode(df: DataFrame, c: str, name: str | None = None, small: bool | None = None) -> DataFrame:
    """Add ``label_encoded_<c>``."""
    return lookup_join(df, label_table(df, c, name), c, "left", small=_is_small(df, c, small))


def one_hot(df: DataFrame, c: str, values: Sequence) -> DataFrame:
    """Add one 0/1 column per listed value in a single projection; null gives 0."""
    return df.withColumns({one_hot_name(c, v): F.when(F.col(c) == F.lit(v), 1).otherwise(0) for v in values})


def one_hot_name(c: str, value) -> str:
    return f"one_hot_encoded_{c}_is_{value}"


def target_table(df: DataFrame, c: str, y: str, name: str | None = None) -> DataFrame:
    """Mean response per category."""
    return df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.avg(y).alias(name or f"mean_response_rate_{c}"))


def target_encode(df: DataFrame, c: str, y: str, fold_col: str | None = None, name: str | None = None,
                  small: bool | None = None) -> DataFrame:
    """Add the mean response of the row's category; null stays null.

    With ``fold_col`` a row sees only the other folds, so its own response cannot leak in; a category that occurs in
    one fold only gives null. A table of means by category and fold is broadcast only where the caller says ``small``,
    as its size is not that of the categories alone.
    """
    name = name or f"mean_response_rate_{c}"
    if fold_col is None:
        return lookup_join(df, target_table(df, c, y, name), c, "left", small=_is_small(df, c, small))
    small = bool(small)
    folds = (
        df.filter(F.col(c).isNotNull()).groupBy(c, fold_col)
        .agg(F.sum(y).alias("_sum"), F.count(y).alias("_n"))
    )
    # one row per category and fold by now
    whole = Window.partitionBy(c)
    others = F.try_divide(F.sum("_sum").over(whole) - F.coalesce("_sum", F.lit(0)), F.sum("_n").over(whole) - F.col("_n"))
    return lookup_join(df, folds.select(c, fold_col, others.alias(name)), [c, fold_col], "left", small=small)


def membership_flags(df: DataFrame, positives: DataFrame, columns: Sequence[str], prefix: str = "is_in_escalated_",
                     small: dict[str, bool] | None = None) -> DataFrame:
    """Per column, 1 when the value occurs among ``positives``, else 0."""
    small = small_columns(positives, columns) if small is None else small
    rows = df
    for c in columns:
        seen = positives.select(c).filter(F.col(c).isNotNull()).distinct().withColumn("_seen", F.lit(1))
        is_small = small.get(c, True)
        df = lookup_join(df, seen, c, "left", {} if is_small else hot_hashes(rows, c), is_small)
        df = df.withColumn(f"{prefix}{c}", F.coalesce("_seen", F.lit(0))).drop("_seen")
    return df


def sentinel_flags(df: DataFrame, columns: Sequence[str], value, prefix: str | None = None) -> DataFrame:
    """Per column, 1 when it holds a stand-in value, else 0."""
    prefix = f"is_dummy_{value}_" if prefix is None else prefix
    return df.withColumns({f"{prefix}{c}": sentinel_flag(c, value) for c in columns})


def sentinel_flag(c: str | Column, value) -> Column:
    return F.when(equals(c, value), 1).otherwise(0)


# ---- several encodings of several columns

LABEL, MEAN, MEMBER = "label_encoded_", "mean_response_rate_", "is_in_escalated_"


def label_tables(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Rows ``(column, value, code)``: the codes of :func:`label_table` for many columns from one ranking.

    Values are text, and so is the order of equal frequencies.
    """
    texts = df.select(*[c.cast("string").alias(name) for name, c in columns.items()])
    long = texts.unpivot([], list(columns), "column", "value").filter(F.col("value").isNotNull())
    return _ranked(long.groupBy("column", "value").agg((-F.count("*")).alias("_rarity"))).select("column", "value", "code")


def _ranked(statistics: DataFrame) -> DataFrame:
    """Add ``code``, the place of a value in its column by ``_rarity`` and value."""
    keys = ["column", "_rarity", "value"]
    ranked = rank_distinct(statistics.withColumn("_one", F.lit(1)), keys, "_one").drop("_one", "total")
    # one row per column
    starts = statistics.groupBy("column").agg(F.count("*").alias("_values")).select(
        "column", (F.sum("_values").over(Window.orderBy("column")) - F.col("_values")).alias("_start"))
    return ranked.join(F.broadcast(starts), "column").withColumn("code", F.col("before") - F.col("_start") + 1).drop(
        "before", "_start")


def encode_packed(df: DataFrame, key: str, y: str, labels: Mapping[str, str] = {}, means: Mapping[str, str] = {},
                  members: Mapping[str, str] = {}, fold: str | None = None) -> DataFrame:
    """Label codes, mean responses and membership flags (a value seen with ``y > 0``) of many columns.

    ``df`` has one row per ``key`` and is read three times: write it first. The mappings name columns and what the
    encodings are called after their prefix. One dictionary with a row per column and value holds everything; the
    values of all columns, one under the other, are looked up in it by a single join and gathered by key. Equal to the
    single encoders above except that label ties are ordered by the value as text.

    With ``fold``, a row sees responses of other folds only, in its means and its flags, so its own cannot leak in;
    rows with a null ``fold`` see those of all. Null responses never count.
    """
    columns = list(dict.fromkeys([*labels, *means, *members]))
    if not columns:
        return df
    own = F.col(fold) if fold else F.lit(None).cast("int")
    texts = df.select(F.col(key).alias("_key"), F.col(y).cast("double").alias("_y"), own.alias("_fold"),
                      *[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot(["_key", "_y", "_fold"], columns, "column", "value").filter(F.col("value").isNotNull())
    by_fold = long.groupBy("column", "value", "_fold").agg(
        F.count("*").alias("n"), F.count("_y").alias("seen"), F.sum("_y").alias("sum"), F.count_if(F.col("_y") > 0).alias("up"))
    # as many entries as there are folds
    parts = F.collect_list(F.struct("_fold", "seen", "sum", "up")).alias("_parts")
    statistics = materialise(by_fold.groupBy("column", "value").agg((-F.sum("n")).alias("_rarity"), parts))

    def seen_from(own: Column) -> Column:
        """Mean and flag in the other folds; in all of them where ``own`` is null."""
        others = F.filter("_parts", lambda p: own.isNull() | ~p["_fold"].eqNullSafe(own))

        def total(name: str, zero) -> Column:
            start = F.lit(zero).cast("double" if isinstance(zero, float) else "long")
            return F.aggregate(others, start, lambda a, p: a + F.coalesce(p[name], start))

        return F.struct(F.try_divide(total("sum", 0.0), total("seen", 0).cast("double")).alias("mean"),
                        (total("up", 0) > 0).cast("int").alias("member"))

    # added up once per entry and fold, not once per row
    folds = F.filter("_parts", lambda p: p["_fold"].isNotNull())
    by_own = F.map_from_entries(F.transform(folds, lambda p: F.struct(p["_fold"], seen_from(p["_fold"]))))
    entries = _ranked(statistics).select(
        "column", "value", "code", by_own.alias("_by_fold"), seen_from(F.lit(None).cast(texts.schema["_fold"].dataType)).alias("_all"))
    size = statistics.agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 64).alias("bytes")).first()
    small = size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES
    found = lookup_join(long.select("_key", "_fold", "column", "value"), entries, ["column", "value"], "left", small=small)
    seen = F.coalesce(F.element_at("_by_fold", F.col("_fold")), F.col("_all"))
    found = found.select("_key", "column", "code", seen.alias("_seen")).select(
        "_key", "column", "code", F.col("_seen.mean").alias("mean"), F.col("_seen.member").alias("member"))
    gathered = [F.max(F.when(F.col("column") == c, F.col(value))).alias(prefix + name)
                for group, value, prefix in ((labels, "code", LABEL), (means, "mean", MEAN), (members, "member", MEMBER))
                for c, name in group.items()]
    wide = found.groupBy("_key").agg(*gathered)
    done = df.join(wide, F.col(key) == F.col("_key"), "left").drop("_key")
    return done.withColumns({MEMBER + c: F.coalesce(MEMBER + c, F.lit(0)) for c in members.values()})
