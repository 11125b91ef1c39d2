"""Joins of an event log to a time per case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.operators.eventlog import EventLog
from casebook.operators.rank import range_buckets, with_range_value
from casebook.operators.sizing import as_list, hot_hashes, lookup_join, split_hot


def cut_at(events: DataFrame, decisions: DataFrame, log: EventLog, cut: str = "decision_time", strict: bool = False,
           hot: Mapping[int, int] | None = None) -> DataFrame:
    """Keep each case's events up to its decision time; the filter becomes part of the join condition.

    ``decisions`` has one row per case. Hot cases are salted, see :func:`lookup_join`.
    """
    joined = lookup_join(events, decisions, log.key, "inner", hot)
    time = F.col(log.time)
    return joined.filter(time < F.col(cut) if strict else time <= F.col(cut))


def before(events: DataFrame, cuts: DataFrame, log: EventLog, cut: str,
           hot: Mapping[int, int] | None = None) -> DataFrame:
    """Keep the events strictly before a time per case."""
    return cut_at(events, cuts, log, cut, strict=True, hot=hot)


def latest_before(left: DataFrame, right: DataFrame, by: str | Sequence[str], on: str, columns: Sequence[str],
                  ties: Sequence[str] = (), strict: bool = False, hot: Mapping[int, int] | None = None) -> DataFrame:
    """Add to each left row ``columns`` of the latest right row of its key at or before its time.

    Rows of the right side at one time are told apart by ``ties`` (default ``columns``), greatest wins. Left rows
    without an earlier right row keep nulls. Both sides are stacked and filled forward in one window per key; the time
    lines of keys that are hot on either side (``hot``, from :func:`hot_hashes`) are cut into ranges instead, those of
    all other keys are not moved for it.
    """
    by, ties = as_list(by), list(ties) or list(columns)
    # an event without key or time is before nothing, and a row without either has nothing before it
    for c in (*by, on):
        right = right.filter(F.col(c).isNotNull())
    asks = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, on)])
    nothing = left.filter(~asks).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns])
    left = left.filter(asks)
    keys = left.select(*by).unionAll(right.select(*by))
    hot = hot_hashes(keys, by) if hot is None else hot
    if not hot:
        return _latest_in_windows(left, right, by, on, columns, ties, strict).unionByName(nothing)
    # both sides get the key in the type in which they are compared, so that one split holds for them
    types = dict(keys.dtypes)
    sides = [split_hot(side.withColumns({f"_key_{c}": F.col(c).cast(types[c]) for c in by}), [f"_key_{c}" for c in by], hot)
             for side in (left, right)]
    (left_hot, left), (right_hot, right) = ([part.drop(*[f"_key_{c}" for c in by]) for part in side] for side in sides)
    ranged = _latest_in_ranges(left_hot, right_hot, by, on, columns, ties, strict)
    return ranged.unionByName(_latest_in_windows(left, right, by, on, columns, ties, strict)).unionByName(nothing)


def _latest_in_windows(left: DataFrame, right: DataFrame, by: list[str], on: str, columns: Sequence[str],
                       ties: list[str], strict: bool) -> DataFrame:
    """One sorted window per key."""
    events = right.select(*by, on, F.struct(*columns).alias("_payload"), F.struct(*ties).alias("_tie"),
                          F.lit(0).alias("_asked"))
    stacked = left.withColumn("_asked", F.lit(1)).unionByName(events, allowMissingColumns=True)
    # at one time an event comes before the row that asks, unless only earlier events count
    side = F.col("_asked").desc() if strict else F.col("_asked").asc()
    so_far = Window.partitionBy(*by).orderBy(on, side, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = stacked.withColumn("_found", F.last("_payload", ignorenulls=True).over(so_far))
    found = found.filter(F.col("_asked") == 1)
    return found.select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in columns])


def _latest_in_ranges(left: DataFrame, right: DataFrame, by: list[str], on: str, columns: Sequence[str],
                      ties: list[str], strict: bool) -> DataFrame:
    """The same with no key in one task.

    Both sides are first reduced to one row per key and time; those rows are cut into ranges of (key, time), filled
    forward inside each range, and the last value of a range is handed to the next one.
    """
    payload = F.struct(*columns)
    moments = (
        left.select(*by, on).withColumns({"_payload": F.lit(None), "_tie": F.lit(None), "_asked": F.lit(1)})
        .unionByName(right.select(*by, on, payload.alias("_payload"), F.struct(*ties).alias("_tie"),
                                  F.lit(0).alias("_asked")))
        .groupBy(*by, on)
        .agg(F.max_by("_payload", "_tie").alias("_payload"), F.max("_asked").alias("_asked"))
    )
    ranged = range_buckets(moments, [*by, on])
    key = F.struct(*by)
    # One row per range.
    last_seen = F.max_by(F.struct(key.alias("key"), "_payload", "_asked"),
                         F.when(F.col("_payload").isNotNull(), F.struct(*by, on)))
    ends = ranged.groupBy("_bucket").agg(F.max(key).alias("_key"), last_seen.alias("_seen"))
    running = Window.partitionBy("_key").orderBy("_bucket")
    ends = ends.withColumn("_last", F.last(F.when(F.col("_seen.key") == F.col("_key"), F.col("_seen._payload")),
                                           ignorenulls=True).over(running))
    carried = ends.select("_bucket", F.lag(F.struct("_key", "_last")).over(Window.orderBy("_bucket")).alias("end"))
    frame = Window.partitionBy("_bucket", *by).orderBy(on).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    found = F.coalesce(F.last("_payload", ignorenulls=True).over(frame),
                       F.when(F.col("_carry.end._key") == key, F.col("_carry.end._last")))
    answers = (
        with_range_value(ranged, carried, "_carry")
        .withColumn("_found", found)
        .filter(F.col("_asked") == 1)
        .select(*by, on, *[F.col(f"_found.{c}").alias(c) for c in columns])
    )
    return lookup_join(left, answers, [*by, on], "left")
