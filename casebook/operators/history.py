"""What happened in a case so far.

The first group of functions gives aggregate columns for one ``groupBy(log.key)``: they all have a map-side partial
form, so a case with a third of all events is reduced before the shuffle. The second group gives tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.text import column
from casebook.operators.eventlog import EventLog
from casebook.operators.asof import latest_before
from casebook.operators.rank import range_buckets, with_range_value
from casebook.operators.sizing import hot_hashes, pair_join, shuffle_partitions, split_hot

# Seconds in a day, and the time of something that has not happened.
DAY = 86400
NEVER = -999
# Cases that meet their categories go to so many times the shuffle partitions.
MEETING = 4


# ---- aggregate columns

def last_value(log: EventLog, value: str | Column) -> Column:
    """Value of the latest event, null included."""
    return F.max_by(column(value), log.order)


def first_value(log: EventLog, value: str | Column) -> Column:
    """Value of the earliest event, null included."""
    return F.min_by(column(value), log.order)


def mean_gap(log: EventLog) -> Column:
    """Mean days between neighbouring events: the gaps add up to last time minus first time."""
    time = log.here(log.time)
    return F.try_divide((F.max(time) - F.min(time)).cast("double"), F.count(time) - 1) / DAY


def stats(value: str | Column) -> dict[str, Column]:
    value = column(value)
    return {"average": F.avg(value), "min": F.min(value), "max": F.max(value), "standard_deviation": F.stddev(value)}


def n_unique(value: str | Column, hot: bool = True) -> Column:
    """Number of different values, nulls not counted.

    ``hot`` says that a case may hold a large share of all rows. Where none does, a case's values fit a set, and the
    aggregates need not be computed on a copy of the rows for every such column.
    """
    return F.count_distinct(column(value)) if hot else F.size(F.collect_set(column(value))).cast("long")


def category_share(value: str | Column, category, log: EventLog = EventLog()) -> Column:
    """Share of the events with one category; an event with no category counts as another."""
    return F.avg(log.here(F.when(column(value) == F.lit(category), 1.0).otherwise(0.0)))


# ---- tables

def nth_last(events: DataFrame, log: EventLog, n: int = 2) -> DataFrame:
    """The n-th latest event of each case that has so many.

    Spark keeps n rows per case and map task before the shuffle (WindowGroupLimit).
    """
    latest_first = Window.partitionBy(log.key).orderBy(*[F.col(c).desc() for c in (log.time, *log.ties)])
    ranked = events.withColumn("_n", F.row_number().over(latest_first)).filter(F.col("_n") <= n)
    return ranked.filter(F.col("_n") == n).drop("_n")


def latest_row(events: DataFrame, log: EventLog) -> DataFrame:
    """The latest event of each case."""
    return nth_last(events, log, 1)


def last_gap(events: DataFrame, log: EventLog, name: str = "last_gap") -> DataFrame:
    """Days from the last but one event to the last, per case; null for a single event."""
    latest_first = Window.partitionBy(log.key).orderBy(F.col(log.time).desc())
    two = (
        events.select(log.key, log.time).filter(F.col(log.time).isNotNull())
        .withColumn("_n", F.row_number().over(latest_first)).filter(F.col("_n") <= 2)
    )
    gap = F.when(F.count("*") == 2, (F.max(log.time) - F.min(log.time)) / DAY)
    return two.groupBy(log.key).agg(gap.alias(name))


def summarise(events: DataFrame, log: EventLog, aggregates: Sequence[Column], gap_name: str,
              hot: Mapping[int, int] | None = None) -> DataFrame:
    """One row per case: aggregate columns as above, and the last gap in days under ``gap_name``.

    Without a hot case one shuffle and one sort serve the gaps and all aggregates. With one (``hot``, from
    :func:`hot_hashes`) the aggregates keep their map-side part and :func:`last_gap` is joined.
    """
    hot = hot_hashes(events, log.key) if hot is None else hot
    if hot:
        cases = events.groupBy(log.key).agg(*aggregates)
        gaps = last_gap(events, log, gap_name).withColumnRenamed(log.key, "_gap_key")
        return cases.join(gaps, F.col(log.key).eqNullSafe(F.col("_gap_key")), "left").drop("_gap_key")
    gap = F.col(log.time) - F.lag(log.time).over(Window.partitionBy(log.key).orderBy(log.time))
    # of several events at the last time, all but one follow with gap 0
    last = F.max_by("_gap", F.struct(log.time, -F.col("_gap"))) / DAY
    return events.withColumn("_gap", gap).groupBy(log.key).agg(*aggregates, last.alias(gap_name))


def summarise_logs(events: DataFrame, key: str, time: str, tag: str,
                   logs: Sequence[tuple[EventLog, Mapping[str, Column], str]],
                   hot: Mapping[int, int] | None = None) -> DataFrame:
    """One row per case from the rows of several logs stacked in one table.

    Every log has its name in the column ``tag`` and comes as (log, aggregate columns by name, name of its last gap in
    days); its ``only`` must be ``<tag> = '<name>'``. A case without rows of a log has nulls for it. Without a hot case
    one sort on (case, log, time) serves the gaps of all logs, and a table bucketed by case needs no shuffle.
    """
    hot = hot_hashes(events, key) if hot is None else hot
    plain = [F.when(F.count_if(F.expr(log.only)) > 0, column).alias(name)
             for log, columns, _ in logs for name, column in columns.items()]
    if hot:
        latest_first = Window.partitionBy(key, tag).orderBy(F.col(time).desc())
        two = events.select(key, tag, time).filter(F.col(time).isNotNull())
        two = two.withColumn("_n", F.row_number().over(latest_first)).filter(F.col("_n") <= 2)
        gaps = two.groupBy(key).agg(*[
            F.when(F.count_if(F.expr(log.only)) == 2, (F.max(log.here(time)) - F.min(log.here(time))) / DAY).alias(name)
            for log, _, name in logs]).withColumnRenamed(key, "_gap_key")
        cases = events.groupBy(key).agg(*plain)
        return cases.join(gaps, F.col(key).eqNullSafe(F.col("_gap_key")), "left").drop("_gap_key")
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(key, tag).orderBy(time))
    last = [(F.max_by("_gap", log.here(F.struct(time, -F.col("_gap")))) / DAY).alias(name) for log, _, name in logs]
    return events.withColumn("_gap", gap).groupBy(key).agg(*plain, *last)


def gap_to_previous(events: DataFrame, log: EventLog, hot: Mapping[int, int] | None = None) -> DataFrame:
    """Per case and time: ``n_events`` and ``gap``, the seconds since the time before (null for the first).

    Events at one time follow each other with gap 0, so only the first of them has this gap. The time lines of hot
    cases (``hot``, from :func:`hot_hashes`) are cut into ranges, and the first gap of a range starts at the end of the
    range before.
    """
    hot = hot_hashes(events, log.key) if hot is None else hot
    moments = events.groupBy(log.key, log.time).agg(F.count("*").alias("n_events"))
    gap = F.col(log.time) - F.lag(log.time).over(Window.partitionBy(log.key).orderBy(log.time))
    if not hot:
        return moments.withColumn("gap", gap)
    large, rest = split_hot(moments, log.key, hot)
    ranged = range_buckets(large, [log.key, log.time])
    # One row per range.
    ends = ranged.groupBy("_bucket").agg(F.max(F.struct(log.key, log.time, "n_events")).alias("_end"))
    carried = ends.select("_bucket", F.lag("_end").over(Window.orderBy("_bucket")).alias("end"))
    inside = Window.partitionBy("_bucket", log.key).orderBy(log.time)
    previous = F.coalesce(
        F.lag(log.time).over(inside),
        F.when(F.col(f"_carry.end.{log.key}").eqNullSafe(F.col(log.key)), F.col(f"_carry.end.{log.time}")),
    )
    return with_range_value(ranged, carried, "_carry").select(
        log.key, log.time, "n_events", (F.col(log.time) - previous).alias("gap")
    ).unionByName(rest.withColumn("gap", gap))


def pivot_counts(events: DataFrame, log: EventLog, category: str, values: Sequence | None = None,
                 hot: Mapping[int, int] | None = None) -> DataFrame:
    """Per case and time, for each category value: count, first and last time of the strictly earlier events.

    Columns ``count_<v>``, ``first_time_<v>``, ``last_time_<v>`` and ``total``. Running sums over a case's events stand in
    for a join of every event to all earlier ones: what precedes the first event of a time is what happened strictly
    before. A task sorts the events as they are, and the wide rows only pass through it. Without ``values`` one job
    collects them. Hot cases (``hot``, from :func:`hot_hashes`) are summed up per time and cut into ranges that hand
    their sums on.
    """
    hot = hot_hashes(events, log.key) if hot is None else hot
    values = _category_values(events, category) if values is None else values
    large, rest = split_hot(events, log.key, hot) if hot else (None, events)
    time = F.col(log.time)
    parts = {"total": (F.count("*"), F.sum)}
    for v in values:
        here = F.col(category) == F.lit(v)
        parts[f"count_{v}"] = F.count_if(here), F.sum
        parts[f"first_time_{v}"] = F.min(F.when(here, time)), F.min
        parts[f"last_time_{v}"] = F.max(F.when(here, time)), F.max
    in_order = Window.partitionBy(log.key).orderBy(log.time)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    is_first = (F.row_number().over(in_order) == 1) | ~time.eqNullSafe(F.lag(log.time).over(in_order))
    found = rest.select(log.key, log.time, *[a.over(earlier).alias(c) for c, (a, _) in parts.items()],
                        is_first.alias("_is_first")).filter("_is_first").drop("_is_first")
    fold = {c: f for c, (_, f) in parts.items()}
    if hot:
        moments = large.groupBy(log.key, log.time).agg(*[a.alias(c) for c, (a, _) in parts.items()])
        found = _prior_in_ranges(moments, log, fold).unionByName(found)
    return found.fillna(0, [c for c, f in fold.items() if f is F.sum])


def _category_values(events: DataFrame, category: str, limit: int = 10_000) -> list:
    found = events.select(category).filter(F.col(category).isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{category} has more than {limit} values; pass the ones to count")
    return sorted(row[0] for row in found)


def _prior(moments: DataFrame, log: EventLog, fold: Mapping[str, Callable], *kept: str) -> DataFrame:
    earlier = Window.partitionBy(log.key).orderBy(log.time).rowsBetween(Window.unboundedPreceding, -1)
    return moments.select(log.key, log.time, *kept, *[f(c).over(earlier).alias(c) for c, f in fold.items()])


def _prior_of_all(moments: DataFrame, log: EventLog, fold: Mapping[str, Callable], hot: Mapping[int, int], case: str,
                  *kept: str) -> DataFrame:
    """:func:`_prior`, for hot cases in ranges; ``case`` is the column or field that tells them."""
    if not hot:
        return _prior(moments, log, fold, *kept)
    large, rest = split_hot(moments, case, hot)
    return _prior_in_ranges(large, log, fold, *kept).unionByName(_prior(rest, log, fold, *kept))


def _prior_in_ranges(moments: DataFrame, log: EventLog, fold: Mapping[str, Callable], *kept: str) -> DataFrame:
    """The same with no case in one task."""
    ranged = range_buckets(moments, [log.key, log.time])
    # Only the last case of a range can go on in the next one: one row of totals per range.
    in_range = ranged.groupBy("_bucket", log.key).agg(*[f(c).alias(c) for c, f in fold.items()])
    last_case = F.max(F.struct(log.key, *fold))
    ends = in_range.groupBy("_bucket").agg(last_case.alias("_end")).select("_bucket", "_end.*")
    so_far = Window.partitionBy(log.key).orderBy("_bucket")
    ends = ends.select("_bucket", log.key, *[f(c).over(so_far).alias(c) for c, f in fold.items()])
    carried = ends.select(
        "_bucket", F.lag(F.struct(log.key, *fold)).over(Window.orderBy("_bucket")).alias("end")
    )
    earlier = Window.partitionBy("_bucket", log.key).orderBy(log.time).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col(f"_carry.end.{log.key}").eqNullSafe(F.col(log.key))

    def prior(name, f):
        inside, carry = f(name).over(earlier), F.when(same, F.col(f"_carry.end.{name}"))
        if f is F.sum:
            return F.coalesce(inside + carry, inside, carry)
        return F.least(inside, carry) if f is F.min else F.greatest(inside, carry)

    return with_range_value(ranged, carried, "_carry").select(
        log.key, log.time, *kept, *[prior(c, f).alias(c) for c, f in fold.items()]
    )


def prior_counts(events: DataFrame, log: EventLog, category: str, values: Sequence | None = None,
                 hot: Mapping[int, int] | None = None, at: DataFrame | None = None) -> DataFrame:
    """One row per case, time and category seen before it: ``prior_count``, ``first_time``, ``last_time`` of the
    strictly earlier events.

    Times are those of the case's events, or those of ``at`` (key and time). There is no list of categories: a moment
    meets the categories whose first event is earlier, which are the rows of the result, and a running sum per (case,
    category) over its events alone carries the counts to them. ``values`` restricts the categories; a null one does
    not count. The rows of a case are brought together once, which serves every step; their bytes tell little of the rows
    that come of them, so the number of tasks is fixed. A hot case (``hot``, from :func:`hot_hashes`) meets its
    categories over salts, and the running sums go in ranges of (case, category, time).
    """
    hot = hot_hashes(events, log.key) if hot is None else hot
    case, time = F.struct(log.key).alias("_case"), F.col(log.time)  # in a struct, null keys are equal
    changes = events.filter(F.col(category).isNotNull() & time.isNotNull())
    changes = changes if values is None else changes.filter(F.col(category).isin(list(values)))
    changes = changes.select(case, category, log.time)
    changes = changes if hot else changes.repartition(MEETING * shuffle_partitions(events), "_case")
    changes = changes.groupBy("_case", category, log.time).agg(F.count("*").alias("prior_count"))
    firsts = changes.groupBy("_case", category).agg(F.min(log.time).alias("_first"))
    moments = (events if at is None else at).select(case, log.time).distinct()
    met = pair_join(moments, firsts, ["_case"]) if hot else moments.join(firsts, "_case")
    asked = met.filter(time > F.col("_first")).select("_case", category, log.time, F.lit(0).cast("long").alias("prior_count"),
                                                      F.lit(True).alias("_asked"))
    stacked = asked.unionByName(changes.withColumn("_asked", F.lit(False)))
    happened = F.when(F.col("prior_count") > 0, time)
    fold = {"prior_count": F.sum, "first_time": F.min, "last_time": F.max}
    if hot:
        line = EventLog("_line", log.time)
        stacked = stacked.groupBy(F.struct("_case", category).alias("_line"), log.time).agg(
            F.sum("prior_count").alias("prior_count"), F.min(happened).alias("first_time"),
            F.max(happened).alias("last_time"), F.max("_asked").alias("_asked"))
        prior = _prior_of_all(stacked, line, fold, hot, f"_line._case.{log.key}", "_asked")
        return prior.filter("_asked").select(F.col(f"_line._case.{log.key}").alias(log.key), log.time,
                                             F.col(f"_line.{category}").alias(category), *fold)
    # what is asked at a time comes before what changes at it
    earlier = Window.partitionBy("_case", category).orderBy(log.time, F.desc("_asked"))
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    prior = stacked.withColumns({"first_time": happened, "last_time": happened}).select(
        F.col(f"_case.{log.key}").alias(log.key), log.time, category, "_asked",
        *[f(c).over(earlier).alias(c) for c, f in fold.items()])
    return prior.filter("_asked").drop("_asked")


def as_of_rows(rows: DataFrame, counts: DataFrame, log: EventLog, hot: Mapping[int, int] | None = None) -> DataFrame:
    """Response rows with the latest :func:`pivot_counts` row of their case at or before their time.

    The time of a value not seen by then is NEVER. ``seconds_to_closest_milestone_features`` is how long before the
    counts were taken; a case without any keeps nulls.
    """
    columns = [c for c in counts.columns if c not in (log.key, log.time)]
    times = [c for c in columns if c.startswith(("first_time_", "last_time_"))]
    dated = counts.fillna(NEVER, times).withColumn("_counted_at", F.col(log.time))
    found = latest_before(rows, dated, log.key, log.time, [*columns, "_counted_at"], ["_counted_at"], hot=hot)
    distance = F.col(log.time) - F.col("_counted_at")
    return found.withColumn("seconds_to_closest_milestone_features", distance).drop("_counted_at")
