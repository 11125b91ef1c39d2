"""Decision times and targets that do not look past the decision."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.hashing import hash_number
from casebook.operators.asof import before
from casebook.operators.eventlog import EventLog
from casebook.operators.folds import assign
from casebook.operators.rank import rank_table
from casebook.operators.sizing import lookup_join, materialise


def positive_ids(events: DataFrame, log: EventLog, response: str) -> DataFrame:
    """Cases with a response above 0."""
    return events.filter(F.col(response) > 0).select(log.key).distinct()


def exclude_ids(df: DataFrame, ids: DataFrame, key: str, hot: Mapping[int, int] | None = None) -> DataFrame:
    """Rows of the cases that are not in ``ids``."""
    return lookup_join(df, ids.select(key), key, "left_anti", hot)


def only_ids(df: DataFrame, ids: DataFrame, key: str, hot: Mapping[int, int] | None = None) -> DataFrame:
    """Rows of the cases in ``ids``; repeated ids do not repeat rows."""
    return lookup_join(df, ids.select(key), key, "left_semi", hot)


def event_window(events: DataFrame, log: EventLog, predicate: Column) -> DataFrame:
    """Per case with an event that matches: first and last time of those events."""
    return events.filter(predicate).groupBy(log.key).agg(
        F.min(log.time).alias("escalation_start"), F.max(log.time).alias("case_end")
    )


def positive_targets(events: DataFrame, windows: DataFrame, log: EventLog, response: str,
                     hot: Mapping[int, int] | None = None) -> DataFrame:
    """Per escalated case: the last time strictly before the escalation, and the greatest response up to it.

    A case that starts escalated drops out.
    """
    starts = windows.select(log.key, "escalation_start")
    earlier = before(events.select(log.key, log.time, response), starts, log, "escalation_start", hot)
    return earlier.groupBy(log.key).agg(
        F.max(log.time).alias("decision_time"), F.max(response).cast("double").alias("response")
    )


def relative_point_distribution(windows: DataFrame) -> DataFrame:
    """Where in its case an escalation starts: mean of start / end per percentile, at most 101 rows.

    The percentile is floor(100 * percent rank) in whole numbers. Means are rounded to 12 digits, so that the order in
    which a sum ran cannot move a cut across an event.
    """
    ratio = F.try_divide(F.col("escalation_start").cast("double"), F.col("case_end"))
    ranked = rank_table(windows.select(ratio.alias("ratio")), "ratio")
    percentile = F.when(F.col("total") == 1, F.lit(0)).otherwise(
        F.expr("(before * 100) div (total - 1)")).cast("int")
    mean = F.sum(F.col("ratio") * F.col("cnt")) / F.sum("cnt")
    return ranked.filter(F.col("ratio").isNotNull()).groupBy(percentile.alias("percentile")).agg(
        F.round(mean, 12).alias("average_percentile_escalation_point")
    )


def negative_cuts(events: DataFrame, windows: DataFrame, distribution: DataFrame, log: EventLog,
                  salt: int | str = "negative") -> DataFrame:
    """Per never-escalated case: its end, and a cut at one of the relative points, picked by a hash of the case."""
    ends = events.groupBy(log.key).agg(F.max(log.time).alias("case_end"))
    ends = ends.join(windows.select(log.key), log.key, "left_anti")
    # at most 101 rows, counted and looked up: written once
    distribution = materialise(distribution.coalesce(1))
    indexed = distribution.select(
        (F.row_number().over(Window.orderBy("percentile")) - 1).cast("long").alias("_point"),
        "average_percentile_escalation_point",
    )
    n_points = distribution.agg(F.count("*")).scalar()
    picked = ends.withColumn("_point", F.try_mod(hash_number(log.key, salt), n_points))
    cut = F.col("case_end") * F.col("average_percentile_escalation_point")
    return picked.join(F.broadcast(indexed), "_point").select(log.key, "case_end", cut.alias("time_cut"))


def negative_targets(events: DataFrame, cuts: DataFrame, log: EventLog,
                     hot: Mapping[int, int] | None = None) -> DataFrame:
    """Per never-escalated case: the last time strictly before its cut, with response 0. None before it: drops out."""
    earlier = before(events.select(log.key, log.time), cuts.select(log.key, "time_cut"), log, "time_cut", hot)
    return earlier.groupBy(log.key).agg(
        F.max(log.time).alias("decision_time"), F.lit(0.0).alias("response")
    )


def audit_dropped(events: DataFrame, cuts: DataFrame, log: EventLog, hot: Mapping[int, int] | None = None) -> DataFrame:
    """One row on the never-escalated cases: how many there are, how many have an event before the cut, how many are
    lost, and how many events lie exactly at a cut."""
    joined = lookup_join(events.select(log.key, log.time), cuts.select(log.key, "time_cut"), log.key, "inner", hot)
    per_case = joined.groupBy(log.key).agg(
        F.count_if(F.col(log.time) < F.col("time_cut")).alias("before_cut"),
        F.count_if(F.col(log.time) == F.col("time_cut")).alias("at_cut"),
    )
    counts = per_case.agg(
        F.count("*").alias("negative_cases"),
        F.count_if(F.col("before_cut") > 0).alias("with_decision"),
        F.coalesce(F.sum("at_cut"), F.lit(0)).alias("rows_at_cut"),
    )
    return counts.withColumn("lost_cases", F.col("negative_cases") - F.col("with_decision"))


def response_table(test: DataFrame, positives: DataFrame, negatives: DataFrame, log: EventLog) -> DataFrame:
    """Scoring cases (null response) and training cases that are not scoring cases: key, decision_time, response."""
    # one row per case on both sides: no case can be hot
    training = exclude_ids(positives.unionByName(negatives), test, log.key, hot={})
    scoring = test.select(log.key, F.col(log.time).alias("decision_time"), F.lit(None).cast("double").alias("response"))
    return scoring.unionByName(training.select(log.key, "decision_time", "response"))


def row_response_table(events: DataFrame, test: DataFrame, log: EventLog, response: str, k: int = 5) -> DataFrame:
    """Every event with a response (``in_train`` 1) and every scoring row (0), with grouped folds."""
    rows = events.select(log.key, log.time, F.col(response).cast("double").alias(response))
    training = rows.filter(F.col(response).isNotNull()).withColumn("in_train", F.lit(1))
    scoring = test.select(log.key, log.time, F.lit(None).cast("double").alias(response), F.lit(0).alias("in_train"))
    return assign(training.unionByName(scoring), log.key, k)
