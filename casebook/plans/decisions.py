"""From a raw status history to one feature row per escalated case."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.text import leading_digit
from casebook.operators import history, labels
from casebook.operators.asof import before
from casebook.operators.eventlog import EventLog
from casebook.operators.sizing import hot_hashes


def case_decision_features(events: DataFrame, log: EventLog, escalated: Column, response: str,
                           severity: str = "severity", hot: Mapping[int, int] | None = None) -> DataFrame:
    """Decision time, target and history features of every escalated case that has events before its escalation.

    The decision time is the last time before the escalation, so the events up to the decision are the events before
    the escalation: one join gives both.
    """
    hot = hot_hashes(events, log.key) if hot is None else hot
    starts = labels.event_window(events, log, escalated).select(log.key, "escalation_start")
    needed = events.select(log.key, log.time, *dict.fromkeys([severity, response, *log.ties]))
    earlier = before(needed, starts, log, "escalation_start", hot)
    level = leading_digit(severity)
    return history.summarise(earlier, log, [
        F.max(log.time).alias("decision_time"),
        F.max(response).alias("response"),
        F.count("*").alias("n_events"),
        history.first_value(log, level).alias("initial_level"),
        history.last_value(log, level).alias("last_level"),
        history.mean_gap(log).alias("mean_gap_days"),
    ], "last_gap_days", hot)
