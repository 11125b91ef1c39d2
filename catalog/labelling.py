"""Decision times, targets and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.operators import labels
from casebook.operators.folds import assign, holdout
from casebook.operators.sizing import materialise
from casebook.plans.decisions import case_decision_features as decision_features
from catalog.fixtures import (HISTORY, LINE_TIES, POSITIVE_CASES, POSITIVES, RESPONSE, SCORING, STATUS_HISTORY, WINDOWS,
                              bucket_sql, hot, positive_cases, scoring, status_history)
from catalog.registry import query, rounded, table, with_

ORDER = ", ".join(("seconds_since_case_start", *LINE_TIES))


def _escalated():
    return F.col("is_escalate") == "Y"


def _hot(spark, folder):
    return hot(spark, folder, "lineitem", "l_orderkey")


def _windows(events):
    return labels.event_window(events, HISTORY, _escalated())


def _landed(spark, folder):
    """What labels need of the status history as a table of its own, for queries that read it several times."""
    return materialise(status_history(spark, folder).select(HISTORY.key, HISTORY.time, "is_escalate", RESPONSE))


CUT = """cut AS (SELECT c.*, decision_time, response, try_cast(substr(severity, 1, 1) AS INTEGER) AS level,
    seconds_since_case_start - lag(seconds_since_case_start) OVER by_time AS gap,
    row_number() OVER by_time AS first_n, count(*) OVER (PARTITION BY c.reference_id) AS n
  FROM csh c JOIN positives p ON c.reference_id = p.reference_id
  WHERE seconds_since_case_start <= decision_time
  WINDOW by_time AS (PARTITION BY c.reference_id ORDER BY """ + ORDER + "))"


@query(with_(STATUS_HISTORY, WINDOWS, POSITIVES, CUT, select="""
SELECT reference_id, max(decision_time) AS decision_time, round(max(response), 6) AS response, count(*) AS n_events,
  max(CASE WHEN first_n = 1 THEN level END) AS initial_level, max(CASE WHEN first_n = n THEN level END) AS last_level,
  round(avg(gap) / 86400, 6) AS mean_gap_days,
  round(max(CASE WHEN first_n = n THEN gap END) / 86400, 6) AS last_gap_days
FROM cut GROUP BY reference_id"""))
def case_decision_features(spark, folder):
    events = status_history(spark, folder)
    return rounded(decision_features(events, HISTORY, _escalated(), RESPONSE, hot=_hot(spark, folder)))


@query(with_(STATUS_HISTORY, WINDOWS, select="SELECT * FROM windows"))
def event_window(spark, folder):
    return _windows(status_history(spark, folder))


@query(with_(STATUS_HISTORY, select="""
SELECT DISTINCT reference_id FROM csh WHERE inverse_time_to_next_escalation > 0"""))
def positive_ids(spark, folder):
    return labels.positive_ids(status_history(spark, folder), HISTORY, RESPONSE)


@query(with_(STATUS_HISTORY, WINDOWS, POSITIVES, select="""
SELECT reference_id, decision_time, round(response, 6) AS response FROM positives"""))
def positive_targets(spark, folder):
    events = status_history(spark, folder)
    return rounded(labels.positive_targets(events, _windows(events), HISTORY, RESPONSE, _hot(spark, folder)))


RATIOS = """ratios AS (
  SELECT escalation_start / nullif(case_end, 0) AS ratio,
    rank() OVER (ORDER BY escalation_start / nullif(case_end, 0) NULLS FIRST) - 1 AS before, count(*) OVER () AS n
  FROM windows)"""
POINTS = """points AS (
  SELECT CASE WHEN n = 1 THEN 0 ELSE (before * 100) // (n - 1) END::INTEGER AS percentile,
    round(avg(ratio), 12) AS average_percentile_escalation_point
  FROM ratios WHERE ratio IS NOT NULL GROUP BY 1)"""


@query(with_(STATUS_HISTORY, WINDOWS, RATIOS, POINTS, select="""
SELECT percentile, round(average_percentile_escalation_point, 8) AS average_percentile_escalation_point FROM points"""))
def relative_points(spark, folder):
    return rounded(labels.relative_point_distribution(_windows(status_history(spark, folder))), 8)


def _cuts(events):
    windows = _windows(events)
    return labels.negative_cuts(events, windows, labels.relative_point_distribution(windows), HISTORY)


CUTS = f"""cuts AS (
  SELECT reference_id, case_end * average_percentile_escalation_point AS time_cut
  FROM (SELECT reference_id, max(seconds_since_case_start) AS case_end FROM csh
        WHERE reference_id NOT IN (SELECT reference_id FROM windows) GROUP BY reference_id)
  JOIN (SELECT *, row_number() OVER (ORDER BY percentile) - 1 AS point FROM points)
    ON point = {bucket_sql('reference_id', '(SELECT count(*) FROM points)', 'negative')})"""
NEGATIVES = """negatives AS (
  SELECT c.reference_id, max(seconds_since_case_start) AS decision_time, 0.0::DOUBLE AS response
  FROM csh c JOIN cuts ON c.reference_id = cuts.reference_id
  WHERE seconds_since_case_start < time_cut GROUP BY c.reference_id)"""
NEGATIVE_PARTS = (STATUS_HISTORY, WINDOWS, RATIOS, POINTS, CUTS)


@query(with_(*NEGATIVE_PARTS, NEGATIVES, select="SELECT * FROM negatives"))
def negative_targets(spark, folder):
    events = _landed(spark, folder)
    return labels.negative_targets(events, _cuts(events), HISTORY, _hot(spark, folder))


@query(with_(*NEGATIVE_PARTS, select="""
SELECT count(*) AS negative_cases, count(*) FILTER (before_cut > 0) AS with_decision,
  sum(at_cut)::BIGINT AS rows_at_cut, count(*) FILTER (before_cut = 0) AS lost_cases
FROM (SELECT c.reference_id, count(*) FILTER (seconds_since_case_start < time_cut) AS before_cut,
        count(*) FILTER (seconds_since_case_start = time_cut) AS at_cut
      FROM csh c JOIN cuts ON c.reference_id = cuts.reference_id GROUP BY c.reference_id)"""))
def audit_dropped(spark, folder):
    events = _landed(spark, folder)
    return labels.audit_dropped(events, _cuts(events), HISTORY, _hot(spark, folder))


def responses(spark, folder):
    events = _landed(spark, folder)
    positives = labels.positive_targets(events, _windows(events), HISTORY, RESPONSE, _hot(spark, folder))
    negatives = labels.negative_targets(events, _cuts(events), HISTORY, _hot(spark, folder))
    return labels.response_table(scoring(events), positives, negatives, HISTORY)


RESPONSES = """responses AS (
  SELECT reference_id, seconds_since_case_start AS decision_time, NULL::DOUBLE AS response FROM scoring
  UNION ALL SELECT * FROM (FROM positives UNION ALL FROM negatives)
  WHERE reference_id NOT IN (SELECT reference_id FROM scoring))"""
RESPONSE_PARTS = (*NEGATIVE_PARTS, POSITIVES, NEGATIVES, SCORING, RESPONSES)


@query(with_(*RESPONSE_PARTS, select="""
SELECT reference_id, decision_time, round(response, 6) AS response FROM responses"""))
def response_table(spark, folder):
    return rounded(responses(spark, folder))


FOLDS = f"""{bucket_sql('reference_id', 5, 39)}::INTEGER AS cross_validation_fold_0,
  {bucket_sql('reference_id', 5, 12)}::INTEGER AS cross_validation_fold_1"""


@query(with_(STATUS_HISTORY, SCORING, select=f"""
SELECT *, {FOLDS} FROM (
  SELECT reference_id, seconds_since_case_start,
    round(inverse_time_to_next_escalation, 6) AS inverse_time_to_next_escalation, 1 AS in_train
  FROM csh WHERE inverse_time_to_next_escalation IS NOT NULL
  UNION ALL SELECT reference_id, seconds_since_case_start, NULL, 0 FROM scoring)"""))
def row_response(spark, folder):
    events = status_history(spark, folder)
    return rounded(labels.row_response_table(events, scoring(events), HISTORY, RESPONSE))


@query(f"""SELECT reference_id, {FOLDS}, ({bucket_sql('reference_id', 100, 'holdout')} < 25)::INTEGER AS is_holdout
FROM (SELECT DISTINCT l_orderkey AS reference_id FROM lineitem)""")
def grouped_folds(spark, folder):
    cases = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("reference_id")).distinct()
    return holdout(assign(cases, "reference_id"), "reference_id")


@query(with_(POSITIVE_CASES, select="""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT reference_id FROM positive_cases)"""))
def exclude_ids(spark, folder):
    ids = positive_cases(spark, folder).withColumnRenamed("reference_id", "o_orderkey")
    return labels.exclude_ids(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ids, "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def only_ids(spark, folder):
    urgent = table(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return labels.only_ids(line, urgent.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey",
                           _hot(spark, folder))
