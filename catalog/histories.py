"""What happened in a case up to a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.operators import asof, history, labels
from casebook.operators.eventlog import EventLog
from casebook.operators.sizing import lookup_join, materialise
from casebook.plans import model_table as model
from catalog.fixtures import (COMMENT_ROWS, COMMENTS, DECISIONS, HISTORY, MILESTONE_ROWS, MILESTONES, POSITIVES,
                              RESPONSE, SCORING, STATUS_HISTORY, WINDOWS, comments, decisions, hot, milestones, scoring,
                              status_history)
from catalog.labelling import FOLDS, ORDER
from catalog.registry import query, rounded, table, with_

MILESTONE_IDS = (1, 2, 3, 4, 5, 6, 7)


@query(with_(STATUS_HISTORY, WINDOWS, POSITIVES, DECISIONS, MILESTONE_ROWS, select="""
SELECT m.reference_id, seconds_since_case_start, milestone_id, milestone_description, decision_time
FROM milestones m JOIN decisions d ON m.reference_id = d.reference_id AND seconds_since_case_start <= decision_time"""))
def cut_at(spark, folder):
    rows = milestones(spark, folder).select(
        "reference_id", "seconds_since_case_start", "milestone_id", "milestone_description")
    return asof.cut_at(rows, decisions(spark, folder), MILESTONES, hot=hot(spark, folder, "lineitem", "l_orderkey"))


@query(with_(STATUS_HISTORY, WINDOWS, select="""
SELECT c.reference_id, seconds_since_case_start, severity, escalation_start
FROM csh c JOIN windows w ON c.reference_id = w.reference_id WHERE seconds_since_case_start < escalation_start"""))
def before(spark, folder):
    events = status_history(spark, folder)
    windows = labels.event_window(events, HISTORY, F.col("is_escalate") == "Y")
    rows = events.select("reference_id", "seconds_since_case_start", "severity")
    return asof.before(rows, windows.select("reference_id", "escalation_start"), HISTORY, "escalation_start",
                       hot(spark, folder, "lineitem", "l_orderkey"))


@query(with_(COMMENT_ROWS, """errors AS (
  SELECT *, row_number() OVER (PARTITION BY reference_id, seconds_since_case_start ORDER BY event_id DESC) AS n
  FROM comments WHERE comment_type = 'error')""", select="""
SELECT c.reference_id, c.seconds_since_case_start, c.event_id, e.error_id, e.error_value FROM
  (SELECT * FROM comments WHERE comment_type <> 'error') c
ASOF LEFT JOIN (SELECT reference_id, seconds_since_case_start, event_id AS error_id, value AS error_value
                FROM errors WHERE n = 1) e
  ON c.reference_id = e.reference_id AND c.seconds_since_case_start >= e.seconds_since_case_start"""))
def latest_before(spark, folder):
    rows = comments(spark, folder)
    errors = rows.filter(F.col("comment_type") == "error").select(
        "reference_id", "seconds_since_case_start", F.col("event_id").alias("error_id"),
        F.col("value").alias("error_value"))
    others = rows.filter(F.col("comment_type") != "error").select(
        "reference_id", "seconds_since_case_start", "event_id")
    return asof.latest_before(others, errors, "reference_id", "seconds_since_case_start", ["error_id", "error_value"],
                              hot=hot(spark, folder, "events", "user_id"))


@query(with_(COMMENT_ROWS, select="""
SELECT reference_id, seconds_since_case_start, count(*) AS n_events,
  seconds_since_case_start - lag(seconds_since_case_start) OVER (PARTITION BY reference_id
    ORDER BY seconds_since_case_start) AS gap
FROM comments GROUP BY reference_id, seconds_since_case_start"""))
def gap_to_previous(spark, folder):
    return history.gap_to_previous(comments(spark, folder), COMMENTS, hot(spark, folder, "events", "user_id"))


_COUNTS = ",\n  ".join(
    f"count(*) FILTER (b.milestone_id = {v}) AS count_{v}, "
    f"min(b.seconds_since_case_start) FILTER (b.milestone_id = {v}) AS first_time_{v}, "
    f"max(b.seconds_since_case_start) FILTER (b.milestone_id = {v}) AS last_time_{v}" for v in MILESTONE_IDS)


@query(with_(STATUS_HISTORY, MILESTONE_ROWS, select=f"""
SELECT a.reference_id, a.seconds_since_case_start, count(b.milestone_id) AS total, {_COUNTS}
FROM (SELECT DISTINCT reference_id, seconds_since_case_start FROM milestones) a LEFT JOIN milestones b
  ON a.reference_id = b.reference_id AND b.seconds_since_case_start < a.seconds_since_case_start
GROUP BY ALL"""))
def pivot_counts(spark, folder):
    return history.pivot_counts(milestones(spark, folder), MILESTONES, "milestone_id", MILESTONE_IDS,
                                hot(spark, folder, "lineitem", "l_orderkey"))


@query(with_(COMMENT_ROWS, select="""
SELECT a.reference_id, a.seconds_since_case_start, b.comment_type, count(*) AS prior_count,
  min(b.seconds_since_case_start) AS first_time, max(b.seconds_since_case_start) AS last_time
FROM (SELECT DISTINCT reference_id, seconds_since_case_start FROM comments) a JOIN comments b
  ON a.reference_id = b.reference_id AND b.seconds_since_case_start < a.seconds_since_case_start
GROUP BY ALL"""))
def prior_counts(spark, folder):
    keys = hot(spark, folder, "events", "user_id")
    return history.prior_counts(comments(spark, folder), COMMENTS, "comment_type", hot=keys)


@query("""SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem LEFT JOIN
  (SELECT o_orderkey / 2 AS half, o_totalprice FROM orders) ON l_orderkey = half""")
def unlike_keys(spark, folder):
    """Order lines of whole keys looked up among halves: only whole halves match."""
    halves = table(spark, folder, "orders").select((F.col("o_orderkey") / 2).alias("l_orderkey"), "o_totalprice")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return lookup_join(lines, halves, "l_orderkey", "left", hot(spark, folder, "lineitem", "l_orderkey"))


_WORD_TIME = 1000  # words that share a time


@query(f"""WITH words AS (SELECT doc_id, (i - 1) // {_WORD_TIME} AS time, words[i] AS word FROM (
    SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i
    FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents)) WHERE words[i] <> ''),
  changes AS (SELECT doc_id, word, time, count(*) AS n FROM words GROUP BY ALL),
  moments AS (SELECT DISTINCT doc_id, time FROM words)
SELECT m.doc_id, m.time, word, sum(n)::BIGINT AS prior_count, min(c.time) AS first_time, max(c.time) AS last_time
FROM moments m JOIN changes c ON m.doc_id = c.doc_id AND c.time < m.time GROUP BY ALL""")
def prior_word_counts(spark, folder):
    """Earlier uses of every word of a document, at every 1,000 words: tens of thousands of categories."""
    words = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word"))
    events = words.filter("word <> ''").select("doc_id", F.floor(F.col("at") / _WORD_TIME).alias("time"), "word")
    return history.prior_counts(events, EventLog("doc_id", "time"), "word", hot=hot(spark, folder, "documents", "doc_id"))


_SEEN = ", ".join(
    f"count_{v}, CASE WHEN total IS NOT NULL THEN coalesce(first_time_{v}, -999) END AS first_time_{v}, "
    f"CASE WHEN total IS NOT NULL THEN coalesce(last_time_{v}, -999) END AS last_time_{v}" for v in MILESTONE_IDS)


GRID = f"""grid AS (
  SELECT a.reference_id, a.seconds_since_case_start, count(b.milestone_id) AS total, {_COUNTS}
  FROM (SELECT DISTINCT reference_id, seconds_since_case_start FROM milestones) a LEFT JOIN milestones b
    ON a.reference_id = b.reference_id AND b.seconds_since_case_start < a.seconds_since_case_start GROUP BY ALL)"""


@query(with_(STATUS_HISTORY, MILESTONE_ROWS, SCORING, GRID,
             """rows_in AS (
  SELECT reference_id, seconds_since_case_start, 1 AS in_train FROM csh
  WHERE inverse_time_to_next_escalation IS NOT NULL
  UNION ALL SELECT reference_id, seconds_since_case_start, 0 FROM scoring)""", select=f"""
SELECT r.*, total, {_SEEN}, r.seconds_since_case_start - g.seconds_since_case_start
  AS seconds_to_closest_milestone_features
FROM rows_in r ASOF LEFT JOIN grid g
  ON r.reference_id = g.reference_id AND r.seconds_since_case_start >= g.seconds_since_case_start"""))
def response_history(spark, folder):
    """Prior milestone counts as of every response row."""
    events = status_history(spark, folder)
    rows = materialise(labels.row_response_table(events, scoring(events), HISTORY, RESPONSE).select(
        "reference_id", "seconds_since_case_start", "in_train"))
    keys = hot(spark, folder, "lineitem", "l_orderkey")
    counts = history.pivot_counts(milestones(spark, folder), MILESTONES, "milestone_id", MILESTONE_IDS, keys)
    return history.as_of_rows(rows, counts, MILESTONES, keys)


@query(with_(STATUS_HISTORY, MILESTONE_ROWS, SCORING, GRID, f"""rows_in AS (
  SELECT reference_id, seconds_since_case_start, inverse_time_to_next_escalation, 1 AS in_train FROM csh
  WHERE inverse_time_to_next_escalation IS NOT NULL
  UNION ALL SELECT reference_id, seconds_since_case_start, NULL, 0 FROM scoring)""", select=f"""
SELECT r.* REPLACE (round(inverse_time_to_next_escalation, 6) AS inverse_time_to_next_escalation),
  {FOLDS.replace('reference_id', 'r.reference_id')}, total, {_SEEN},
  r.seconds_since_case_start - g.seconds_since_case_start AS seconds_to_closest_milestone_features
FROM rows_in r ASOF LEFT JOIN grid g
  ON r.reference_id = g.reference_id AND r.seconds_since_case_start >= g.seconds_since_case_start"""))
def row_model_table(spark, folder):
    """Response rows, many per case, with the milestone counts as of their time."""
    events = status_history(spark, folder)
    rows = labels.row_response_table(events, scoring(events), HISTORY, RESPONSE)
    keys = hot(spark, folder, "lineitem", "l_orderkey")
    return rounded(model.row_model_table(rows, milestones(spark, folder), MILESTONES, "milestone_id", MILESTONE_IDS, keys))


@query(with_(STATUS_HISTORY, select=f"""
SELECT reference_id, seconds_since_case_start, severity, l_linenumber, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY reference_id ORDER BY seconds_since_case_start DESC, l_linenumber DESC,
    l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS n FROM csh) WHERE n = 2"""))
def second_last(spark, folder):
    return history.nth_last(status_history(spark, folder), HISTORY, 2).select(
        "reference_id", "seconds_since_case_start", "severity", "l_linenumber", "l_partkey")


@query(with_(STATUS_HISTORY, f"""o AS (
  SELECT *, row_number() OVER (PARTITION BY reference_id ORDER BY {ORDER}) AS n,
    count(*) OVER (PARTITION BY reference_id) AS last_n,
    seconds_since_case_start - lag(seconds_since_case_start) OVER (PARTITION BY reference_id ORDER BY {ORDER}) AS gap
  FROM csh)""", select="""
SELECT reference_id, max(CASE WHEN n = 1 THEN severity END) AS first_severity,
  max(CASE WHEN n = last_n THEN severity END) AS last_severity, count(DISTINCT severity) AS severities,
  round(avg((severity = '1 - level')::INTEGER), 6) AS share_of_level_1, round(avg(gap) / 86400, 6) AS mean_gap,
  round(max(CASE WHEN n = last_n THEN gap END) / 86400, 6) AS last_gap,
  round(avg(l_quantity), 6) AS average, min(l_quantity) AS min, max(l_quantity) AS max,
  round(stddev_samp(l_quantity), 6) AS standard_deviation
FROM o GROUP BY reference_id"""))
def case_summaries(spark, folder):
    events = status_history(spark, folder)
    return rounded(history.summarise(events, HISTORY, [
        history.first_value(HISTORY, "severity").alias("first_severity"),
        history.last_value(HISTORY, "severity").alias("last_severity"),
        history.n_unique("severity").alias("severities"),
        history.category_share("severity", "1 - level").alias("share_of_level_1"),
        history.mean_gap(HISTORY).alias("mean_gap"),
        *[a.alias(n) for n, a in history.stats("l_quantity").items()],
    ], "last_gap", hot(spark, folder, "lineitem", "l_orderkey")))
