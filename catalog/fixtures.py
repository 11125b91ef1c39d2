"""The test tables as case logs, in Spark and as SQL parts of the same name.

``lineitem`` is a status history (an order is a case, a returned line an escalation) and, with ``part``, a milestone
log; ``events`` is a comment log; ``orders`` with its customer holds the case attributes.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions.hashing import hash_bucket
from casebook.operators.clean import union_all
from casebook.operators.eventlog import EventLog
from casebook.operators.labels import event_window, positive_targets
from casebook.operators.sizing import hot_hashes, lookup_join
from catalog.registry import table

LINE_TIES = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
HISTORY = EventLog(ties=LINE_TIES)
MILESTONES = EventLog(ties=("milestone_id", *LINE_TIES[1:]))
COMMENTS = EventLog(ties=("event_id",))
TURNS = EventLog(ties=())
RESPONSE = "inverse_time_to_next_escalation"

_hot: dict[tuple, dict[int, int]] = {}


def hot(spark: SparkSession, folder: str, name: str, *on: str) -> dict[int, int]:
    """Hot keys of a base table, looked for once."""
    if (folder, name, on) not in _hot:
        _hot[folder, name, on] = hot_hashes(table(spark, folder, name), on)
    return _hot[folder, name, on]


def seconds_between(start: str, end: str):
    return F.expr(f"cast(cast({end} - {start} as interval second) as bigint)")


def lines(spark, folder, *columns: str) -> DataFrame:
    """Order lines with the case key and the case time."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", *dict.fromkeys(columns))
    starts = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first_ship"),
        F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("first_r"),
    )
    joined = lookup_join(line, starts, "l_orderkey", hot=hot(spark, folder, "lineitem", "l_orderkey"))
    return joined.withColumn("seconds_since_case_start", seconds_between("first_ship", "l_shipdate"))


def severity():
    return F.concat((1 + F.col("l_linenumber") % 4).cast("string"), F.lit(" - level"))


def status_history(spark, folder) -> DataFrame:
    days = F.datediff("first_r", "l_shipdate")
    inverse = F.when(F.col("first_r").isNull(), 0.0).when(F.col("l_shipdate") < F.col("first_r"), 1.0 / (1 + days))
    return lines(spark, folder, "l_returnflag", *LINE_TIES).select(
        F.col("l_orderkey").alias("reference_id"),
        "seconds_since_case_start",
        severity().alias("severity"),
        F.when(F.col("l_returnflag") == "R", "Y").otherwise("N").alias("is_escalate"),
        inverse.alias(RESPONSE),
        *LINE_TIES,
    )


STATUS_HISTORY = """csh AS (
  SELECT l.l_orderkey AS reference_id, date_sub('second', first_ship, l_shipdate) AS seconds_since_case_start,
    (1 + l_linenumber % 4) || ' - level' AS severity,
    CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS is_escalate,
    CASE WHEN first_r IS NULL THEN 0.0::DOUBLE
         WHEN l_shipdate < first_r THEN 1.0::DOUBLE / (1 + date_diff('day', l_shipdate, first_r)) END
      AS inverse_time_to_next_escalation,
    l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem l JOIN (
    SELECT l_orderkey, min(l_shipdate) AS first_ship,
      min(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS first_r
    FROM lineitem GROUP BY l_orderkey) s ON l.l_orderkey = s.l_orderkey)"""


def milestones(spark, folder, line: DataFrame | None = None) -> DataFrame:
    """``line``: some of the rows of :func:`lines`, all unless given."""
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("milestone_description"),
        F.col("p_type").alias("note_description"), F.col("p_brand").alias("created_by"),
    )
    line = lines(spark, folder, *LINE_TIES) if line is None else line
    joined = lookup_join(line, part, "l_partkey", hot=hot(spark, folder, "lineitem", "l_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("reference_id"), "seconds_since_case_start",
        F.col("l_linenumber").alias("milestone_id"), "milestone_description", "note_description", "created_by",
        F.col("l_suppkey").alias("updated_by"), *LINE_TIES[1:],
    )


MILESTONE_ROWS = """milestones AS (
  SELECT reference_id, seconds_since_case_start, l_linenumber AS milestone_id, p_name AS milestone_description,
    p_type AS note_description, p_brand AS created_by, l_suppkey AS updated_by,
    l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM csh JOIN part ON l_partkey = p_partkey)"""


def decisions(spark, folder) -> DataFrame:
    """Escalated cases up to the row before the escalation, the others up to their last row."""
    events = status_history(spark, folder)
    windows = event_window(events, HISTORY, F.col("is_escalate") == "Y")
    positives = positive_targets(events, windows, HISTORY, RESPONSE, hot(spark, folder, "lineitem", "l_orderkey"))
    ends = events.groupBy("reference_id").agg(F.max("seconds_since_case_start").alias("decision_time"))
    others = ends.join(windows.select("reference_id"), "reference_id", "left_anti")
    return union_all([positives.select("reference_id", "decision_time"), others])


WINDOWS = """windows AS (
  SELECT reference_id, min(seconds_since_case_start) AS escalation_start, max(seconds_since_case_start) AS case_end
  FROM csh WHERE is_escalate = 'Y' GROUP BY reference_id)"""
POSITIVES = """positives AS (
  SELECT c.reference_id, max(seconds_since_case_start) AS decision_time,
    max(inverse_time_to_next_escalation) AS response
  FROM csh c JOIN windows w ON c.reference_id = w.reference_id
  WHERE seconds_since_case_start < escalation_start GROUP BY c.reference_id)"""
DECISIONS = """decisions AS (
  SELECT reference_id, decision_time FROM positives
  UNION ALL
  SELECT reference_id, max(seconds_since_case_start) FROM csh
  WHERE reference_id NOT IN (SELECT reference_id FROM windows) GROUP BY reference_id)"""


def positive_cases(spark, folder) -> DataFrame:
    """Cases with a positive response."""
    returned = table(spark, folder, "lineitem").filter(F.col("l_returnflag") == "R")
    return returned.select(F.col("l_orderkey").alias("reference_id")).distinct()


POSITIVE_CASES = """positive_cases AS (
  SELECT DISTINCT l_orderkey AS reference_id FROM lineitem WHERE l_returnflag = 'R')"""


def scoring(events: DataFrame) -> DataFrame:
    """The cases to score: a fifth of all, by hash, at their last time."""
    chosen = events.filter(hash_bucket("reference_id", 5, 99) == 0)
    return chosen.groupBy("reference_id").agg(F.max("seconds_since_case_start").alias("seconds_since_case_start"))


def bucket_sql(column: str, k, salt) -> str:
    return f"(('0x' || substr(md5('{salt}:' || {column}), 1, 8))::BIGINT % {k})"


SCORING = f"""scoring AS (
  SELECT reference_id, max(seconds_since_case_start) AS seconds_since_case_start FROM csh
  WHERE {bucket_sql('reference_id', 5, 99)} = 0 GROUP BY reference_id)"""


def comments(spark, folder) -> DataFrame:
    event = table(spark, folder, "events")
    starts = event.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    joined = lookup_join(event, starts, "user_id", hot=hot(spark, folder, "events", "user_id"))
    return joined.select(
        F.col("user_id").alias("reference_id"), seconds_between("first_ts", "ts").alias("seconds_since_case_start"),
        F.col("event_type").alias("comment_type"), F.col("props").alias("notes"),
        F.floor(F.col("value") / 10).cast("int").alias("global_id"), F.col("event_type").alias("created_by"),
        "event_id", "value",
    )


COMMENT_TYPES = ("click", "error", "purchase", "signup", "view")
COMMENT_ROWS = """comments AS (
  SELECT e.user_id AS reference_id, date_sub('second', first_ts, ts) AS seconds_since_case_start,
    event_type AS comment_type, props AS notes, floor(value / 10)::INTEGER AS global_id, event_type AS created_by,
    event_id, value
  FROM events e JOIN (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id) s ON e.user_id = s.user_id)"""


def comment_escalations(events: DataFrame) -> DataFrame:
    return event_window(events, COMMENTS, (F.col("comment_type") == "error") & (F.col("value") >= 150))


COMMENT_WINDOWS = """comment_windows AS (
  SELECT reference_id, min(seconds_since_case_start) AS escalation_start FROM comments
  WHERE comment_type = 'error' AND value >= 150 GROUP BY reference_id)"""


def metadata(spark, folder) -> DataFrame:
    customer = table(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
    orders = table(spark, folder, "orders")
    joined = lookup_join(orders, customer, "o_custkey", hot=hot(spark, folder, "orders", "o_custkey"))
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = joined.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("o_orderkey").alias("reference_id"), F.col("o_custkey").alias("site_code"),
        F.col("n_name").alias("country"), F.col("r_name").alias("branch_code"),
        F.col("o_orderpriority").alias("primary_product_id"), F.col("o_orderstatus").alias("customer_phase"),
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("initial_user_group_id"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("premium_code"),
        F.nullif(F.col("n_regionkey"), F.lit(0)).alias("cloud"),
        (F.col("o_custkey") % 97).alias("company_id"), F.date_format("o_orderdate", "yyyy-MM").alias("med_project_area"),
        F.floor(F.col("o_totalprice") / 20000).cast("int").alias("med_project_open_by"),
        F.concat_ws("/", "c_mktsegment", "n_name").alias("site_company_id"), (F.col("o_custkey") % 31).alias("agent_id"),
    )


METADATA = """metadata AS (
  SELECT o_orderkey AS reference_id, o_custkey AS site_code, n_name AS country, r_name AS branch_code,
    o_orderpriority AS primary_product_id, o_orderstatus AS customer_phase,
    nullif(c_mktsegment, 'HOUSEHOLD') AS initial_user_group_id,
    try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS premium_code, nullif(n_regionkey, 0) AS cloud,
    o_custkey % 97 AS company_id, strftime(o_orderdate, '%Y-%m') AS med_project_area,
    floor(o_totalprice / 20000)::INTEGER AS med_project_open_by, c_mktsegment || '/' || n_name AS site_company_id,
    o_custkey % 31 AS agent_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""


def classified(spark, folder, score: str = "a") -> DataFrame:
    """Scores of two classifiers for "the line was returned"; the first one has heavy ties."""
    predicted = {"a": F.round(F.col("l_discount") + F.col("l_tax"), 4), "b": F.col("l_quantity") / 51}[score]
    return table(spark, folder, "lineitem").select(
        predicted.alias("predicted"), (F.col("l_returnflag") == "R").cast("int").alias("observed"),
        "l_orderkey", *LINE_TIES,
    )


def classified_sql(name: str = "scored", score: str = "a") -> str:
    predicted = {"a": "round(l_discount + l_tax, 4)", "b": "l_quantity / 51"}[score]
    return f"""{name} AS (
  SELECT {predicted} AS predicted, (l_returnflag = 'R')::INTEGER AS observed, l_orderkey, {', '.join(LINE_TIES)}
  FROM lineitem)"""


def priced(spark, folder) -> DataFrame:
    """A regression: the price of a line from its quantity."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_quantity") * 1500).alias("predicted"), F.col("l_extendedprice").alias("observed"), "l_orderkey",
        *LINE_TIES,
    )


PRICED = f"""scored AS (
  SELECT l_quantity * 1500 AS predicted, l_extendedprice AS observed, l_orderkey, {', '.join(LINE_TIES)}
  FROM lineitem)"""


def points(spark, folder, name: str = "customer", key: str = "c_custkey") -> DataFrame:
    k = F.col(key)
    latitude = F.when(k % 50 != 0, -80 + (k * 37 % 16000) / 100.0)
    return table(spark, folder, name).select(
        k.alias("id"), latitude.alias("latitude"), (-175 + (k * 91 % 35000) / 100.0).alias("longitude")
    )


def points_sql(alias: str, name: str = "customer", key: str = "c_custkey") -> str:
    return f"""{alias} AS (
  SELECT {key} AS id, CASE WHEN {key} % 50 <> 0 THEN -80 + ({key} * 37 % 16000) / 100.0::DOUBLE END AS latitude,
    -175 + ({key} * 91 % 35000) / 100.0::DOUBLE AS longitude FROM {name})"""
