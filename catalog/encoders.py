"""Categorical encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.text import words
from casebook.operators import encode
from casebook.operators.folds import assign
from catalog.fixtures import COMMENT_TYPES, METADATA, POSITIVE_CASES, bucket_sql, metadata, positive_cases
from catalog.registry import query, rounded, table, with_


def labels_sql(c: str, source: str) -> str:
    return (f"SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {c}) AS code FROM {source} "
            f"WHERE {c} IS NOT NULL GROUP BY {c}")


@query(with_("e AS (SELECT event_id, nullif(event_type, 'error') AS event_type FROM events)",
             f"codes AS ({labels_sql('event_type', 'e')})", select="""
SELECT event_id, e.event_type, code AS label_encoded_event_type
FROM e LEFT JOIN codes ON e.event_type = codes.event_type"""))
def label_encode(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"))
    return encode.label_encode(events, "event_type")


@query(with_("w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents)",
             select=labels_sql("word", "w").replace("AS code", "AS label_encoded_word")))
def label_table_words(spark, folder):
    terms = table(spark, folder, "documents").select(F.explode(words("text")).alias("word"))
    return encode.label_table(terms, "word")


@query("SELECT event_id, " + ", ".join(
    f"CASE WHEN nullif(event_type, 'error') = '{v}' THEN 1 ELSE 0 END AS one_hot_encoded_event_type_is_{v}"
    for v in COMMENT_TYPES) + " FROM events")
def one_hot(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"))
    return encode.one_hot(events, "event_type", COMMENT_TYPES).drop("event_type")


def _returns(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate",
        (F.col("l_returnflag") == "R").cast("int").alias("response"))


RETURNS = """returns AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_shipdate,
  (l_returnflag = 'R')::INTEGER AS response FROM lineitem)"""


@query(with_(RETURNS, select="""
SELECT returns.*, round(mean, 6) AS mean_response_rate_l_partkey FROM returns
JOIN (SELECT l_partkey, avg(response) AS mean FROM returns GROUP BY l_partkey) t USING (l_partkey)"""))
def target_encode(spark, folder):
    return rounded(encode.target_encode(_returns(spark, folder), "l_partkey", "response"))


@query(with_(RETURNS, f"""folded AS (
  SELECT *, {bucket_sql('l_orderkey', 5, 39)}::INTEGER AS cross_validation_fold_0 FROM returns)""", """
parts AS (SELECT l_partkey, cross_validation_fold_0, sum(response) AS s, count(*) AS n FROM folded GROUP BY ALL)""",
             """others AS (SELECT a.l_partkey, a.cross_validation_fold_0,
  sum(b.s) FILTER (b.cross_validation_fold_0 <> a.cross_validation_fold_0)
    / sum(b.n) FILTER (b.cross_validation_fold_0 <> a.cross_validation_fold_0) AS mean
FROM parts a JOIN parts b ON a.l_partkey = b.l_partkey GROUP BY ALL)""", select="""
SELECT folded.*, round(mean, 6) AS mean_response_rate_l_partkey
FROM folded JOIN others USING (l_partkey, cross_validation_fold_0)"""))
def target_encode_oof(spark, folder):
    folded = assign(_returns(spark, folder), "l_orderkey", 5, {"cross_validation_fold_0": 39})
    return rounded(encode.target_encode(folded, "l_partkey", "response", "cross_validation_fold_0"))


@query(with_(METADATA, POSITIVE_CASES, """pos AS (
  SELECT * FROM metadata WHERE reference_id IN (SELECT reference_id FROM positive_cases))""", select="""
SELECT reference_id, (coalesce(site_code IN (SELECT site_code FROM pos), false))::INTEGER
    AS is_in_escalated_site_code,
  (initial_user_group_id IS NOT NULL
    AND initial_user_group_id IN (SELECT initial_user_group_id FROM pos WHERE initial_user_group_id IS NOT NULL))
    ::INTEGER AS is_in_escalated_initial_user_group_id
FROM metadata"""))
def membership_flags(spark, folder):
    columns = ["site_code", "initial_user_group_id"]
    cases = metadata(spark, folder).select("reference_id", *columns)
    positives = cases.join(positive_cases(spark, folder), "reference_id", "left_semi")
    return encode.membership_flags(cases, positives, columns).drop(*columns)


@query("""SELECT p_partkey, (p_size = 7)::INTEGER AS is_dummy_7_p_size,
  coalesce(try_cast(p_name AS BIGINT) = 7, false)::INTEGER AS is_dummy_7_p_name FROM part""")
def sentinel_flags(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_name")
    return encode.sentinel_flags(part, ["p_size", "p_name"], 7).drop("p_size", "p_name")
