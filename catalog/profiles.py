"""Table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.operators import clean, profile
from catalog.registry import query, rounded, table, with_


def _orders(spark, folder):
    return table(spark, folder, "orders").withColumn(
        "o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH")))


ORDERS = "ord AS (SELECT * REPLACE (nullif(o_orderpriority, '2-HIGH') AS o_orderpriority) FROM orders)"
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _null_rows(columns, by=""):
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}count(*) AS count_in_group, '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c})) / count(*), 6) AS percent_of_group_null FROM ord{group}" for c in columns)


@query(with_(ORDERS, select="SELECT *, 'orders' AS table_name FROM (" + _null_rows(ORDER_COLUMNS) + ")"))
def null_summary(spark, folder):
    return rounded(profile.null_summary(_orders(spark, folder), ORDER_COLUMNS, table_name="orders"))


@query(with_(ORDERS, select=_null_rows(("o_custkey", "o_orderpriority"), "o_orderstatus")))
def null_summary_grouped(spark, folder):
    return rounded(profile.null_summary(_orders(spark, folder), ["o_custkey", "o_orderpriority"], ["o_orderstatus"]))


@query("""SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def melt_numeric(spark, folder):
    return profile.melt(table(spark, folder, "part"), ["p_size", "p_retailprice"], ["p_partkey"])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS "count", round(sum(l_quantity), 2) AS sum_l_quantity,
  round(count(*) / (SELECT count(*) FROM lineitem), 6) AS count_percentage,
  round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 6) AS l_quantity_percentage
FROM lineitem GROUP BY ALL""")
def distribution(spark, folder):
    line = table(spark, folder, "lineitem")
    return rounded(profile.distribution(line, ["l_returnflag", "l_linestatus"], "l_quantity"), {"sum_l_quantity": 2})


@query(with_("""d AS (SELECT l_returnflag AS categorical_value, count(*)::DOUBLE AS c, sum(l_quantity) AS s,
  count(*) / (SELECT count(*) FROM lineitem) AS cp, sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem) AS sp
FROM lineitem GROUP BY l_returnflag)""", select="""
SELECT categorical_value, statistic, round(v, 4) AS statistic_value, 'l_returnflag' AS categorical,
  'lineitem' AS table_name
FROM (SELECT categorical_value, 'count' AS statistic, c AS v FROM d
  UNION ALL SELECT categorical_value, 'sum_l_quantity', s FROM d
  UNION ALL SELECT categorical_value, 'count_percentage', cp FROM d
  UNION ALL SELECT categorical_value, 'l_quantity_percentage', sp FROM d)"""))
def long_distribution(spark, folder):
    line = table(spark, folder, "lineitem")
    return rounded(profile.long_distribution(line, "l_returnflag", "l_quantity", table_name="lineitem"), 4)


UNIQUE_COLUMNS = ("c_custkey", "c_nationkey", "c_mktsegment")


@query(" UNION ALL ".join(
    f"SELECT 'count_unique_{c}' AS \"column\", count(DISTINCT {c})::DOUBLE AS unique_count, 'count' AS type "
    "FROM customer"
    f" UNION ALL SELECT 'percent_unique_{c}', round(count(DISTINCT {c}) / count({c}), 6), 'percent' FROM customer"
    for c in UNIQUE_COLUMNS))
def unique_summary(spark, folder):
    return rounded(profile.unique_summary(table(spark, folder, "customer"), UNIQUE_COLUMNS, include_percent=True))


SUMMARY_COLUMNS = ("l_quantity", "l_extendedprice")


@query(" UNION ALL ".join(
    f"SELECT l_returnflag, '{s}_{c}' AS statistic, round(({f.format(c)})::DOUBLE, 3) AS statistic_value"
    " FROM lineitem GROUP BY l_returnflag"
    for s, f in (("min", "min({})"), ("average", "avg({})"), ("stddev", "stddev_samp({})"), ("max", "max({})"),
                 ("sum", "sum({})"), ("count", "count({})"))
    for c in SUMMARY_COLUMNS))
def numeric_summary(spark, folder):
    return rounded(profile.numeric_summary(table(spark, folder, "lineitem"), SUMMARY_COLUMNS, ["l_returnflag"]), 3)


@query(" UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS \"column\", {p}::DOUBLE AS percentile, quantile_disc({c}, {p})::DOUBLE AS value"
    " FROM lineitem GROUP BY l_returnflag" for c in SUMMARY_COLUMNS for p in (0.25, 0.5, 0.9)))
def percentiles(spark, folder):
    line = table(spark, folder, "lineitem")
    return profile.percentiles(line, SUMMARY_COLUMNS, [0.25, 0.5, 0.9], ["l_returnflag"], accuracy=1_000_000)


@query("""SELECT event_type, user_id, count(*) AS "count" FROM events GROUP BY ALL
ORDER BY "count" DESC, event_type, user_id LIMIT 10""")
def value_counts_topk(spark, folder):
    counts = profile.value_counts(table(spark, folder, "events"), ["event_type", "user_id"])
    return profile.top_k(counts, 10, F.desc("count"), "event_type", "user_id")


@query("""SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys,
  count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_repeats FROM lineitem""")
def key_check(spark, folder):
    return profile.key_check(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT round(avg(l_quantity), 6) AS average_l_quantity, round(avg(l_tax), 6) AS average_l_tax
FROM lineitem""")
def global_means(spark, folder):
    return rounded(profile.global_means(table(spark, folder, "lineitem"), ["l_quantity", "l_tax"]))


@query("""SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def union_all(spark, folder):
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return clean.union_all([customer, supplier])


@query("""SELECT o_orderkey AS order_id, lower(o_orderpriority) AS priority, try_cast(substr(o_orderpriority, 1, 1) AS
  INTEGER) AS level, CASE WHEN o_custkey % 100 = 0 THEN NULL ELSE round(1.0::DOUBLE / (o_custkey % 100), 8) END AS
  inverse, (nullif(o_orderpriority, '2-HIGH') IS NOT NULL)::INTEGER AS has_priority,
  CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END AS is_open,
  coalesce(nullif(o_orderpriority, '2-HIGH'), 'none') AS filled,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS not_urgent
FROM orders""")
def clean_columns(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus")
    orders = orders.withColumns({
        "level": F.substring("o_orderpriority", 1, 1),
        "inverse": F.round(clean.reciprocal(F.col("o_custkey") % 100), 8),
        "filled": clean.null_if("o_orderpriority", "2-HIGH"),
        "is_open": clean.parse_flag("o_orderstatus", "O", "F"),
        "not_urgent": clean.null_if("o_orderpriority", "1-URGENT"),
    })
    orders = orders.withColumn("has_priority", clean.flag("filled")).drop("o_custkey", "o_orderstatus")
    orders = clean.rename_columns(orders, {"o_orderkey": "order_id", "o_orderpriority": "priority"})
    return clean.fill_null(clean.cast_columns(clean.normalise_text(orders, ["priority"]), {"level": "int"}),
                           {"filled": "none"})
