"""Ranks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.operators import rank
from catalog.registry import query, rounded, table


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, rank() OVER (ORDER BY l_extendedprice) AS rank,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS average_rank,
  round(percent_rank() OVER (ORDER BY l_extendedprice), 8) AS percent_rank FROM lineitem""")
def global_percent_rank(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(rank.global_rank(line, "l_extendedprice"), 8)


@query("""SELECT l_returnflag, l_quantity, count(*) AS cnt, sum(count(*)) OVER (ORDER BY -l_quantity, l_returnflag
  ROWS UNBOUNDED PRECEDING)::BIGINT - count(*) AS before, (SELECT count(*) FROM lineitem) AS total
FROM lineitem GROUP BY l_returnflag, l_quantity""")
def rank_table(spark, folder):
    line = table(spark, folder, "lineitem").select((-F.col("l_quantity")).alias("falling"), "l_returnflag")
    ranked = rank.rank_table(line, ["falling", "l_returnflag"])
    return ranked.select("l_returnflag", (-F.col("falling")).alias("l_quantity"), "cnt", "before", "total")
