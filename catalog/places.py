"""Points on the earth."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.geography import GEOHASH_ALPHABET
from casebook.operators import geo
from casebook.operators.sizing import lookup_join
from catalog.fixtures import points, points_sql
from catalog.registry import query, rounded, table, with_

HAVERSINE = """2 * 6371 * atan2(sqrt(h), sqrt(1 - h)) FROM (SELECT *,
  sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2 AS h
"""
PAIRS = """pairs AS (
  SELECT l_orderkey, l_suppkey, c.latitude AS lat1, c.longitude AS lon1, s.latitude AS lat2, s.longitude AS lon2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN c ON o_custkey = c.id JOIN s ON l_suppkey = s.id)"""


def _shipments(spark, folder):
    """Each line with the places of its customer and its supplier."""
    customer = points(spark, folder).toDF("o_custkey", "lat1", "lon1")
    supplier = points(spark, folder, "supplier", "s_suppkey").toDF("l_suppkey", "lat2", "lon2")
    orders = lookup_join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), customer, "o_custkey")
    line = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return lookup_join(lookup_join(line, orders, "o_orderkey"), supplier, "l_suppkey").withColumnRenamed(
        "o_orderkey", "l_orderkey").drop("o_custkey")


@query(with_(points_sql("c"), points_sql("s", "supplier", "s_suppkey"), PAIRS, select=f"""
SELECT l_orderkey, l_suppkey, round({HAVERSINE.replace('FROM', ', 4) AS distance_km FROM', 1)} FROM pairs)"""))
def distance(spark, folder):
    rows = geo.with_distance(_shipments(spark, folder), "lat1", "lon1", "lat2", "lon2")
    return rounded(rows.select("l_orderkey", "l_suppkey", "distance_km"), 4)


@query(with_(points_sql("c"), points_sql("s", "supplier", "s_suppkey"), PAIRS, select="""
SELECT l_orderkey, l_suppkey, round(fmod(degrees(atan2(
    sin(radians(lon2) - radians(lon1)) * cos(radians(lat2)),
    cos(radians(lat1)) * sin(radians(lat2))
      - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1)))) + 360, 360), 4) AS bearing
FROM pairs"""))
def bearing(spark, folder):
    rows = geo.with_bearing(_shipments(spark, folder), "lat1", "lon1", "lat2", "lon2")
    return rounded(rows.select("l_orderkey", "l_suppkey", "bearing"), 4)


@query(with_(points_sql("c"), points_sql("s", "supplier", "s_suppkey"), select=f"""
SELECT customer, supplier, round({HAVERSINE.replace('FROM', ', 4) AS distance_km FROM', 1)} FROM (
  SELECT c.id AS customer, s.id AS supplier, c.latitude AS lat1, c.longitude AS lon1, s.latitude AS lat2,
    s.longitude AS lon2 FROM c, s)) WHERE 2 * 6371 * atan2(sqrt(h), sqrt(1 - h)) <= 500"""))
def within_distance(spark, folder):
    left = points(spark, folder).withColumnRenamed("id", "customer")
    right = points(spark, folder, "supplier", "s_suppkey").withColumnRenamed("id", "supplier")
    return rounded(geo.within_distance(left, right, 500.0, "customer", "supplier"), 4)


def _geohash_sql(precision: int) -> str:
    lon_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    characters = []
    for start in range(0, 5 * precision, 5):
        bits = [f"(({'x' if b % 2 == 0 else 'y'} >> {(lon_bits if b % 2 == 0 else lat_bits) - 1 - b // 2}) & 1)"
                f" * {1 << (4 - b + start)}" for b in range(start, start + 5)]
        characters.append(f"substr('{GEOHASH_ALPHABET}', ({' + '.join(bits)} + 1)::INTEGER, 1)")
    return f"""SELECT {' || '.join(characters)} AS cell, count(*) AS n FROM (
  SELECT floor((longitude + 180) / 360 * {1 << lon_bits})::BIGINT AS x,
    floor((latitude + 90) / 180 * {1 << lat_bits})::BIGINT AS y
  FROM c WHERE latitude IS NOT NULL AND longitude IS NOT NULL) GROUP BY cell"""


@query(with_(points_sql("c"), select=_geohash_sql(3)))
def cell_counts(spark, folder):
    return geo.cell_counts(points(spark, folder), "latitude", "longitude", 3)
