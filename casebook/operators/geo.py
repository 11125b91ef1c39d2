"""Points on the earth."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.geography import EARTH_RADIUS_KM, bearing_degrees, geohash, haversine_km
from casebook.operators import sizing
from casebook.operators.sizing import pair_join, shuffle_partitions


def with_distance(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, name: str = "distance_km") -> DataFrame:
    """Add the great-circle distance in km."""
    return df.withColumn(name, haversine_km(lat1, lon1, lat2, lon2))


def with_bearing(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, name: str = "bearing") -> DataFrame:
    """Add the compass bearing in degrees."""
    return df.withColumn(name, bearing_degrees(lat1, lon1, lat2, lon2))


def cell_counts(df: DataFrame, lat: str, lon: str, precision: int = 5) -> DataFrame:
    """Points per geohash cell; points without a position are left out."""
    placed = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return placed.groupBy(geohash(lat, lon, precision).alias("cell")).agg(F.count("*").alias("n"))


def within_distance(left: DataFrame, right: DataFrame, km: float, left_id: str, right_id: str,
                    lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Pairs of a left and a right point at most ``km`` apart, with their distance.

    Points meet in cells: latitude bands at least ``km`` high, each cut into whole numbers of columns at least ``km``
    wide at the band's narrowest parallel. A left point looks in its own and the neighbouring bands and columns (around
    the date line too), so each pair meets exactly once, in the cell of the right point. A small right table is
    broadcast. The left points are spread over all shuffle partitions first: the pairs grow with the product of the
    tables, which a left table of one file would leave to one task.
    """
    height = max(km / EARTH_RADIUS_KM * 180 / 3.141592653589793 * 1.000001, 1e-6)
    top = int(180 / height)

    def band(latitude: Column) -> Column:
        return F.floor((latitude + 90) / height).cast("long")

    def n_columns(b: Column) -> Column:
        # A circle of radius r around latitude p reaches asin(sin r / cos p) to either side. Points of this band are
        # looked for from one band further out, and the circle is widest for the p nearest to a pole.
        south, north = b * height - 90 - height, (b + 1) * height - 90 + height
        reach = F.greatest(F.abs(south), F.abs(north))
        sine = F.sin(F.radians(F.lit(height))) / F.cos(F.radians(reach))
        half = F.degrees(F.asin(sine))
        return F.when((reach + height >= 90) | (sine >= 1), F.lit(1).cast("long")).otherwise(
            F.greatest(F.floor(360 / half).cast("long"), F.lit(1).cast("long")))

    def strip(longitude: Column, n: Column) -> Column:
        return F.least(F.floor(F.pmod(longitude + 180, F.lit(360.0)) / 360 * n).cast("long"), n - 1)

    def placed(df, *columns):
        return df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*columns)

    def with_vector(df, side):
        phi, theta = F.radians(f"lat{side}"), F.radians(f"lon{side}")
        return df.withColumns({f"_x{side}": F.cos(phi) * F.cos(theta), f"_y{side}": F.cos(phi) * F.sin(theta),
                               f"_z{side}": F.sin(phi)})

    own_band = band(F.col("lat2"))
    right = placed(right, F.col(right_id), F.col(lat).alias("lat2"), F.col(lon).alias("lon2"))
    right = with_vector(right, 2).withColumn("_band", own_band).withColumn("_strip", strip(F.col("lon2"), n_columns(F.col("_band"))))
    left = placed(left, F.col(left_id), F.col(lat).alias("lat1"), F.col(lon).alias("lon1"))
    left = with_vector(left, 1).repartition(shuffle_partitions(left))
    b = band(F.col("lat1"))
    left = left.withColumn("_band", F.explode(F.array_distinct(F.array(*[
        F.greatest(F.least(b + d, F.lit(top).cast("long")), F.lit(0).cast("long")) for d in (-1, 0, 1)]))))
    n = n_columns(F.col("_band"))
    s = strip(F.col("lon1"), n)
    left = left.withColumn("_strip", F.explode(F.array_distinct(F.array(*[F.pmod(s + d, n) for d in (-1, 0, 1)]))))
    cell = ["_band", "_strip"]
    small = right.limit(sizing.BROADCAST_ROWS + 1).count() <= sizing.BROADCAST_ROWS
    pairs = left.join(F.broadcast(right), cell) if small else pair_join(left, right, cell)
    # Most points of neighbouring cells are too far apart: the product of the unit vectors tells it without a sine.
    product = reduce(lambda a, b: a + b, [F.col(f"_{x}1") * F.col(f"_{x}2") for x in "xyz"])
    pairs = pairs.filter(product >= math.cos(min(math.radians(height), math.pi)) - 1e-12)
    return (
        pairs.withColumn("distance_km", haversine_km("lat1", "lon1", "lat2", "lon2"))
        .filter(F.col("distance_km") <= km)
        .select(left_id, right_id, "distance_km")
    )
