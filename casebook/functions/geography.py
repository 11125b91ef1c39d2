"""Column expressions on latitudes and longitudes in degrees; a null coordinate gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook.functions.text import column

# The earth radius in km and the geohash alphabet.
EARTH_RADIUS_KM = 6371.0
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    lat1, lon1, lat2, lon2 = (column(c) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # rounding can lift a just over 1 for points opposite each other
    a = F.least(a, F.lit(1.0)) + a * 0
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing_degrees(lat1, lon1, lat2, lon2) -> Column:
    """Initial compass bearing from the first point to the second, in [0, 360)."""
    lat1, lon1, lat2, lon2 = (F.radians(column(c)) for c in (lat1, lon1, lat2, lon2))
    east = F.sin(lon2 - lon1) * F.cos(lat2)
    north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return (F.degrees(F.atan2(east, north)) + 360) % 360


def _scaled(c: Column, low: float, width: float, bits: int) -> Column:
    """Position of a coordinate on a scale of ``2**bits`` equal steps."""
    top = (1 << bits) - 1
    step = F.floor((c - low) / width * (1 << bits)).cast("long")
    return F.when(step > top, F.lit(top)).when(step < 0, F.lit(0)).otherwise(step)


def geohash(lat, lon, precision: int) -> Column:
    """Base-32 cell id: longitude and latitude bits in turn, five bits to a character."""
    n_bits = 5 * precision
    lon_bits, lat_bits = (n_bits + 1) // 2, n_bits // 2
    x = _scaled(column(lon), -180.0, 360.0, lon_bits)
    y = _scaled(column(lat), -90.0, 180.0, lat_bits)
    characters = []
    for start in range(0, n_bits, 5):
        index = F.lit(0)
        for bit in range(start, start + 5):
            source, size = (x, lon_bits) if bit % 2 == 0 else (y, lat_bits)
            value = F.shiftright(source, size - 1 - bit // 2).bitwiseAND(F.lit(1))
            index = index + value * (1 << (4 - bit + start))
        characters.append(F.substring(F.lit(GEOHASH_ALPHABET), (index + 1).cast("int"), F.lit(1)))
    return F.concat(*characters)
