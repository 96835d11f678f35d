"""Distances on the sphere and walking times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
METRES_PER_DEGREE = 111_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def walk_seconds(metres: Column, detour: float, kmh: float) -> Column:
    return F.ceil(metres * F.lit(float(detour)) / F.lit(kmh / 3.6)).cast("int")


def walk_duration(metres: Column, detour: float, kmh: float, least: int) -> Column:
    return F.greatest(F.lit(least), walk_seconds(metres, detour, kmh))


def cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / F.lit(size)).cast("long")


def lon_cell(lon: Column, row: Column, size: float) -> Column:
    """Cell of a longitude; cells widen with the latitude of their row of cells."""
    top = F.least(F.lit(89.9), (F.abs(row) + 2) * size)
    return F.floor(lon / (F.lit(size) / F.cos(F.radians(top)))).cast("long")


def neighbours(c: Column) -> Column:
    """A row for the cell and one for each cell beside it."""
    return F.explode(F.array(c - 1, c, c + 1))
