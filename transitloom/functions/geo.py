"""Distances, projections and grids as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three radii in use, and the projection's centre.
EARTH_KM, EARTH_M, EARTH_KM_SHORT = 6371.0088, 6371000.0, 6371.0
CENTRE_LAT, CENTRE_LON = 3.139, 101.6869
M_PER_DEG = EARTH_M * math.pi / 180
COS_CENTRE = math.cos(math.radians(CENTRE_LAT))
#: Metres in a degree as grids count them.
GRID_M_PER_DEG = 111000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the radius's unit; null where a coordinate is."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    inner = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * F.lit(radius) * F.asin(F.sqrt(inner))


def local_x(lon: Column) -> Column:
    return (lon - CENTRE_LON) * F.lit(M_PER_DEG * COS_CENTRE)


def local_y(lat: Column) -> Column:
    return (lat - CENTRE_LAT) * F.lit(M_PER_DEG)


def to_lon(x: Column) -> Column:
    return x / F.lit(M_PER_DEG * COS_CENTRE) + CENTRE_LON


def to_lat(y: Column) -> Column:
    return y / F.lit(M_PER_DEG) + CENTRE_LAT


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^n + 0.5) / 10^n, so -2.5 becomes -2; null and NaN stay null."""
    scale = float(10**digits)
    return F.floor(F.nanvl(x.cast("double"), F.lit(None).cast("double")) * scale + 0.5) / F.lit(scale)


def grid_step(metres: float) -> float:
    return metres / GRID_M_PER_DEG


def grid_cell(degrees: Column, step: float) -> Column:
    return F.floor(degrees / F.lit(step) + 0.5)
