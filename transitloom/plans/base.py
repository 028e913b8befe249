"""Registering queries with their SQL twins, and rounding at a query's edge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import round_half_up

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(made: Query) -> Query:
        QUERIES[name] = made
        if sql:
            ORACLES[name] = sql
        return made

    return keep


def r6(x: Column | str, alias: str | None = None) -> Column:
    """Six decimals, half up: both engines' sums agree to there."""
    column = F.col(x) if isinstance(x, str) else x
    return round_half_up(column, 6).alias(alias or (x if isinstance(x, str) else "value"))


def s6(x: str) -> str:
    return f"floor(({x}) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE"


def half_up(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits}::DOUBLE + 0.5::DOUBLE) / {10**digits}::DOUBLE"


def hav_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: str = "6371.0088") -> str:
    return f"(2 * {radius}::DOUBLE * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


LOCAL = "(time_ms + 28800000)"
DAY = f"({LOCAL} // 86400000)"
MS_OF_DAY = f"({LOCAL} % 86400000)"
HOUR = f"({MS_OF_DAY} // 3600000)"
FRAC_HOUR = f"({HOUR} + (({MS_OF_DAY} // 60000) % 60) / 60::DOUBLE)"
X_SCALE = "6371000::DOUBLE * pi() / 180 * cos(radians(3.139::DOUBLE))"
Y_SCALE = "6371000::DOUBLE * pi() / 180"
STEP = "(200::DOUBLE / 111000::DOUBLE)"
