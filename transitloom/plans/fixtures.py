"""Telemetry tables derived from the given ones, as DataFrames and as DuckDB CTEs.

Each SQL text is one or more CTEs ("name AS (...)") over the registered views; the DataFrame
of the same name has the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id AS u", "ts", "event_type", "value", "CAST(get_json_object(props, '$.k') AS INT) AS k", "unix_micros(CAST(ts AS TIMESTAMP)) div 1000 AS t"
    )


EVENTS_SQL = "ev AS (SELECT event_id, user_id AS u, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS t FROM events)"
_SPARSE = [
    "'B' || u AS bus_id",
    "CASE WHEN u % 11 = 0 THEN 'Unknown' ELSE 'R' || (u % 10) END AS route",
    "2.95D + (u % 20) * 0.01D + k * 0.0004D + CASE WHEN event_id % 29 = 0 THEN 0.05D ELSE 0.0D END AS lat",
    "101.5D + (u % 16) * 0.02D + ((k * 7) % 100) * 0.0004D AS lon",
    "floor(value * 10 + 0.5D) / 10 AS speed",
]


def _duck(text: str) -> str:
    """Spark's double literals as DuckDB casts."""
    import re

    return re.sub(r"(\d+\.\d+)D", r"\1::DOUBLE", text)


def pos_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("event_id", "t AS time_ms", "u", "k", *_SPARSE)


POS_SPARSE = f"{EVENTS_SQL}, pos AS (SELECT event_id, t AS time_ms, u, k, {_duck(', '.join(_SPARSE))} FROM ev)"

_DENSE = [
    "'B' || u AS bus_id",
    "CASE WHEN u % 11 = 0 THEN 'Unknown' ELSE 'R' || (u % 10) END AS route",
    "3.05D + (u % 10) * 0.01D + rn * (1 + u % 3) * 0.0004D + (k - 50) * 0.00002D + CASE WHEN event_id % 29 = 0 THEN 0.03D ELSE 0.0D END AS lat",
    "101.6D + (u % 10) * 0.01D + rn * (1 + u % 3) * 0.0003D + ((k * 7) % 100 - 50) * 0.00002D AS lon",
    "floor(value * 10 + 0.5D) / 10 AS speed",
    "1704060000000 + rn * CASE u % 3 WHEN 0 THEN 5000 WHEN 1 THEN 15000 ELSE 30000 END AS time_ms",
    "CAST(rn AS BIGINT) AS tick_id",
]


def pos_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = _events(spark, sf_dir).selectExpr("*", "row_number() OVER (PARTITION BY u ORDER BY ts, event_id) AS rn")
    return numbered.filter("event_id % 17 <> 0").selectExpr("event_id", "u", "k", *_DENSE)


POS_DENSE = f"{EVENTS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts, event_id) AS rn FROM ev), pos AS (SELECT event_id, u, k, {_duck(', '.join(_DENSE))} FROM numbered WHERE event_id % 17 <> 0)"

_LEARN = [
    "'B' || b AS bus_id",
    "'Unknown' AS route",
    "t AS time_ms",
    "3.05D + slot * 0.002D + k * CASE WHEN b % 3 = 0 THEN 0.00001D ELSE 0.0004D END AS lat",
    "101.6D + slot * 0.001D + ((k * 7) % 100) * CASE WHEN b % 3 = 0 THEN 0.00001D ELSE 0.0004D END AS lon",
]
_LEARN_RULE = "(b <> 13 OR day_no <= 19724) AND (b <> 14 OR event_id % 10 = 0)"


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("*", "u % 15 AS b", "(t + 28800000) div 86400000 AS day_no", "((t + 28800000) div 1800000) % 48 AS slot")


def pos_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).filter(_LEARN_RULE).selectExpr("event_id", "b", "day_no", "slot", *_LEARN)


def pos_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of pos_sparse and those of pos_learn, as other buses under other ids: an event is parsed once for both."""
    bus, route, *place = _SPARSE[:4]
    rider = f"struct(event_id * 2 AS event_id, {bus}, {route}, t AS time_ms, {', '.join(place)})"
    learner = f"struct(event_id * 2 + 1 AS event_id, 'L' || {', '.join(_LEARN)})"
    return _slots(spark, sf_dir).selectExpr(f"inline(CASE WHEN {_LEARN_RULE} THEN array({rider}, {learner}) ELSE array({rider}) END)")


POS_LEARN = f"{EVENTS_SQL}, slots AS (SELECT *, u % 15 AS b, (t + 28800000) // 86400000 AS day_no, ((t + 28800000) // 1800000) % 48 AS slot FROM ev), pos AS (SELECT event_id, b, day_no, slot, {_duck(', '.join(_LEARN))} FROM slots WHERE {_LEARN_RULE})"

_SHAPES = [
    "'S' || (r + 10 * v) AS shape_id",
    "'R' || r AS route",
    "CASE v WHEN 0 THEN q ELSE 99 - q END AS seq",
    "3.05D + r * 0.01D + q * 0.0016D + v * 0.0003D AS lat",
    "101.6D + r * 0.01D + q * 0.0012D + (q % 3 - 1) * 0.0004D AS lon",
]


def shapes(spark: SparkSession) -> DataFrame:
    grid = spark.range(2000).selectExpr("CAST(id div 200 AS INT) AS r", "CAST((id div 100) % 2 AS INT) AS v", "CAST(id % 100 AS INT) AS q")
    return grid.selectExpr(*_SHAPES)


SHAPES = f"shapes AS (SELECT {_duck(', '.join(_SHAPES))} FROM (SELECT CAST(id // 200 AS INT) AS r, CAST((id // 100) % 2 AS INT) AS v, CAST(id % 100 AS INT) AS q FROM range(2000) AS g(id)))"

_TRIPS = ["'T' || o_orderkey AS trip_id", "'R' || (o_orderkey % 12) AS route_id", "'S' || (o_orderkey % 10 + 10 * (o_custkey % 2)) AS shape_id", "CAST(o_custkey % 2 AS STRING) AS direction_id", "upper(o_orderpriority) AS trip_headsign"]


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_TRIPS)


TRIPS = f"trips AS (SELECT {', '.join(_TRIPS).replace('STRING', 'VARCHAR')} FROM orders)"


def routes(spark: SparkSession) -> DataFrame:
    """Ten routes: long and short names, a bare code, or neither, by number."""
    return spark.range(10).selectExpr("'R' || id AS route_id", "CASE WHEN id % 4 = 3 THEN '' ELSE 'T' || (100 + id) END AS route_short_name", "CASE id % 4 WHEN 0 THEN 'Line ' || id WHEN 3 THEN 'Loop ' || id ELSE '' END AS route_long_name")


ROUTES = "routes AS (SELECT 'R' || id AS route_id, CASE WHEN id % 4 = 3 THEN '' ELSE 'T' || (100 + id) END AS route_short_name, CASE id % 4 WHEN 0 THEN 'Line ' || id WHEN 3 THEN 'Loop ' || id ELSE '' END AS route_long_name FROM range(10) AS g(id))"


def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("event_id div 14 AS sweep_id", "CAST(event_id % 14 AS INT) AS source_idx", "CASE WHEN k < 15 THEN 0 WHEN k < 20 THEN -1 ELSE k END AS vehicles")


SWEEPS = f"{EVENTS_SQL}, sweeps AS (SELECT event_id // 14 AS sweep_id, CAST(event_id % 14 AS INT) AS source_idx, CASE WHEN k < 15 THEN 0 WHEN k < 20 THEN -1 ELSE k END AS vehicles FROM ev)"

_WEATHER = [
    "d AS day_no", "hr", "CAST(24 + (hr * 7 + d * 3) % 12 AS DOUBLE) AS temp",
    "CASE WHEN (hr + d) % 5 = 0 THEN ((hr * d) % 7) * 0.4D ELSE 0.0D END AS precip",
    "CAST((hr * 3 + d) % 25 AS DOUBLE) AS wind", "CASE (hr + d) % 5 WHEN 0 THEN 1183 WHEN 1 THEN 1000 WHEN 2 THEN 1003 WHEN 3 THEN 1063 ELSE 9999 END AS code",
]


def weather(spark: SparkSession) -> DataFrame:
    hours = spark.range(720).selectExpr("CAST(19723 + id div 24 AS INT) AS d", "CAST(id % 24 AS INT) AS hr")
    return hours.filter("(d * 24 + hr) % 37 <> 0").selectExpr(*_WEATHER)


WEATHER = f"weather AS (SELECT {_duck(', '.join(_WEATHER))} FROM (SELECT CAST(19723 + id // 24 AS INT) AS d, CAST(id % 24 AS INT) AS hr FROM range(720) AS g(id)) WHERE (d * 24 + hr) % 37 <> 0)"


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS node_id", "3.05D + (p_partkey div 45) * 0.001D AS lat", "101.6D + (p_partkey % 45) * 0.001D AS lon")


ROAD_NODES = "road_nodes AS (SELECT p_partkey AS node_id, 3.05::DOUBLE + (p_partkey // 45) * 0.001::DOUBLE AS lat, 101.6::DOUBLE + (p_partkey % 45) * 0.001::DOUBLE AS lon FROM part)"


def road_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("way_id"),
        F.expr("transform(sequence(0, 19), i -> s_suppkey * 17 + i)").alias("nodes"),
        F.expr("element_at(array('motorway', 'primary', 'residential', 'track', 'tertiary'), CAST(s_suppkey % 5 AS INT) + 1)").alias("highway"),
        F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' END").alias("oneway"),
        F.lit(None).cast("string").alias("junction"),
    )


ROAD_WAYS = "road_ways AS (SELECT s_suppkey AS way_id, [s_suppkey * 17 + i for i in range(20)] AS nodes, (['motorway', 'primary', 'residential', 'track', 'tertiary'])[CAST(s_suppkey % 5 AS INT) + 1] AS highway, CASE s_suppkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' END AS oneway, CAST(NULL AS VARCHAR) AS junction FROM supplier)"
