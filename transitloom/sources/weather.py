"""Hourly weather: flattening, ranges and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import is_rainy, weather_label
from ..functions.timeparts import day_number, local_hour
from ..runtime import if_small

FIELDS = ["temp", "precip", "wind", "code", "humidity", "uv", "chance_of_rain", "aqi_index", "aqi_pm25"]
MOST_DAYS = 90
_READING = "temp_c DOUBLE, precip_mm DOUBLE, wind_kph DOUBLE, condition STRUCT<code: INT>, humidity DOUBLE, uv DOUBLE, air_quality STRUCT<`us-epa-index`: INT, pm2_5: DOUBLE>"
SCHEMA = f"forecast STRUCT<forecastday: ARRAY<STRUCT<date: STRING, hour: ARRAY<STRUCT<time: STRING, chance_of_rain: DOUBLE, {_READING}>>>>>, location STRUCT<localtime: STRING>, current STRUCT<{_READING}>"


def _reading(at: str, rain: Column) -> list[Column]:
    part = {"temp": "temp_c", "precip": "precip_mm", "wind": "wind_kph", "code": "condition.code", "humidity": "humidity", "uv": "uv", "aqi_index": "air_quality.us-epa-index", "aqi_pm25": "air_quality.pm2_5"}
    found = {k: F.col(f"{at}.{v.replace('us-epa-index', '`us-epa-index`')}") for k, v in part.items()}
    return [(rain if k == "chance_of_rain" else found[k]).alias(k) for k in FIELDS]


def flatten_weather(reports: DataFrame, column: str = "json") -> DataFrame:
    """(date, hour, nine fields) of JSON reports; a current reading replaces its hour but keeps the forecast chance of rain."""
    parsed = reports.select(F.from_json(column, SCHEMA).alias("r"))
    days = parsed.select(F.explode("r.forecast.forecastday").alias("d")).select(F.col("d.date").alias("date"), F.explode("d.hour").alias("h"))
    hourly = days.select("date", F.substring("h.time", 12, 2).cast("int").alias("hour"), *_reading("h", F.col("h.chance_of_rain")))
    now = parsed.filter("r.current is not null and r.location.localtime is not null").select(F.substring("r.location.localtime", 1, 10).alias("date"), F.substring("r.location.localtime", 12, 2).cast("int").alias("hour"), *_reading("r.current", F.lit(None).cast("double")))
    rain = hourly.select("date", "hour", F.col("chance_of_rain").alias("_rain"))
    now = now.join(rain, ["date", "hour"], "left").withColumn("chance_of_rain", F.col("_rain")).drop("_rain")
    return hourly.join(now.select("date", "hour"), ["date", "hour"], "left_anti").unionByName(now)


def weather_range(spark: SparkSession, weather: DataFrame, first: int, last: int) -> DataFrame:
    """Every hour of the days from first to last, both included, with its weather, label and rain flag; 90 days at most."""
    if not 0 <= last - first < MOST_DAYS:
        raise ValueError(f"a range has 1 to {MOST_DAYS} days")
    days = spark.range(first, last + 1).select(F.col("id").cast("int").alias("day_no"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hr"))
    return days.join(weather, ["day_no", "hr"], "left").withColumn("label", weather_label(F.col("code"))).withColumn("rainy", is_rainy(F.col("precip"), F.col("code")))


def with_weather(positions: DataFrame, weather: DataFrame, primary: str | None = None) -> DataFrame:
    """Positions with the weather of their local day and hour; null where unknown, or not from the primary feed.

    Weather has 24 rows a day; it is broadcast where its counted rows fit the bound.
    """
    t = F.col("time_ms")
    hours = weather.select(F.col("day_no").alias("_d"), F.col("hr").alias("_h"), *[F.col(c).alias(f"weather_{c}") for c in ("temp", "precip", "wind", "code")])
    match = (F.col("_day") == F.col("_d")) & (F.col("_hour") == F.col("_h"))
    if primary is not None:
        match &= F.col("feed_source") == primary
    keyed = positions.withColumn("_day", day_number(t)).withColumn("_hour", local_hour(t))
    return keyed.join(if_small(hours, 64), match, "left").drop("_day", "_hour", "_d", "_h")
