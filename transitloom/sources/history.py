"""Day archives of positions: reading both vintages, cataloguing, compacting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.timeparts import local_date
from .folders import Files

DEFAULT_SOURCE = "rapid-bus-kl"
_DOUBLES = ["lat", "lon", "speed", "speed_corrected", "calculated_speed", "speed_kalman", "weighted_speed", "trust_score", "adj_lat", "adj_lon"]
_WEATHER = ["weather_temp", "weather_precip", "weather_wind"]
POSITION = StructType(
    [StructField("bus_id", StringType()), StructField("route", StringType()), StructField("time", LongType())]
    + [StructField(c, DoubleType()) for c in _DOUBLES]
    + [StructField("snap_shape_id", StringType()), StructField("snap_cumdist", DoubleType())]
    + [StructField(c, DoubleType()) for c in _WEATHER]
    + [StructField("weather_code", IntegerType()), StructField("feed_source", StringType())]
)
#: Old key -> its column.
LEGACY = {"t": "time", "speed_raw": "speed", "speed_calc": "calculated_speed", "speed_trust": "weighted_speed"}
#: Which source of a day wins.
PRIORITY = {"local_parquet": 0, "jsonl": 1, "history_parquet": 2}


def read_ticks_json(spark: SparkSession, path: str | list[str], keep_path: bool = False) -> DataFrame:
    """A JSON-lines archive in either vintage; blank, torn and invalid lines are left out, rows without a position are not.

    With ``keep_path`` each row has the ``path`` of its file.
    """
    old = [StructField(k, LongType() if k == "t" else DoubleType()) for k in LEGACY]
    schema = StructType([*POSITION.fields, *old, StructField("_corrupt", StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    # a record needs to be parsed as a whole before its corruption is known, hence the look at a data column
    if keep_path:
        rows = rows.withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("_ok", F.col("_corrupt").isNull() & F.col("bus_id").isNotNull()).filter("_ok").drop("_ok", "_corrupt")


def finite(c: str) -> Column:
    """The column with NaN and infinities as null."""
    x = F.col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def normalize(rows: DataFrame) -> DataFrame:
    """The current columns: old keys fill missing ones and go; the default source is filled in."""
    for old, new in LEGACY.items():
        if old in rows.columns:
            rows = rows.withColumn(new, F.coalesce(new, old) if new in rows.columns else F.col(old)).drop(old)
    source = F.coalesce("feed_source", F.lit(DEFAULT_SOURCE)) if "feed_source" in rows.columns else F.lit(DEFAULT_SOURCE)
    return rows.withColumn("feed_source", source)


def clean_history(rows: DataFrame) -> DataFrame:
    """Typed history rows: no bus, or neither a raw nor an adjusted position, and the row goes; non-finite numbers are null."""
    for c in [*_DOUBLES, "snap_cumdist"]:
        if c in rows.columns:
            rows = rows.withColumn(c, finite(c))
    pair = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    rows = rows.filter(F.col("bus_id").isNotNull() & (pair("lat", "lon") | pair("adj_lat", "adj_lon")))
    return rows.withColumn("route", F.coalesce("route", F.lit("Unknown"))).withColumn("speed_corrected", F.coalesce("speed_corrected", "speed"))


def empty_positions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POSITION)


def read_history(spark: SparkSession, path: str | list[str], keep_path: bool = False) -> DataFrame:
    """Parquet history by its named columns; missing columns are null, and a file that cannot be read raises an error.

    ``scan.Archive`` finds such files first and reads their days from elsewhere. With
    ``keep_path`` each row has the ``path`` of its file.
    """
    rows = spark.read.option("mergeSchema", "true").parquet(*([path] if isinstance(path, str) else path))
    have = set(rows.columns)
    also = [F.col("_metadata.file_path").alias("path")] if keep_path else []
    picked = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in POSITION.fields if f.name != "time"]
    stamp = dict(rows.dtypes).get("time", "")
    time = F.expr("unix_micros(CAST(time AS TIMESTAMP)) div 1000") if stamp.startswith("timestamp") else F.col("time").cast("long")
    return clean_history(rows.select(*picked, time.alias("time"), *also))


def source_rank(source: Column) -> Column:
    """A source's place in the order of preference; unknown ones come last."""
    rank = F.lit(len(PRIORITY))
    for name, place in PRIORITY.items():
        rank = F.when(source == name, place).otherwise(rank)
    return rank


def day_catalog(listings: DataFrame) -> DataFrame:
    """(day, source, size_bytes, mtime_ms): for each day its best readable source, newest day first.

    A listing that is marked unreadable falls through to the day's next source.
    """
    readable = listings.filter(F.coalesce("readable", F.lit(True))) if "readable" in listings.columns else listings
    best = Window.partitionBy("day").orderBy(source_rank(F.col("source")), F.desc("mtime_ms"))
    return readable.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k").select("day", "source", "size_bytes", "mtime_ms").orderBy(F.desc("day"))


def store_stats(catalog: DataFrame) -> DataFrame:
    """(days, bytes, jsonl_days, parquet_days, newest)."""
    json = F.col("source") == "jsonl"
    return catalog.agg(F.count("*").alias("days"), F.sum("size_bytes").alias("bytes"), F.count_if(json).alias("jsonl_days"), F.count_if(~json).alias("parquet_days"), F.max("day").alias("newest"))


def typed(rows: DataFrame) -> DataFrame:
    """Loose rows coerced for Parquet: what is no number is null, ids are text, the route has a default, times and codes are whole."""
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    real = lambda c: F.when(~F.isnan(number(c)) & (F.abs(number(c)) != float("inf")), number(c)).alias(c)
    whole = lambda c: F.floor(number(c) + 0.5)
    route = F.when(F.coalesce("route", F.lit("")) == "", "Unknown").otherwise(F.col("route"))
    columns = [F.coalesce("bus_id", F.lit("")).cast("string").alias("bus_id"), route.cast("string").alias("route"), F.coalesce(whole("time"), F.lit(0)).cast("long").alias("time")]
    columns += [real(c) for c in _DOUBLES] + [F.col("snap_shape_id").cast("string").alias("snap_shape_id"), real("snap_cumdist")] + [real(c) for c in _WEATHER]
    return rows.select(*columns, whole("weather_code").cast("int").alias("weather_code"), F.col("feed_source").cast("string").alias("feed_source"))


def compact_day(spark: SparkSession, source: str, target: str) -> int:
    """Rewrites a JSON-lines day as Parquet and returns its rows, after reading them back; an empty day writes nothing.

    The day goes to a staging folder first and is swapped in by one checked rename, so readers
    never see half of it and a day that stood there before is only removed after that. The
    read-back decodes a column, not footers alone. What fails raises an error and leaves the
    target as it was; the source is left to the caller to remove.
    """
    rows = typed(normalize(read_ticks_json(spark, source)))
    target = target.rstrip("/")
    staged, files = f"{target}.staged", Files(spark, target)
    rows.write.mode("overwrite").parquet(staged)
    wrote, back = rows.count(), spark.read.schema(POSITION).parquet(staged).agg(F.count("bus_id")).first()[0]
    if wrote != back:
        files.remove(staged)
        raise OSError(f"{target}: wrote {wrote} rows, read back {back}")
    if not wrote:
        files.remove(staged)
        return 0
    files.replace(staged, target)
    return wrote


def with_ingest_date(rows: DataFrame, arrival_ms: str = "arrival_ms") -> DataFrame:
    """The partition of a row: the local date of its arrival, whatever the vehicle's clock says."""
    return rows.withColumn("ingest_date", local_date(F.col(arrival_ms)))
