"""Static network tables, feed snapshots and the source registry."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The feeds that are watched; the first two may be collected.
SOURCE_IDS = [
    "rapid-bus-kl", "rapid-bus-mrtfeeder", "rapid-bus-penang", "mybas-johor", "mybas-melaka", "mybas-seremban-a", "mybas-seremban-b",
    "mybas-ipoh", "mybas-alor-setar", "mybas-kangar", "mybas-kota-bharu", "mybas-kuala-terengganu", "mybas-kuching", "ktmb",
]
COLLECTABLE = 2
TABLES = {
    "routes": "route_id agency_id route_short_name route_long_name route_type route_color route_text_color",
    "trips": "trip_id route_id shape_id trip_headsign direction_id",
    "shapes": "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence",
    "extended_shapes": "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence",
    "extended_routes": "route_id route_short_name route_long_name",
}


def sources(spark: SparkSession) -> DataFrame:
    """(source_idx, id, collectable) of the fourteen feeds."""
    rows = F.array(*[F.struct(F.lit(k).alias("source_idx"), F.lit(name).alias("id"), F.lit(k < COLLECTABLE).alias("collectable")) for k, name in enumerate(SOURCE_IDS)])
    return spark.range(1).select(F.inline(rows))


def read_gtfs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a static network by its header, values trimmed; an extended table may be missing and is then empty."""
    wanted = TABLES[name].split()
    schema = StructType([StructField(c, StringType()) for c in wanted])
    path = f"{folder.rstrip('/')}/{name}.txt"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if not there:
        if name.startswith("extended_"):
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    rows = spark.read.csv(path, header=True, inferSchema=False)
    clean = {c: c.strip().lstrip("﻿") for c in rows.columns}
    rows = rows.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in clean.items()])
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def network_shapes(rows: DataFrame) -> DataFrame:
    """(shape_id, seq, lat, lon) typed from a shapes table; rows that are not numbers are left out."""
    typed = rows.selectExpr("shape_id", "try_cast(shape_pt_sequence AS INT) AS seq", "try_cast(shape_pt_lat AS DOUBLE) AS lat", "try_cast(shape_pt_lon AS DOUBLE) AS lon")
    return typed.filter("seq is not null and lat is not null and lon is not null")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if not byte & 128:
            return value, at


def wire_fields(data: bytes) -> dict[int, list]:
    """Fields of one protocol-buffer message by number: integers, and bytes for all else."""
    found: dict[int, list] = {}
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            if at + size > len(data):
                raise IndexError("torn message")
            value, at = data[at : at + size], at + size
        found.setdefault(key >> 3, []).append(value)
    return found


def _float(fields: dict[int, list], number: int) -> float | None:
    return struct.unpack("<f", fields[number][0])[0] if number in fields else None


def _text(fields: dict[int, list], number: int) -> str | None:
    return fields[number][0].decode("utf-8", "replace") if number in fields else None


def vehicles(message: bytes, now_s: int) -> Iterator[tuple]:
    """(entity_id, vehicle_id, trip_id, rt_route_id, lat, lon, bearing, speed_ms, timestamp_s) of a vehicle-position message."""
    for entity in wire_fields(message).get(2, []):
        own = wire_fields(entity)
        if 4 not in own:
            continue
        vehicle = wire_fields(own[4][0])
        part = lambda n, v=vehicle: wire_fields(v[n][0]) if n in v else {}
        trip, place, named = part(1), part(2), part(8)
        entity_id = _text(own, 1)
        seen = vehicle.get(5, [0])[0] or now_s
        yield entity_id, _text(named, 1) or entity_id, _text(trip, 1), _text(trip, 5), _float(place, 1), _float(place, 2), _float(place, 3), _float(place, 5), seen


def decode_feed(files: DataFrame) -> DataFrame:
    """Vehicles of archived snapshots, from a binaryFile DataFrame; a torn snapshot gives none.

    The vehicle's id falls back to the entity's, its timestamp to the file's.
    """
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    names = ["path", "entity_id", "bus_id", "trip_id", "rt_route_id", "lat", "lon", "bearing", "speed_ms", "timestamp_s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, stamp, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(path, *v) for v in vehicles(content, stamp)]
                except (IndexError, TypeError, AttributeError, struct.error):
                    continue
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    read = files.select("path", F.unix_seconds("modificationTime").alias("stamp"), "content")
    return read.mapInArrow(run, "path string, entity_id string, bus_id string, trip_id string, rt_route_id string, lat double, lon double, bearing double, speed_ms double, timestamp_s long")
