"""Queries that write the derived tables as archives of each kind and read them back."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_dir
from ..sources import history, network
from . import fixtures as fx
from .base import query, r6, s6

# one line in seven is blank, one is torn, and of the rest every third is of the old vintage
_NEW = "to_json(struct(bus_id, route, time_ms AS time, lat, lon, speed, 'ktmb' AS feed_source))"
_OLD = "to_json(struct(bus_id, route, time_ms AS t, lat, lon, speed AS speed_raw, speed / 2 AS speed_calc))"
_LINE = f"CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN left({_NEW}, 30) ELSE CASE WHEN k % 3 = 0 THEN {_OLD} ELSE {_NEW} END END AS value"
_READ = f"WITH {fx.POS_SPARSE} SELECT bus_id, route, time_ms AS time, {s6('lat')} AS lat, {s6('lon')} AS lon, speed, CASE WHEN k % 3 = 0 THEN speed / 2 END AS calculated_speed, CASE WHEN k % 3 = 0 THEN 'rapid-bus-kl' ELSE 'ktmb' END AS feed_source FROM pos WHERE k % 7 > 1"


def _kept(rows: DataFrame) -> DataFrame:
    return rows.select("bus_id", "route", "time", r6("lat"), r6("lon"), "speed", "calculated_speed", "feed_source")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _lines(spark, sf_dir) -> str:
    """The positions as a JSON-lines archive."""
    folder = f"{_folder(spark)}/day.jsonl"
    fx.pos_sparse(spark, sf_dir).selectExpr(_LINE).write.text(folder)
    return folder


@query("s1_read_ticks", _READ)
def s1(spark, sf_dir):
    return _kept(history.normalize(history.read_ticks_json(spark, _lines(spark, sf_dir))))


@query("s7_compact_day", _READ)
def s7(spark, sf_dir):
    target = f"{_folder(spark)}/day.parquet"
    history.compact_day(spark, _lines(spark, sf_dir), target)
    return _kept(history.read_history(spark, target))


@query("s8_read_gtfs", f"WITH {fx.TRIPS} SELECT trip_id, route_id, shape_id, trip_headsign, direction_id FROM trips")
def s8(spark, sf_dir):
    """Trips behind a byte-order mark, padded with blanks."""
    folder = _folder(spark)
    padded = fx.trips(spark, sf_dir).select(F.col("trip_id").alias("﻿trip_id"), F.concat(F.lit(" "), "route_id").alias("route_id "), F.concat("shape_id", F.lit("  ")).alias("shape_id"), "direction_id", "trip_headsign")
    padded.write.csv(f"{folder}/trips.txt", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return network.read_gtfs(spark, folder, "trips")


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _part(field: int, body: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(body)) + body


def message(entities: list[dict]) -> bytes:
    """A vehicle-position message of a few entities; a stamp or bus that is None is left out."""
    out = b""
    for e in entities:
        real = lambda n, c, e=e: _number(n << 3 | 5) + struct.pack("<f", e[c])
        own = _part(1, _part(1, e["trip"].encode()) + _part(5, e["route"].encode())) + _part(2, real(1, "lat") + real(2, "lon") + real(5, "speed"))
        if e["stamp"] is not None:
            own += _number(5 << 3) + _number(e["stamp"])
        if e["bus"] is not None:
            own += _part(8, _part(1, e["bus"].encode()))
        out += _part(2, _part(1, e["entity"].encode()) + _part(4, own))
    return out


#: Vehicles of a snapshot, and the time of its file.
SNAPSHOT, FILE_S = 14, 1704060000
_REAL = "CAST(CAST({0} AS FLOAT) AS DOUBLE) AS {0}".format


@query(
    "s9_decode_feed",
    f"WITH {fx.POS_SPARSE} SELECT 'snapshot-' || (event_id // {SNAPSHOT}) AS path, 'e' || event_id AS entity_id, CASE WHEN k % 5 = 0 THEN 'e' || event_id ELSE bus_id END AS bus_id, 'T' || event_id AS trip_id, route AS rt_route_id, {_REAL('lat')}, {_REAL('lon')}, CAST(NULL AS DOUBLE) AS bearing, CAST(CAST(speed AS FLOAT) AS DOUBLE) AS speed_ms, CASE WHEN k % 4 = 0 THEN {FILE_S} ELSE time_ms // 1000 END AS timestamp_s FROM pos WHERE (event_id // {SNAPSHOT}) % 6 <> 0",
)
def s9(spark, sf_dir):
    """Snapshots of fourteen vehicles, every sixth of them torn, as their files would be read."""
    entity = F.expr("struct('e' || event_id AS entity, CASE WHEN k % 5 <> 0 THEN bus_id END AS bus, 'T' || event_id AS trip, route, lat, lon, speed, CASE WHEN k % 4 <> 0 THEN time_ms div 1000 END AS stamp)")
    grouped = fx.pos_sparse(spark, sf_dir).groupBy(F.expr(f"event_id div {SNAPSHOT}").alias("n")).agg(F.collect_list(entity).alias("entities"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            made = [message(e)[: -3 if n % 6 == 0 else None] for n, e in zip(numbers, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"snapshot-{n}" for n in numbers]), pa.array(made, pa.binary())], ["path", "content"])

    files = grouped.mapInArrow(encode, "path string, content binary").withColumn("modificationTime", F.timestamp_seconds(F.lit(FILE_S)))
    return network.decode_feed(files)
