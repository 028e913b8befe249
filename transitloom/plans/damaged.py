"""Queries over an archive of three origins of which some files are torn."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir
from ..sources.folders import Files
from ..sources.scan import Archive
from . import fixtures as fx
from .base import DAY, query, r6, s6

#: Of each origin: a modulus of the day's number, the remainders below which it holds the day, and the one at which it is torn.
DAYS = {"local_parquet": (3, 2, 1), "jsonl": (5, 3, None), "history_parquet": (7, 5, 4)}
HELD = {source: f"day % {modulus} < {below}" for source, (modulus, below, _) in DAYS.items()}
TORN = {source: f"day % {modulus} = {at}" for source, (modulus, _, at) in DAYS.items() if at is not None}
#: Files of a day, of which one is torn.
PARTS = 2


def _name(day: int, kind: str) -> str:
    return f"{datetime.date(1970, 1, 1) + datetime.timedelta(day)}.{kind}"


def _write_days(rows: DataFrame, held: str, folder: str, kind: str) -> list[int]:
    """Each held day as a folder of parts named by its date; the days."""
    files = Files(rows.sparkSession, folder)
    staged = f"{folder}-staged-{kind}"
    kept = rows.filter(held).repartition(PARTS * 4, "day", F.expr(f"event_id % {PARTS}")).drop("event_id")
    writer = kept.write.partitionBy("day")
    writer.parquet(staged) if kind == "parquet" else writer.text(staged)
    days = [int(n.split("=")[1]) for n in files.names(staged) if n.startswith("day=")]
    files.make(folder)
    for day in days:
        files.rename(f"{staged}/day={day}", f"{folder}/{_name(day, kind)}")
    return days


def _tear(spark: SparkSession, folder: str, days: list[int]) -> None:
    """Damages the first part of each of these days: cut short, as a lost flush does, or a bad stretch before a sound footer."""
    files = Files(spark, folder)
    for day in days:
        home = f"{folder}/{_name(day, 'parquet')}"
        part = next(n for n in files.names(home) if n.endswith(".parquet"))
        whole = files.read(f"{home}/{part}")
        files.write(f"{home}/torn.parquet", whole[: len(whole) * 2 // 3] if day % 2 else whole[:4] + b"\xff" * 60 + whole[64:])
        files.remove(f"{home}/{part}")


def damaged_archive(spark: SparkSession, sf_dir: str) -> Archive:
    """All positions in three origins; each names its origin as the feed, and some days are torn or missing in some."""
    folder = f"{shared_dir(spark)}/damaged-{uuid.uuid4().hex}"
    day = "(time_ms + 28800000) div 86400000 AS day"
    rows = fx.pos_sparse(spark, sf_dir).selectExpr("event_id", day, "bus_id", "route", "time_ms AS time", "lat", "lon", "speed")
    own = lambda source: rows.withColumn("feed_source", F.lit(source))
    torn = lambda days, source: [d for d in days if d % DAYS[source][0] == DAYS[source][2]]
    local = _write_days(own("local_parquet"), HELD["local_parquet"], f"{folder}/data", "parquet")
    _tear(spark, f"{folder}/data", torn(local, "local_parquet"))
    # one line in eleven is cut
    line = F.to_json(F.struct("bus_id", "route", "time", "lat", "lon", "speed", "feed_source"))
    lines = own("jsonl").withColumn("value", F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 25)).otherwise(line)).select("event_id", "day", "value")
    _write_days(lines, HELD["jsonl"], f"{folder}/data", "jsonl")
    stamped = own("history_parquet").withColumn("time", F.timestamp_millis("time"))
    other = _write_days(stamped, HELD["history_parquet"], f"{folder}/history", "parquet")
    _tear(spark, f"{folder}/history", torn(other, "history_parquet"))
    return Archive(spark, {"data": f"{folder}/data", "history": f"{folder}/history"})


_BEST = f"CASE WHEN {HELD['local_parquet']} AND NOT ({TORN['local_parquet']}) THEN 'local_parquet' WHEN {HELD['jsonl']} THEN 'jsonl' WHEN {HELD['history_parquet']} AND NOT ({TORN['history_parquet']}) THEN 'history_parquet' END"
_DAYS = f"{fx.POS_SPARSE}, d AS (SELECT *, {DAY} AS day FROM pos), b AS (SELECT *, {_BEST} AS source FROM d)"


@query("s3_archive_scan", f"WITH {_DAYS} SELECT CAST(day AS INT) AS day, source, bus_id, route, time_ms AS time, {s6('lat')} AS lat, {s6('lon')} AS lon, speed, source AS feed_source FROM b WHERE source IS NOT NULL AND (source <> 'jsonl' OR event_id % 11 <> 0)")
def s3_scan(spark, sf_dir):
    """All rows of a damaged archive, each day from its best source that can be read."""
    rows = damaged_archive(spark, sf_dir).scan()
    return rows.select("day", "source", "bus_id", "route", "time", r6("lat"), r6("lon"), "speed", "feed_source")


_OVER = f"CASE WHEN {TORN['local_parquet']} THEN 1 ELSE 0 END + CASE WHEN source IS NULL AND {TORN['history_parquet']} THEN 1 ELSE 0 END"
_LISTED = f"({HELD['local_parquet']} OR {HELD['jsonl']} OR {HELD['history_parquet']})"


@query("s4_archive_catalog", f"WITH {_DAYS} SELECT CAST(day AS INT) AS day, source, CASE WHEN source <> 'jsonl' THEN count(*) END AS rows, {_OVER} AS passed_over, {_OVER} AS bad_files FROM b WHERE {_LISTED} GROUP BY day, source")
def s4_catalog(spark, sf_dir):
    return damaged_archive(spark, sf_dir).catalog.select("day", "source", "rows", "passed_over", "bad_files")
