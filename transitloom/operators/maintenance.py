"""The archive's daily maintenance as one job: learn, publish, augment, verify, report."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.labels import is_unknown_route
from ..functions.timeparts import day_number
from ..runtime import batches_by_rows, empty, if_small, written
from ..sources.manifest import Manifest
from . import crossday
from .shapes import POINT_M, shape_cells, with_nearest, with_sticky

#: Rows of a task and a file of a maintained day, about; a bus's day is in one of them.
FILE_ROWS = 500_000
_MADE = ["adj_source", "adj_lat", "adj_lon", "snap_shape_id", "snap_cumdist"]
_LEARNED = "shape_id string, seq int, lat double, lon double, bus_id string"
_OBSERVED = "bus_id string, time_ms long, lat double, lon double, day long"


def augmented(positions: DataFrame, model: DataFrame, shapes: DataFrame, learned: DataFrame, order: tuple[str, ...] = ("time_ms",), pieces: str | None = None) -> DataFrame:
    """Positions with adj_lat, adj_lon, snap_shape_id and snap_cumdist, whatever they held there before.

    Where no typical position is known the raw one stands. The adjusted position is held to the
    shapes of its route, on an unknown route to the bus's learned shape, and has no shape where
    neither is near. The model is a stored one. Each bus starts each ``day`` without a shape to stick to; ``order`` is
    that of its rows. A day is one task, or as many as its column ``pieces`` says, which goes.
    """
    rows = crossday.adjust_positions(positions.drop(*_MADE), model, stored=True).drop("adj_source")
    rows = rows.withColumn("adj_lat", F.coalesce("adj_lat", "lat")).withColumn("adj_lon", F.coalesce("adj_lon", "lon"))
    own = F.when(is_unknown_route(F.col("route")), F.concat(F.lit("LRN_"), F.col("bus_id"))).otherwise(F.col("route"))
    # a learned shape is a route of its own, which only its bus is on
    network = shapes.select("shape_id", "route", "seq", "lat", "lon").unionByName(learned.select("shape_id", F.col("shape_id").alias("route"), "seq", "lat", "lon"))
    routed = rows.withColumn("_route", F.col("route")).withColumn("route", own)
    near = with_nearest(routed, shape_cells(network, POINT_M), POINT_M, lat="adj_lat", lon="adj_lon")
    rows = near.drop("route").withColumnRenamed("_route", "route")
    piece = F.pmod(F.hash("bus_id"), F.col(pieces)) if pieces else F.lit(0)
    done = with_sticky(rows.withColumn("_piece", piece).drop(*[pieces] * bool(pieces)), ["bus_id", "day"], list(order), dealt_by=[F.col("day"), F.col("_piece")])
    return done.drop("_piece")


class Store:
    """A folder with the maintained ``days``, the ``learned`` shapes and the ``observations`` that they are learned from."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.days = Manifest(spark, f"{self.folder}/days")

    def read(self, name: str, schema: str) -> DataFrame:
        """The table, empty where it has not been written yet."""
        if not self.days.files.exists(f"{self.folder}/{name}"):
            return empty(self.spark, StructType.fromDDL(schema))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")


def run_maintenance(positions: DataFrame, shapes: DataFrame, folder: str, today: int, order: tuple[str, ...] = ("time_ms",)) -> DataFrame:
    """Maintains the finished days of an archive in ``folder`` and returns the run's report, one row.

    One projection of all days before ``today``, written once, feeds the cross-day model, what
    is learned of unknown routes, and the days to come. Buses that pass are published as shapes, and then the days that the
    folder does not hold yet are augmented, written as Parquet, read back, and named in one
    commit of the folder's manifest where their rows are all there. A day that is short is
    held back for the next run, and so are all of a run whose commit fails. Days held are
    never rewritten, so a run that is tried again goes on where the last one stopped.
    An archive without finished days gives a report of zeros. Rows without a time belong to
    no day and are left out.
    """
    spark = positions.sparkSession
    store = Store(spark, folder)
    past = positions.drop(*_MADE).withColumn("day", day_number(F.col("time_ms")).cast("long")).filter(F.col("day") < today)
    past = written(past, "past")
    placed = F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    days = written(past.groupBy("day").agg(F.count("*").alias("had"), placed.alias("placed")), "days")
    with batches_by_rows(spark):
        model = written(crossday.cross_day_model(past, days=days.filter("placed > 0")), "model")
    seen = store.read("observations", _OBSERVED)
    learned = written(store.read("learned", _LEARNED), "learned")
    new = crossday.new_unknown_observations(past, seen, learned).select("bus_id", "time_ms", "lat", "lon", F.col("day").cast("long").alias("day"))
    observed = written(new.agg(F.count("*").alias("observations_written")), "observed")
    new.write.mode("append").parquet(f"{store.folder}/observations")

    unlearned = store.read("observations", _OBSERVED).join(learned.select("bus_id").distinct(), "bus_id", "left_anti")
    judged = written(crossday.promotion(unlearned, learned), "judged")
    shaped = crossday.publish_learned(learned, crossday.learned_shapes(unlearned, judged))
    shaped = shaped.select("shape_id", "seq", "lat", "lon", F.expr("substr(shape_id, 5)").alias("bus_id"))
    shaped.write.mode("append").parquet(f"{store.folder}/learned")

    done, short = _augment_days(past, days, model, shapes, store, order)
    of = lambda tier: F.count_if(F.col("tier") == tier)
    cells = model.agg(of(1).alias("bus_route_cells"), of(2).alias("route_cells"), of(3).alias("bus_cells"))
    added = done.agg(F.count("*").alias("days_augmented"), F.coalesce(F.sum("wrote"), F.lit(0)).alias("rows_converted"), F.coalesce(F.sum("snapped"), F.lit(0)).alias("rows_with_snap"))
    report = days.agg(F.coalesce(F.sum("had"), F.lit(0)).alias("scanned_rows"), F.count("*").alias("scanned_days"))
    for part in (observed, cells, crossday.promotion_report(judged), added, short.agg(F.count("*").alias("days_held_back"))):
        report = report.crossJoin(F.broadcast(part))  # single rows
    return report


def _augment_days(past: DataFrame, days: DataFrame, model: DataFrame, shapes: DataFrame, store: Store, order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(day, had, wrote, snapped) of the days that were moved in, and of those held back."""
    missing = days.select("day", "had").join(crossday.days_missing(days, store.days.entries()), "day")
    wanted = written(missing.withColumn("pieces", F.ceil(F.col("had") / FILE_ROWS).cast("int")), "wanted")
    # a row a day: as many as the calendar has
    rows = past.join(F.broadcast(wanted.select("day", F.col("pieces").alias("_pieces"))), "day")
    # the cells of a bus over all its routes are for rows without a route
    riders = written(past.filter(is_unknown_route(F.col("route"))).select("bus_id").distinct(), "riders")
    used = model.join(if_small(riders.withColumn("_rides", F.lit(True)), 40), "bus_id", "left").filter("tier <> 3 OR _rides").select(model.columns)
    staged = store.days.new_run()
    ready = augmented(rows, used, shapes, store.read("learned", _LEARNED), order, "_pieces")
    with batches_by_rows(store.spark):
        ready.write.partitionBy("day").parquet(staged)
    back = _read_back(store, staged)
    found = written(wanted.drop("pieces").join(back, "day", "left"), "verified")
    whole: Column = F.coalesce(F.col("wrote") == F.col("had"), F.lit(False))
    run = staged.removeprefix(f"{store.folder}/days/")
    ready_days = [{"day": r.day, "path": f"{run}/day={r.day}", "rows": r.wrote} for r in found.filter(whole).orderBy("day").collect()]
    try:
        store.days.publish(ready_days)
    except (OSError, Py4JError) as error:
        logging.getLogger(__name__).warning("no day of this run was committed: %s", error)
        return found.filter("false"), found
    short = found.filter(~whole)
    for r in short.select("day").collect():
        store.days.files.remove(f"{staged}/day={r.day}")
    return found.filter(whole), short


def _read_back(store: Store, staged: str) -> DataFrame:
    """(day, wrote, snapped) of the staged days, read back."""
    rows = store.spark.read.schema("snap_shape_id string, day long").parquet(staged)
    return rows.groupBy("day").agg(F.count("*").alias("wrote"), F.count("snap_shape_id").alias("snapped"))
