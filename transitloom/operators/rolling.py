"""Models over many days from stored day partials: a day enters by one scan of its own, and one leaves by not being read (A3, A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import is_unknown_route
from ..functions.timeparts import day_number, half_hour_bucket
from ..sources.manifest import Manifest
from .crossday import MODEL_DAYS
from .heatmap import day_medians, pooled
from .medians import exact_median

#: Degrees of a range of positions that is ranked as one.
DEGREES = 0.001
_PLACES = "bus_id string, route string, slot int, axis string, value double, n long"
_SPEEDS = "mode string, value double, n long"


def place_partials(positions: DataFrame) -> DataFrame:
    """(day, bus_id, route, slot, axis, value, n): how often each latitude and longitude was seen."""
    rows = positions.filter("lat is not null and lon is not null").select(day_number(F.col("time_ms")).cast("long").alias("day"), "bus_id", "route", half_hour_bucket(F.col("time_ms")).cast("int").alias("slot"), "lat", "lon")
    axes = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("value")) for c in ("lat", "lon")]))
    return rows.select("day", "bus_id", "route", "slot", axes.alias("a")).groupBy("day", "bus_id", "route", "slot", "a.axis", "a.value").agg(F.count("*").alias("n"))


def speed_partials(positions: DataFrame) -> DataFrame:
    """(day, mode, value, n): how many buses of a day have each median speed; a day's buses are done when it is."""
    return day_medians(positions).groupBy(F.col("day").cast("long").alias("day"), "mode", F.col("m").alias("value")).agg(F.count("*").alias("n"))


def model_of(partials: DataFrame) -> DataFrame:
    """The cross-day model of these days: (tier, bus_id, route, slot, lat, lon, n), as ``cross_day_model`` has it."""
    none, known = F.lit(None).cast("string"), ~is_unknown_route(F.col("route"))
    tiers = F.array(
        F.when(known, F.struct(F.lit(1).alias("tier"), F.col("bus_id").alias("bus"), F.col("route").alias("rt"))),
        F.when(known, F.struct(F.lit(2).alias("tier"), none.alias("bus"), F.col("route").alias("rt"))),
        F.struct(F.lit(3).alias("tier"), F.col("bus_id").alias("bus"), none.alias("rt")),
    )
    keyed = partials.select(F.explode(F.filter(tiers, lambda t: t.isNotNull())).alias("k"), "slot", "axis", "value", "n").select("k.tier", "k.bus", "k.rt", "slot", "axis", "value", "n")
    found = exact_median(keyed, ["tier", "bus", "rt", "slot", "axis"], DEGREES)
    of = lambda axis: F.max(F.when(F.col("axis") == axis, F.col("median"))).alias(axis)
    return found.groupBy("tier", "bus", "rt", "slot").agg(of("lat"), of("lon"), F.max("n").alias("n")).select("tier", F.col("bus").alias("bus_id"), F.col("rt").alias("route"), "slot", "lat", "lon", "n")


def anchors_of(partials: DataFrame) -> DataFrame:
    """(mode, anchor, n) of these days, as ``pooled_anchors`` has it."""
    return pooled(partials)


class RollingDays:
    """Stored partials of each day of a folder: of positions for the cross-day model, of speeds for pooled anchors.

    ``kinds`` are those that are kept: a folder for the model alone has no need of medians of speeds.
    """

    def __init__(self, spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("places", "speeds")) -> None:
        made = {"places": (place_partials, _PLACES), "speeds": (speed_partials, _SPEEDS)}
        self._tables = {kind: (Manifest(spark, f"{folder}/{kind}"), *made[kind]) for kind in kinds}

    def enter(self, positions: DataFrame) -> None:
        """Adds the days of these positions, or puts them in place of what was held; each day has to be whole."""
        for table, partials, _ in self._tables.values():
            run = table.new_run()
            made = partials(positions)
            made.write.partitionBy("day").parquet(run)
            held = made.sparkSession.read.schema("n long, day long").parquet(run).groupBy("day").agg(F.count("*").alias("rows")).orderBy("day").collect()
            table.publish([{"day": r.day, "path": f"{run.removeprefix(table.folder)[1:]}/day={r.day}", "rows": r.rows} for r in held])

    def _latest(self, kind: str, most: int) -> DataFrame:
        table, _, schema = self._tables[kind]
        days = [r.day for r in table.entries().select("day").orderBy(F.desc("day")).limit(most).collect()]
        return table.read(schema, days)

    def model(self, most: int = MODEL_DAYS) -> DataFrame:
        """The cross-day model of the latest days held."""
        return model_of(self._latest("places", most))

    def anchors(self, most: int = 1 << 30) -> DataFrame:
        """The pooled anchors of the latest days held, all by default."""
        return anchors_of(self._latest("speeds", most))
