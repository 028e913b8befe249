"""Typical positions over days, cleaning by them, and learning shapes of unlabelled buses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.labels import is_unknown_route
from ..functions.timeparts import day_number, fractional_bucket, half_hour_bucket
from ..runtime import BROADCAST_BYTES, if_small, written
from .heatmap import recent_days
from .scans import group_medians, key_starts

MODEL_DAYS, JUMP_KM = 60, 2.0
#: What a bus must show before its shape is learned.
LEARN_DAYS, LEARN_POINTS, LEARN_SPREAD_M, M_PER_DEGREE = 3, 100, 200.0, 111000.0
#: Bytes of a row of typical positions.
TYPICAL_BYTES = 160


def cross_day_model(positions: DataFrame, max_days: int = MODEL_DAYS, days: DataFrame | None = None) -> DataFrame:
    """(tier, bus_id, route, slot, lat, lon, n): exact medians in three groupings.

    Tier 1 is by bus, route and slot, tier 2 by route and slot, both of known routes; tier 3
    is by bus and slot of all rows. Only the latest days count. One scan gives tiers 1 and 3,
    a second one tier 2. ``days`` holds each ``day`` with a place, where the caller knows them.
    """
    rows = positions.filter("lat is not null and lon is not null").withColumn("day", day_number(F.col("time_ms")))
    rows = rows.join(F.broadcast(recent_days(rows if days is None else days, max_days)), "day", "left_semi").withColumn("slot", half_hour_bucket(F.col("time_ms")))
    route = F.when(~is_unknown_route(F.col("route")), F.col("route"))
    keyed = rows.select(F.col("bus_id").cast("string").alias("bus_id"), route.alias("route"), "slot", *[F.col(c).cast("double").alias(c) for c in ("lat", "lon")])
    return _of_buses(keyed).unionByName(_of_routes(keyed))


def _of_buses(keyed: DataFrame) -> DataFrame:
    """Tiers 1 and 3: a bus's slot is one stretch of a sorted scan, which holds no more than one such stretch and a batch."""

    def medians(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        bus, route, slot, lat, lon = (c.combine_chunks() for c in rows.columns)
        lat, lon = lat.to_numpy(zero_copy_only=False), lon.to_numpy(zero_copy_only=False)
        for tier, keys in ((1, [bus, slot, route]), (3, [bus, slot])):
            starts = key_starts(keys)
            first = np.flatnonzero(starts)
            n = np.diff(np.append(first, len(starts)))
            at = pa.array(first)
            routes = route.take(at) if tier == 1 else pa.nulls(len(at), pa.string())
            found = pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tier, "int32")), bus.take(at), routes, slot.take(at), pa.array(group_medians(lat, starts)), pa.array(group_medians(lon, starts)), pa.array(n)], ["tier", "bus_id", "route", "slot", "lat", "lon", "n"])
            yield found if tier == 3 else found.filter(found.column(2).is_valid())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None
        for batch in filter(len, batches):
            by = [batch.column(0), batch.column(2)]
            starts = key_starts(by)
            starts[0] = [c[0].as_py() for c in by] != own
            own = [c[-1].as_py() for c in by]
            cuts = np.flatnonzero(starts)
            if len(cuts) and (held or cuts[-1]):
                yield from medians([*held, batch.slice(0, cuts[-1])])
                held = []
            held.append(batch.slice(cuts[-1] if len(cuts) else 0))
        if held:
            yield from medians(held)

    sorted_rows = keyed.repartition("bus_id", "slot").sortWithinPartitions("bus_id", "slot", "route")
    return sorted_rows.mapInArrow(scan, "tier int, bus_id string, route string, slot int, lat double, lon double, n long")


def _of_routes(keyed: DataFrame) -> DataFrame:
    """Tier 2: values are counted first, so that medians are taken of those that differ."""
    each = keyed.filter("route is not null").select("route", "slot", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in ("lat", "lon")])).alias("p"))
    counted = each.groupBy("route", "slot", "p.c", "p.v").agg(F.count("*").alias("n"))
    found = counted.groupBy("route", "slot").agg(*[F.percentile(F.when(F.col("c") == c, F.col("v")), F.lit(0.5), F.col("n")).alias(c) for c in ("lat", "lon")], F.sum(F.when(F.col("c") == "lat", F.col("n"))).alias("n"))
    return found.select(F.lit(2).alias("tier"), F.lit(None).cast("string").alias("bus_id"), "route", "slot", "lat", "lon", "n")


def _between_slots(model: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """(_k_<keys>, _k_lo, _<name>_lo, _<name>_hi): the typical positions of each slot and of the one after it."""
    none = F.lit(None).cast("double")
    end = lambda lo, hi: F.struct((F.col("slot") - F.lit(hi)).alias("at"), *[(F.col(c) if on else none).alias(f"{e}_{c}") for e, on in (("lo", lo), ("hi", hi)) for c in ("lat", "lon")])
    rows = model.select(*[F.col(k.removeprefix("_")).alias(f"_k_{k}") for k in keys], F.explode(F.array(end(1, 0), end(0, 1))).alias("e"))
    found = rows.groupBy(*[f"_k_{k}" for k in keys], F.col("e.at").alias("_k_lo")).agg(*[F.max(f"e.{e}_{c}").alias(f"{e}_{c}") for e in ("lo", "hi") for c in ("lat", "lon")])
    place = lambda e: F.when(F.col(f"{e}_lat").isNotNull(), F.struct(F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon")))
    return found.select(*[f"_k_{k}" for k in keys], "_k_lo", *[place(e).alias(f"_{name}_{e}") for e in ("lo", "hi")])


def adjust_positions(positions: DataFrame, model: DataFrame, stored: bool = False) -> DataFrame:
    """Rows with adj_lat, adj_lon and adj_source: raw near the typical position, else that; unchanged where there is none.

    The typical position lies between the centres of the slots before and after the time, of
    the bus on its route or else of the route; on unknown routes of the bus. Slots do not wrap
    at midnight. The model is computed once, unless it is ``stored`` already, and a row meets one
    row of its bus and one of its route, which hold the slots before and after alone; sides are
    broadcast where their counted rows are few.
    """
    at = fractional_bucket(F.col("time_ms"))
    rows = positions.withColumn("_route", F.when(is_unknown_route(F.col("route")), "Unknown").otherwise(F.col("route")))
    rows = rows.withColumn("_lo", F.floor(at - 0.5).cast("int"))
    # a bus's cells of all routes stand for it on unknown ones, which have no cells of their own
    model = model.withColumn("route", F.when(F.col("tier") == 3, "Unknown").otherwise(F.col("route")))
    model = model.select("tier", "bus_id", "route", "slot", "lat", "lon")
    model = model if stored else written(model, "cross-day-model")
    for name, tiers, keys in (("own", (1, 3), ("bus_id", "_route")), ("any", (2,), ("_route",))):
        match = F.col("_lo") == F.col("_k_lo")
        for k in keys:
            match &= F.col(k) == F.col(f"_k_{k}")
        cells = model.filter(F.col("tier").isin(*tiers))
        side = _between_slots(cells, keys, name)
        # there is a row for each cell at least: where cells are too many for a broadcast, rows are grouped as the join wants them
        if cells.count() * TYPICAL_BYTES <= BROADCAST_BYTES:
            side = if_small(written(side, "typical-positions"), TYPICAL_BYTES)
        rows = rows.join(side, match, "left").drop("_k_lo", *[f"_k_{k}" for k in keys])
    for end in ("lo", "hi"):
        rows = rows.withColumn(f"_at_{end}", F.coalesce(f"_own_{end}", f"_any_{end}"))
    rows = rows.drop("_own_lo", "_own_hi", "_any_lo", "_any_hi").withColumn("_frac", at - (F.col("_lo") + 0.5))
    typical = lambda c: F.coalesce(F.col(f"_at_lo.{c}") * (1 - F.col("_frac")) + F.col(f"_at_hi.{c}") * F.col("_frac"), F.col(f"_at_lo.{c}"), F.col(f"_at_hi.{c}"))
    rows = rows.withColumn("_lat", typical("lat")).withColumn("_lon", typical("lon"))
    far = F.col("lat").isNull() | F.col("lon").isNull() | (haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) > JUMP_KM)
    source = F.when(F.col("_lat").isNull(), "none").when(far, "model").otherwise("raw")
    pick = lambda c: F.when(F.col("adj_source") == "model", F.col(f"_{c}")).when(F.col("adj_source") == "raw", F.col(c))
    return rows.withColumn("adj_source", source).withColumn("adj_lat", pick("lat")).withColumn("adj_lon", pick("lon")).drop("_route", "_lo", "_at_lo", "_at_hi", "_frac", "_lat", "_lon")


def new_unknown_observations(positions: DataFrame, seen: DataFrame, learned: DataFrame) -> DataFrame:
    """(bus_id, day, time_ms, lat, lon) of unknown routes, of buses without a learned shape and days not yet recorded for them."""
    rows = positions.filter(is_unknown_route(F.col("route"), learning=True) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    rows = rows.select("bus_id", day_number(F.col("time_ms")).alias("day"), "time_ms", "lat", "lon")
    return rows.join(seen.select("bus_id", "day").distinct(), ["bus_id", "day"], "left_anti").join(learned.select("bus_id").distinct(), "bus_id", "left_anti")


def promotion(observations: DataFrame, existing: DataFrame) -> DataFrame:
    """(bus_id, days, points, spread_m, promoted): buses whose positions are many, on several days and tight by slot."""
    rows = observations.withColumn("slot", half_hour_bucket(F.col("time_ms")))
    spread = F.sqrt(F.pow(F.coalesce(F.stddev_samp("lat"), F.lit(0.0)), 2) + F.pow(F.coalesce(F.stddev_samp("lon"), F.lit(0.0)), 2)) * M_PER_DEGREE
    slots = rows.groupBy("bus_id", "slot").agg(spread.alias("spread"))
    tight = slots.groupBy("bus_id").agg(F.median("spread").alias("spread_m"))
    totals = rows.groupBy("bus_id").agg(F.count_distinct("day").alias("days"), F.count("*").alias("points"))
    known = existing.select(F.col("shape_id").alias("_id")).distinct().withColumn("_has", F.lit(True))
    judged = totals.join(tight, "bus_id").join(known, F.concat(F.lit("LRN_"), F.col("bus_id")) == F.col("_id"), "left")
    passed = (F.col("days") >= LEARN_DAYS) & (F.col("points") >= LEARN_POINTS) & (F.col("spread_m") <= LEARN_SPREAD_M) & F.col("_has").isNull()
    return judged.withColumn("promoted", passed).drop("_id", "_has")


def learned_shapes(observations: DataFrame, judged: DataFrame) -> DataFrame:
    """(shape_id, seq, lat, lon): a promoted bus's slot medians in slot order."""
    rows = observations.join(judged.filter("promoted").select("bus_id"), "bus_id", "left_semi").withColumn("slot", half_hour_bucket(F.col("time_ms")))
    medians = rows.groupBy("bus_id", "slot").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"))
    return medians.select(F.concat(F.lit("LRN_"), F.col("bus_id")).alias("shape_id"), F.row_number().over(Window.partitionBy("bus_id").orderBy("slot")).alias("seq"), "lat", "lon")


def promotion_report(judged: DataFrame) -> DataFrame:
    """(promoted, skipped, candidates)."""
    return judged.agg(F.count_if(F.col("promoted")).alias("promoted"), F.count_if(~F.col("promoted")).alias("skipped"), F.count("*").alias("candidates"))


def publish_learned(existing: DataFrame, new: DataFrame, key: str = "shape_id") -> DataFrame:
    """The rows of new ids, to be appended."""
    return new.join(existing.select(key).distinct(), key, "left_anti")


def without_graduated(observations: DataFrame, judged: DataFrame) -> DataFrame:
    """Observations of buses that are still unlearned (U4)."""
    return observations.join(judged.filter("promoted").select("bus_id"), "bus_id", "left_anti")


def days_missing(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Days not yet held (U4)."""
    return wanted.select("day").distinct().join(held.select("day").distinct(), "day", "left_anti")
