"""Route labels, fleet filters and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import is_unknown_route, route_label
from ..functions.speed import effective_speed


def fleet_filter(fleet: DataFrame, *, hide_unknown: bool = False, hide_stationary: bool = False, mode: str = "raw", search: str = "", routes: DataFrame | None = None, same_as: str | None = None) -> DataFrame:
    """The vehicles that a view shows: a known route, moving, matching a search in route or id, on given routes, or on one bus's route."""
    if hide_unknown:
        fleet = fleet.filter(~is_unknown_route(F.col("route")))
    if hide_stationary:
        fleet = fleet.filter(effective_speed(mode) > 1)
    if search:
        fleet = fleet.filter(F.contains(F.lower("route"), F.lit(search.lower())) | F.contains(F.lower("bus_id"), F.lit(search.lower())))
    if routes is not None:
        fleet = fleet.join(routes.select("route").distinct(), "route", "left_semi")
    if same_as is not None:
        own = fleet.filter(F.col("bus_id") == same_as).select("route").distinct()
        fleet = fleet.join(own, "route", "left_semi")
    return fleet


def headsign_mode(trips: DataFrame) -> DataFrame:
    """(route_id, headsign): the commonest of direction 0, alphabetical among ties."""
    counted = trips.filter("direction_id = '0' and trip_headsign <> ''").groupBy("route_id", "trip_headsign").count()
    first = Window.partitionBy("route_id").orderBy(F.desc("count"), "trip_headsign")
    return counted.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select("route_id", F.col("trip_headsign").alias("headsign"))


def labelled_routes(routes: DataFrame, headsigns: DataFrame) -> DataFrame:
    """Routes with their label."""
    label = route_label(F.col("route_id"), F.col("route_short_name"), F.col("route_long_name"), F.col("headsign"))
    return routes.join(headsigns, "route_id", "left").withColumn("label", label)


def route_index(routes: DataFrame) -> DataFrame:
    """(key, label) by route id, short and long name; of colliding keys the later assignment, by route_id and then name."""
    keys = F.array(*[F.struct(F.trim(F.coalesce(F.col(c), F.lit(""))).alias("key"), F.lit(k).alias("at")) for k, c in enumerate(("route_id", "route_short_name", "route_long_name"))])
    rows = routes.select("route_id", "label", F.explode(keys).alias("k")).filter("k.key <> ''")
    return rows.groupBy(F.col("k.key").alias("key")).agg(F.max_by("label", F.struct("route_id", "k.at")).alias("label"))


def resolve_route(feed: DataFrame, trip_labels: DataFrame, index: DataFrame, learned: DataFrame) -> DataFrame:
    """Feed rows with ``route``: by trip unless Unknown, by the feed's route id or its text, by learned label, else Unknown."""
    by_trip = trip_labels.filter("label <> 'Unknown'").select("trip_id", F.col("label").alias("_trip"))
    rows = feed.join(by_trip, "trip_id", "left").join(index.select(F.col("key").alias("rt_route_id"), F.col("label").alias("_index")), "rt_route_id", "left")
    rows = rows.join(learned.select("bus_id", F.col("label").alias("_learned")), "bus_id", "left")
    raw = F.when(F.col("rt_route_id") != "", F.col("rt_route_id"))
    return rows.withColumn("route", F.coalesce("_trip", "_index", raw, "_learned", F.lit("Unknown"))).drop("_trip", "_index", "_learned")


def trip_labels(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """(trip_id, label), Unknown for a trip whose route has no row."""
    return trips.join(routes.select("route_id", "label"), "route_id", "left").select("trip_id", F.coalesce("label", F.lit("Unknown")).alias("label"))


def shape_routes(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Distinct (label, shape_id) of trips that name a shape."""
    named = trips.filter("shape_id is not null and shape_id <> ''").join(routes.select("route_id", "label"), "route_id", "left")
    return named.select(F.coalesce("label", F.lit("Unknown")).alias("label"), "shape_id").distinct()


def route_of_shape(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """(shape_id, label): the label whose first trip comes first."""
    named = trips.filter("shape_id is not null and shape_id <> ''").join(routes.select("route_id", "label"), "route_id", "left").withColumn("label", F.coalesce("label", F.lit("Unknown")))
    first = named.groupBy("label").agg(F.min("trip_order").alias("label_first"))
    pairs = named.select("label", "shape_id").distinct().join(first, "label")
    return pairs.groupBy("shape_id").agg(F.min_by("label", "label_first").alias("label"))


def inferred_shape(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """Rows with inferred_shape: the learned shape of a bus on an unknown route."""
    known = learned.select(F.col("shape_id").alias("_shape")).distinct()
    wanted = F.when(is_unknown_route(F.col("route")), F.concat(F.lit("LRN_"), F.col("bus_id")))
    return rows.withColumn("_want", wanted).join(known, F.col("_want") == F.col("_shape"), "left").withColumn("inferred_shape", F.col("_shape")).drop("_want", "_shape")


def with_learned(shapes: DataFrame, learned: DataFrame) -> DataFrame:
    """Both kinds of shapes."""
    return shapes.unionByName(learned, allowMissingColumns=True)


def merged_networks(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both networks' rows, the second winning per key."""
    return first.join(second.select(key).distinct(), key, "left_anti").unionByName(second)


def all_routes(heatmap: DataFrame) -> DataFrame:
    """Distinct routes over all modes."""
    return heatmap.select("route").distinct()


def collectable(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows from sources that may be collected."""
    return rows.join(sources.filter("collectable").select(F.col("id").alias("feed_source")), "feed_source", "left_semi")


def has_text(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)), F.lit("")) != ""
