"""Route x hour speed heatmaps and pooled anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import grid_cell, grid_step, round_half_up
from ..functions.speed import MODES, PHYSICAL_ANCHOR, SPIKE, bin_edges, fixed_edges, mode_bin, plausible, speed_bin
from ..functions.timeparts import day_number, frac_hour, local_hour
from .medians import exact_median

SAMPLES = 60
#: Speeds of a range that is ranked as one.
RANGE_KMH = 1.0


def unpivot_modes(positions: DataFrame, *keys: str | Column) -> DataFrame:
    """(keys, mode, v): one row for each mode of each position, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(c).alias("v")) for m, c in MODES.items()]))
    return positions.select(*keys, each.alias("m")).select("*", "m.mode", "m.v").drop("m")


def latest_per_cell(samples: DataFrame, cell: list[str], order: list[str], k: int = SAMPLES) -> DataFrame:
    """The k latest rows of each cell in arrival order."""
    newest = Window.partitionBy(*cell).orderBy(*[F.desc(c) for c in order])
    return samples.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= k).drop("_rank")


def _two_stage(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Median of each bus's median of its latest samples, by keys."""
    cell = [*keys, "bus_id"]
    medians = latest_per_cell(samples, cell, ["time_ms", "event_id"]).groupBy(*cell).agg(F.median("v").alias("m"))
    return medians.groupBy(*keys).agg(F.median("m").alias("raw_value"), F.count("*").alias("n"))


def speed_heatmap(positions: DataFrame, mode: str = "raw", anchor: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, route, hour, value, bin, n buses): the value at two decimals, its bin from the unrounded one; keys keep days apart."""
    samples = positions.select(*keys, "route", local_hour(F.col("time_ms")).alias("hour"), "bus_id", "time_ms", "event_id", F.col(MODES[mode]).alias("v")).filter(plausible(F.col("v")))
    cells = _two_stage(samples, [*keys, "route", "hour"])
    named = speed_bin(F.col("raw_value"), fixed_edges(mode, anchor), SPIKE[mode])
    return cells.select(*keys, "route", "hour", round_half_up(F.col("raw_value"), 2).alias("value"), named.alias("bin"), "n")


def speed_heatmap_all(positions: DataFrame) -> DataFrame:
    """speed_heatmap of every mode: (mode, route, hour, value, bin, n), from one scan."""
    hour = local_hour(F.col("time_ms")).alias("hour")
    samples = unpivot_modes(positions, "route", hour, "bus_id", "time_ms", "event_id").filter(plausible(F.col("v")))
    cells = _two_stage(samples, ["mode", "route", "hour"])
    return cells.select("mode", "route", "hour", round_half_up(F.col("raw_value"), 2).alias("value"), mode_bin(F.col("mode"), F.col("raw_value")).alias("bin"), "n")


def day_medians(positions: DataFrame) -> DataFrame:
    """(mode, day, bus_id, m): each bus's median speed of a day."""
    samples = unpivot_modes(positions, day_number(F.col("time_ms")).alias("day"), "bus_id").filter(plausible(F.col("v")))
    return samples.groupBy("mode", "day", "bus_id").agg(F.median("v").alias("m"))


def pooled(counted: DataFrame) -> DataFrame:
    """(mode, anchor, n) of counted medians (mode, value, n): theirs, null unless positive. Only the range of values around each is ranked."""
    found = exact_median(counted.select("mode", "value", "n"), ["mode"], RANGE_KMH)
    return found.select("mode", F.when(F.col("median") > 0, F.col("median")).alias("anchor"), "n")


def pooled_anchors(positions: DataFrame) -> DataFrame:
    """(mode, anchor, n): the median over days and buses of each one's median; null unless positive."""
    return pooled(day_medians(positions).select("mode", F.col("m").alias("value"), F.lit(1).cast("long").alias("n")))


def anchored_edges(anchors: DataFrame) -> DataFrame:
    """(mode, anchor, edges): bin edges at each mode's pooled anchor, or its physical one."""
    found = F.lit(None).cast("array<double>")
    for mode in MODES:
        at = F.coalesce("anchor", F.lit(PHYSICAL_ANCHOR[mode]))
        found = F.when(F.col("mode") == mode, F.array(*bin_edges(mode, at))).otherwise(found)
    return anchors.withColumn("edges", found)


def density_grid(positions: DataFrame, metres: float = 200.0, *keys: str) -> DataFrame:
    """Distinct buses in each square cell: (keys, lat_bin, lon_bin, count, lat, lon)."""
    step = grid_step(metres)
    cells = positions.select(*keys, grid_cell(F.col("lat"), step).alias("lat_bin"), grid_cell(F.col("lon"), step).alias("lon_bin"), "bus_id")
    counted = cells.filter("lat_bin is not null and lon_bin is not null").groupBy(*keys, "lat_bin", "lon_bin").agg(F.count_distinct("bus_id").alias("count"))
    return counted.withColumn("lat", F.col("lat_bin") * F.lit(step)).withColumn("lon", F.col("lon_bin") * F.lit(step))


def cell_polygon(lat: Column, lon: Column, metres: float = 200.0) -> Column:
    """The cell's corners (lon, lat), counter-clockwise from the south-west."""
    half = F.lit(grid_step(metres) / 2)
    return F.array(*[F.array(x, y) for x, y in ((lon - half, lat - half), (lon + half, lat - half), (lon + half, lat + half), (lon - half, lat + half))])


def density_thresholds(grid: DataFrame, buckets: int = 6) -> DataFrame:
    """One row (thresholds): buckets - 1 rounded quantiles of the counts, at least 1 and each above the last."""
    cuts = [(k + 1) / buckets for k in range(buckets - 1)]
    cuts[-1] = min(cuts[-1], 0.95)
    quantiles = grid.agg(F.percentile("count", cuts).alias("q")).select(F.transform(F.col("q"), lambda q: F.greatest(round_half_up(q), F.lit(1.0)).cast("int")).alias("q"))
    grow = lambda acc, x: F.concat(acc, F.array(F.when((F.size(acc) > 0) & (x <= F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))), F.try_element_at(acc, F.lit(-1)) + 1).otherwise(x)))
    return quantiles.select(F.aggregate("q", F.expr("CAST(array() AS ARRAY<INT>)"), grow).alias("thresholds"))


def density_class(count: Column, thresholds: Column) -> Column:
    """Index of the first threshold that is not below the count, or the number of thresholds."""
    at = F.filter(F.transform(thresholds, lambda t, k: F.struct(t.alias("t"), k.alias("k"))), lambda x: x["t"] >= count)
    return F.coalesce(F.try_element_at(at, F.lit(1))["k"], F.size(thresholds))


def density_rank_class(grid: DataFrame, stops: int = 7) -> DataFrame:
    """Cells with ``stop``: the rank of their count among the distinct counts, spread over the stops."""
    ranks = grid.select("count").distinct()
    order, n = Window.orderBy("count"), ranks.count()
    # one row for each distinct count, which no cell's number of buses exceeds
    placed = ranks.withColumn("_i", F.row_number().over(order) - 1)
    stop = F.lit(stops - 1) if n == 1 else F.least(F.floor(F.col("_i") / F.lit(float(max(1, n - 1))) * stops).cast("int"), F.lit(stops - 1))
    return grid.join(F.broadcast(placed.select("count", stop.alias("stop"))) if n < 100_000 else placed.select("count", stop.alias("stop")), "count")


def speed_hexbin(positions: DataFrame, value: str = "speed", metres: float = 200.0) -> DataFrame:
    """Mean plausible speed in each hexagon of axial coordinates: (q, r, value, n)."""
    step = grid_step(metres)
    x, y = F.col("lon") / F.lit(step), F.col("lat") / F.lit(step)
    q, r = x * (3**0.5 / 3) - y / 3, y * (2 / 3)
    s = -q - r
    near = lambda v: F.floor(v + 0.5)
    dq, dr, ds = (F.abs(near(v) - v) for v in (q, r, s))
    # the coordinate that was rounded furthest follows from the two others
    hex_q = F.when((dq > dr) & (dq > ds), -near(r) - near(s)).otherwise(near(q))
    hex_r = F.when((dr > ds) & ~((dq > dr) & (dq > ds)), -near(q) - near(s)).otherwise(near(r))
    cells = positions.filter(plausible(F.col(value))).select(hex_q.alias("q"), hex_r.alias("r"), F.col(value).alias("v"))
    return cells.groupBy("q", "r").agg(F.avg("v").alias("value"), F.count("*").alias("n"))


def busiest_day_bbox(positions: DataFrame, days: int = 14) -> DataFrame:
    """Each bus's box on its day with most points among the latest days: ties go to the newest."""
    lat, lon = F.coalesce("adj_lat", "lat"), F.coalesce("adj_lon", "lon")
    placed = positions.select("bus_id", day_number(F.col("time_ms")).alias("day"), lat.alias("y"), lon.alias("x")).filter("y is not null and x is not null")
    recent = recent_days(placed, days)
    boxes = placed.join(F.broadcast(recent), "day", "left_semi").groupBy("bus_id", "day").agg(F.count("*").alias("n"), F.min("y").alias("min_lat"), F.max("y").alias("max_lat"), F.min("x").alias("min_lon"), F.max("x").alias("max_lon"))
    best = boxes.groupBy("bus_id").agg(F.max(F.struct("n", "day", "min_lat", "max_lat", "min_lon", "max_lon")).alias("b"))
    return best.select("bus_id", "b.*")


def recent_days(rows: DataFrame, n: int, day: str = "day") -> DataFrame:
    """The n newest days (T1): at most n rows."""
    return rows.select(day).distinct().orderBy(F.desc(day)).limit(n)


def data_hour_range(positions: DataFrame) -> DataFrame:
    """(first_hour, last_hour): the last rounded up if it has minutes, 23 at most; 0 and 23 of no rows."""
    hours = positions.select(frac_hour(F.col("time_ms")).alias("h")).agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    return hours.select(F.coalesce(F.floor("lo"), F.lit(0)).cast("int").alias("first_hour"), F.coalesce(F.least(F.ceil("hi"), F.lit(23)), F.lit(23)).cast("int").alias("last_hour"))


def principal_bearing(points: DataFrame, key: str = "route") -> DataFrame:
    """(key, bearing) in (-90, 90] that lays each group's main axis level; null for under three points."""
    # within a group the cosine of its middle latitude is constant, so it scales the sums afterwards
    sums = points.groupBy(key).agg(F.count("*").alias("n"), F.covar_pop("lon", "lat").alias("cxy"), F.var_pop("lon").alias("cxx"), F.var_pop("lat").alias("syy"), F.cos(F.radians((F.min("lat") + F.max("lat")) / 2)).alias("c"))
    sums = sums.withColumn("sxy", F.col("c") * F.col("cxy")).withColumn("sxx", F.col("c") * F.col("c") * F.col("cxx"))
    theta = 0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy"))
    # level = -theta in degrees, folded by half turns
    turned = F.pmod(-F.degrees(theta) + 89.9999999999, F.lit(180.0)) - 89.9999999999
    return sums.select(key, F.when(F.col("n") >= 3, F.floor(turned + 0.5).cast("int")).alias("bearing"))


def heatmap_stats(positions: DataFrame, mode: str = "raw") -> DataFrame:
    """One row of what a heatmap rests on (A21): buses, samples that its cells hold, cells of a bus and hour, the oldest sample's time."""
    samples = positions.select(local_hour(F.col("time_ms")).alias("hour"), "bus_id", "time_ms", F.col(MODES[mode]).alias("v")).filter(plausible(F.col("v")))
    cells = samples.groupBy("bus_id", "hour").agg(F.least(F.count("*"), F.lit(SAMPLES)).alias("held"), F.min("time_ms").alias("oldest"))
    return cells.agg(F.count_distinct("bus_id").alias("buses"), F.coalesce(F.sum("held"), F.lit(0)).alias("samples"), F.count("*").alias("cells"), F.min("oldest").alias("oldest_ms"))
