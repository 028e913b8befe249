"""Speeds between ticks, outlier correction, trust weights and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, EARTH_KM_SHORT, grid_cell, grid_step, haversine, round_half_up
from ..functions.speed import MODES, effective_speed, is_moving
from ..functions.timeparts import day_number, ms_of_day
from .medians import ranked

BIN_MS = 13 * 60_000
#: Fixed values of the trust weight: offset, floor, the speed above which it is cut, and the trust without a second speed.
TRUST_OFFSET, TRUST_FLOOR, TRUST_TOP, TRUST_FAST_KMH, TRUST_FAST_FACTOR, TRUST_ALONE = 10.0, 0.1, 1.0, 120.0, 0.1, 0.7


def with_previous_tick(positions: DataFrame) -> DataFrame:
    """Adds what a bus did since the tick just before: has_previous, dt_s, moved_m, calc_kmh (unrounded).

    A bus that misses a tick has no previous one. A step in time that is not forward gives no
    speed; the row stays. A bus twice in a tick keeps both rows, the later is the next's previous.
    """
    track = Window.partitionBy("bus_id").orderBy("tick_id", "event_id")
    # the last row of an earlier tick, over rows of the same tick; both windows share the bus's shuffle
    prior = F.struct("tick_id", "time_ms", "lat", "lon")
    first = positions.withColumn("_lag", F.lag(prior).over(track))
    before = F.first("_lag").over(Window.partitionBy("bus_id", "tick_id").orderBy("event_id"))
    rows = first.withColumn("_prev", before)
    rows = rows.withColumn("_prev", F.when(F.col("tick_id") - F.col("_prev.tick_id") == 1, F.col("_prev")))
    rows = rows.withColumn("dt_s", (F.col("time_ms") - F.col("_prev.time_ms")) / 1000).withColumn("moved_m", haversine(F.col("_prev.lat"), F.col("_prev.lon"), F.col("lat"), F.col("lon"), EARTH_KM) * 1000)
    calc = F.when(F.col("dt_s") > 0, F.col("moved_m") / F.when(F.col("dt_s") > 0, F.col("dt_s")) * 3.6)
    return rows.withColumn("has_previous", F.col("_prev").isNotNull()).withColumn("calc_kmh", calc).drop("_lag", "_prev")


def with_motion(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(is_moving(F.col("has_previous"), F.col("moved_m"), F.col("speed")), "Moving").otherwise("Stationary"))


def trust_weighted(rows: DataFrame) -> DataFrame:
    """Adds trust_score (2 decimals) and weighted_speed (1): the mean of a bus's last five speeds of the local day by trust."""
    gps, calc = F.col("speed"), F.col("calc_kmh")
    agree = 1 - F.abs(gps - calc) / (F.greatest(gps, calc, F.lit(1.0)) + TRUST_OFFSET)
    trust = F.when(calc.isNull(), F.lit(TRUST_ALONE)).otherwise(F.greatest(F.lit(TRUST_FLOOR), F.least(F.lit(TRUST_TOP), agree)))
    trust = F.when(gps > TRUST_FAST_KMH, trust * TRUST_FAST_FACTOR).otherwise(trust)
    last = Window.partitionBy("bus_id", day_number(F.col("time_ms"))).orderBy("tick_id", "event_id").rowsBetween(-4, 0)
    rows = rows.withColumn("_trust", trust)
    weighted = F.sum(gps * F.col("_trust")).over(last) / F.sum("_trust").over(last)
    return rows.withColumn("weighted_speed", round_half_up(weighted, 1)).withColumn("trust_score", round_half_up(F.col("_trust"), 2)).drop("_trust")


def correct_outliers(rows: DataFrame, method: str = "iqr", value: str = "speed") -> DataFrame:
    """Adds speed_corrected, each tick's speeds corrected across its buses.

    iqr clips to the quartiles by 1.5 ranges, robust to the median by 1.5 ranges, percentile
    and minmax to the 5th and 95th percentiles; zscore leaves out what lies over 2.5 standard
    deviations off and clips to three around what is left. Fewer than four values, or no
    spread, change nothing. A missing speed stays missing.
    """
    v = F.col(value)
    stats = rows.filter(v.isNotNull()).groupBy("tick_id")
    if method == "zscore":
        first = stats.agg(F.count("*").alias("n"), F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd"))
        kept = rows.filter(v.isNotNull()).join(first, "tick_id").filter((F.col("sd") > 0) & (F.abs(v - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")) <= 2.5))
        bounds = first.select("tick_id", "n").join(kept.groupBy("tick_id").agg(F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd")), "tick_id")
        low, high = F.col("mu") - 3 * F.col("sd"), F.col("mu") + 3 * F.col("sd")
        bounds = bounds.filter("sd > 0")
    else:
        bounds = stats.agg(F.count("*").alias("n"), F.percentile(v, [0.05, 0.25, 0.5, 0.75, 0.95]).alias("q"))
        q = lambda k: F.col("q")[k]
        reach = 1.5 * (q(3) - q(1))
        low, high = {"iqr": (q(1) - reach, q(3) + reach), "robust": (q(2) - reach, q(2) + reach)}.get(method, (q(0), q(4)))
    bounds = bounds.filter("n >= 4").select("tick_id", low.alias("_low"), high.alias("_high"))
    joined = rows.join(bounds, "tick_id", "left")
    clipped = F.when(v.isNull() | F.col("_low").isNull(), v).otherwise(F.greatest(F.col("_low"), F.least(F.col("_high"), v)))
    return joined.withColumn("speed_corrected", clipped).drop("_low", "_high")


def speed_timeline(positions: DataFrame) -> DataFrame:
    """(bus_id, day, bin, mode columns): means in 13-minute bins from local midnight, by sample the raw speed where a mode has none.

    A mean is taken to nine decimals and then to two, so that the order of summing never shows.
    """
    bin_no = F.floor(ms_of_day(F.col("time_ms")) / F.lit(BIN_MS)).cast("int")
    keyed = positions.select("bus_id", day_number(F.col("time_ms")).alias("day"), bin_no.alias("bin"), *[effective_speed(m).alias(m) for m in MODES])
    return keyed.groupBy("bus_id", "day", "bin").agg(*[round_half_up(round_half_up(F.avg(m), 9), 2).alias(m) for m in MODES], F.count("*").alias("n"))


def bin_start_ms(day: Column, bin_no: Column) -> Column:
    return day * 86_400_000 - 28_800_000 + bin_no * BIN_MS


def timeline_stats(timeline: DataFrame, mode: str = "raw") -> DataFrame:
    """(bus_id, mean, highest, lowest, bins) of the bin means."""
    return timeline.filter(F.col(mode).isNotNull()).groupBy("bus_id").agg(F.avg(mode).alias("mean"), F.max(mode).alias("highest"), F.min(mode).alias("lowest"), F.count("*").alias("bins"))


def fleet_summary(fleet: DataFrame, mode: str = "trust") -> DataFrame:
    """(vehicles, routes, median_speed): the upper median of the positive effective speeds."""
    v = effective_speed(mode)
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC)")
    return fleet.withColumn("v", F.when((v > 0) & ~F.isnan(v), v)).agg(F.count_distinct("bus_id").alias("vehicles"), F.count_distinct("route").alias("routes"), upper.alias("median_speed"))


def recent_trail(positions: DataFrame, n: int = 20) -> DataFrame:
    """(bus_id, trail): each bus's last n points in time order, across absences and midnight."""
    newest = Window.partitionBy("bus_id").orderBy(F.desc("time_ms"), F.desc("event_id"))
    last = positions.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n)
    return last.groupBy("bus_id").agg(F.array_sort(F.collect_list(F.struct("time_ms", "event_id", "lat", "lon", "speed"))).alias("trail"))


def last_known(positions: DataFrame) -> DataFrame:
    """Each bus's last row, with the route of its first."""
    at = F.struct("time_ms", "event_id")
    return positions.groupBy("bus_id").agg(F.max_by(F.struct("time_ms", "lat", "lon", "speed"), at).alias("l"), F.min_by("route", at).alias("route")).select("bus_id", "route", "l.*")


def even_sample(positions: DataFrame, n: int = 200) -> DataFrame:
    """Rows at floor(i * length / n) of each bus's track, the last one being its final row; short tracks whole."""
    rows = ranked(positions, ["bus_id"])
    length, i = F.col("_len"), F.col("_i")
    # i is taken where some k < n has floor(k * length / n) = i; the last k takes the final row
    k = F.ceil(i * n / length)
    taken = (F.floor(k * length / F.lit(n)) == i) & (k < n - 1)
    return rows.filter((length <= n) | taken | (i == length - 1)).drop("_i", "_len")


def spatial_sample(positions: DataFrame, most: int, metres: float = 200.0) -> DataFrame:
    """All rows if they are few; else about ``most``, each cell giving up to ceil(most / cells) at an even stride."""
    step = grid_step(metres)
    rows = positions.withColumn("_y", grid_cell(F.col("lat"), step)).withColumn("_x", grid_cell(F.col("lon"), step))
    cells = rows.groupBy("_y", "_x").agg(F.count("*").alias("_n"))
    whole = cells.agg(F.sum("_n").alias("_all"), F.greatest(F.lit(1), F.ceil(F.lit(most) / F.count("*"))).alias("_cap"))
    placed = ranked(rows, ["_y", "_x"]).crossJoin(F.broadcast(whole))  # one row
    cap, n, i = F.col("_cap"), F.col("_len"), F.col("_i")
    strided = F.floor(F.ceil(i * cap / n) * n / cap) == i
    return placed.filter((F.col("_all") <= most) | (n <= cap) | (strided & (F.ceil(i * cap / n) < cap))).drop("_y", "_x", "_len", "_all", "_cap", "_i")


def moving_average(positions: DataFrame, n: int = 3) -> DataFrame:
    """Adds smooth_speed: the mean of a bus's last n speeds, each from distance over time where missing."""
    track = Window.partitionBy("bus_id").orderBy("time_ms", "event_id")
    dt = (F.col("time_ms") - F.lag("time_ms").over(track)) / 1000
    moved = haversine(F.lag("lat").over(track), F.lag("lon").over(track), F.col("lat"), F.col("lon"), EARTH_KM_SHORT) * 1000
    rows = positions.withColumn("_dt", dt).withColumn("_m", moved)
    rows = rows.withColumn("_v", F.coalesce("speed", F.when(F.col("_dt") > 0, F.col("_m") / F.when(F.col("_dt") > 0, F.col("_dt")) * 3.6)))
    return rows.withColumn("smooth_speed", F.avg("_v").over(track.rowsBetween(1 - n, 0))).drop("_dt", "_m", "_v")


def empty_streak(sweeps: DataFrame) -> DataFrame:
    """Adds streak: consecutive sweeps of a source up to this one without vehicles (K9)."""
    order = Window.partitionBy("source_idx").orderBy("sweep_id")
    runs = sweeps.withColumn("_run", F.sum(F.when(F.col("vehicles") > 0, 1).otherwise(0)).over(order))
    inside = Window.partitionBy("source_idx", "_run").orderBy("sweep_id")
    return runs.withColumn("streak", F.sum(F.when(F.col("vehicles") > 0, 0).otherwise(1)).over(inside)).drop("_run")


