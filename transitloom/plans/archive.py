"""Queries of the archive, weather and streaming operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import history, weather
from ..streaming import keyed, live
from ..operators import crossday, heatmap
from ..runtime import shared_dir
from . import fixtures as fx
from .base import DAY, HOUR, MS_OF_DAY, half_up, query
from .matching import _KALMAN

_LOOSE = [
    "CASE WHEN k % 13 = 0 THEN NULL ELSE bus_id END AS bus_id", "CASE WHEN k % 9 = 0 THEN NULL ELSE route END AS route", "time_ms AS time",
    "CASE WHEN k % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN k % 17 = 0 THEN NULL ELSE lat END AS lat", "lon", "speed",
    "CASE WHEN k % 2 = 0 THEN speed / 2 END AS speed_corrected", "CAST(NULL AS DOUBLE) AS calculated_speed", "CAST(NULL AS DOUBLE) AS speed_kalman", "CAST(NULL AS DOUBLE) AS weighted_speed", "CAST(NULL AS DOUBLE) AS trust_score",
    "CASE WHEN k % 22 = 0 THEN lat END AS adj_lat", "CASE WHEN k % 22 = 0 THEN lon END AS adj_lon", "CAST(NULL AS {text}) AS snap_shape_id", "CAST(NULL AS DOUBLE) AS snap_cumdist",
]


@query("s3_clean_history", f"WITH {fx.POS_SPARSE}, l AS (SELECT event_id, {', '.join(_LOOSE).format(text='VARCHAR')} FROM pos), f AS (SELECT *, CASE WHEN NOT isnan(lat) THEN lat END AS flat FROM l) SELECT event_id, bus_id, coalesce(route, 'Unknown') AS route, coalesce(speed_corrected, speed) AS speed_corrected, flat IS NULL AS adjusted FROM f WHERE bus_id IS NOT NULL AND (flat IS NOT NULL OR adj_lat IS NOT NULL)")
def s3(spark, sf_dir):
    rows = history.clean_history(fx.pos_sparse(spark, sf_dir).selectExpr("event_id", *[x.format(text="STRING") for x in _LOOSE]))
    return rows.select("event_id", "bus_id", "route", "speed_corrected", F.col("lat").isNull().alias("adjusted"))


@query("s2_normalize", f"WITH {fx.POS_SPARSE} SELECT event_id, time_ms AS time, CASE WHEN k % 2 = 0 THEN speed ELSE speed / 2 END AS speed, CASE WHEN k % 3 = 0 THEN 'ktmb' ELSE 'rapid-bus-kl' END AS feed_source FROM pos")
def s2(spark, sf_dir):
    legacy = fx.pos_sparse(spark, sf_dir).selectExpr("event_id", "time_ms AS t", "CASE WHEN k % 2 = 0 THEN speed END AS speed", "speed / 2 AS speed_raw", "CASE WHEN k % 3 = 0 THEN 'ktmb' END AS feed_source")
    return history.normalize(legacy).select("event_id", "time", "speed", "feed_source")


# every position is listed; a source of a day is unreadable by a rule on both, so some days have none of the first choice and some have none at all
_SOURCE = "CASE u % 3 WHEN 0 THEN 'local_parquet' WHEN 1 THEN 'jsonl' ELSE 'history_parquet' END"
_READABLE = "(day * 3 + length(source)) % 4 <> 0 AND day % 7 <> 3"
_LIST = f"SELECT *, {_READABLE} AS readable FROM (SELECT {DAY} AS day, {_SOURCE} AS source, count(*) AS size_bytes, max(time_ms) AS mtime_ms FROM pos GROUP BY ALL)"
_CATALOG = f"{fx.POS_SPARSE}, ls AS ({_LIST}), ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY CASE source WHEN 'local_parquet' THEN 0 WHEN 'jsonl' THEN 1 ELSE 2 END) AS i FROM ls WHERE readable) WHERE i = 1)"


def _catalog(spark, sf_dir):
    listed = fx.pos_sparse(spark, sf_dir).selectExpr("(time_ms + 28800000) div 86400000 AS day", "time_ms", f"{_SOURCE} AS source")
    listed = listed.groupBy("day", "source").agg(F.count("*").alias("size_bytes"), F.max("time_ms").alias("mtime_ms"))
    return history.day_catalog(listed.withColumn("readable", F.expr(_READABLE)))


@query("s4_day_catalog", f"WITH {_CATALOG} SELECT day, source, size_bytes, mtime_ms FROM ct")
def s4(spark, sf_dir):
    return _catalog(spark, sf_dir)


@query("s5_store_stats", f"WITH {_CATALOG} SELECT count(*) AS days, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (source = 'jsonl') AS jsonl_days, count(*) FILTER (source <> 'jsonl') AS parquet_days, max(day) AS newest FROM ct")
def s5(spark, sf_dir):
    return history.store_stats(_catalog(spark, sf_dir))


_TEXT = [
    "bus_id", "CASE WHEN k % 9 = 0 THEN '' ELSE route END AS route", "CAST(time_ms AS {text}) AS time", "CASE WHEN k % 10 = 0 THEN 'bad' ELSE CAST(speed AS {text}) END AS speed",
    "CASE WHEN k % 8 = 0 THEN '1063.6' WHEN k % 8 = 1 THEN 'x' ELSE '1000' END AS weather_code",
]


@query("s7_compacted_rows", f"WITH {fx.POS_SPARSE}, x AS (SELECT event_id, {', '.join(_TEXT).format(text='VARCHAR')} FROM pos) SELECT bus_id, CASE WHEN route = '' THEN 'Unknown' ELSE route END AS route, CAST(time AS BIGINT) AS time, TRY_CAST(speed AS DOUBLE) AS speed, CAST(floor(TRY_CAST(weather_code AS DOUBLE) + 0.5) AS INT) AS weather_code FROM x")
def s7(spark, sf_dir):
    rows = fx.pos_sparse(spark, sf_dir).selectExpr(*[x.format(text="STRING") for x in _TEXT])
    for f in history.POSITION.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast("string"))
    return history.typed(rows).select("bus_id", "route", "time", "speed", "weather_code")


@query("j8_with_weather", f"WITH {fx.POS_SPARSE}, {fx.WEATHER} SELECT event_id, temp AS weather_temp, {'floor(precip * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE'} AS weather_precip, code AS weather_code FROM pos LEFT JOIN weather ON day_no = {DAY} AND hr = {HOUR} AND u % 2 = 0")
def j8(spark, sf_dir):
    rows = fx.pos_sparse(spark, sf_dir).withColumn("feed_source", F.when(F.col("u") % 2 == 0, "rapid-bus-kl").otherwise("ktmb"))
    found = weather.with_weather(rows, fx.weather(spark), history.DEFAULT_SOURCE)
    return found.select("event_id", "weather_temp", geo.round_half_up(F.col("weather_precip"), 6).alias("weather_precip"), "weather_code")


@query("s11_weather_range", f"WITH {fx.POS_SPARSE}, {fx.WEATHER}, sp AS (SELECT CAST(d AS INT) AS day_no, CAST(h AS INT) AS hr FROM range((SELECT min({DAY}) FROM pos), (SELECT max({DAY}) + 1 FROM pos)) AS g(d), range(24) AS i(h)) SELECT day_no, hr, temp, CASE WHEN code IS NULL THEN 'Unknown' WHEN code = 1183 THEN 'Light rain' WHEN code = 1000 THEN 'Clear' WHEN code = 1003 THEN 'Partly cloudy' WHEN code = 1063 THEN 'Patchy rain' ELSE 'Code ' || code END AS label, coalesce(precip > 0, false) OR coalesce(code IN (1183, 1063), false) AS rainy FROM sp LEFT JOIN weather USING (day_no, hr)")
def s11(spark, sf_dir):
    day = F.expr("(time_ms + 28800000) div 86400000")
    first, last = fx.pos_sparse(spark, sf_dir).agg(F.min(day), F.max(day)).first()
    if first is None:
        first, last = 0, -1
    windows = [weather.weather_range(spark, fx.weather(spark), k, min(last, k + weather.MOST_DAYS - 1)) for k in range(first, last + 1, weather.MOST_DAYS)]
    return reduce(DataFrame.union, windows).select("day_no", "hr", "temp", "label", "rainy")


@query("s10_flatten_weather", f"WITH {fx.POS_SPARSE} SELECT strftime(DATE '1970-01-01' + CAST({DAY} AS INT), '%Y-%m-%d') AS date, CAST({HOUR} AS INT) AS \"hour\", CASE WHEN {HOUR} = 5 THEN 99::DOUBLE ELSE CAST(count(*) AS DOUBLE) END AS temp, CAST(max(k) AS DOUBLE) AS chance_of_rain FROM pos GROUP BY {DAY}, {HOUR}")
def s10(spark, sf_dir):
    hours = fx.pos_sparse(spark, sf_dir).selectExpr("date_format(date_from_unix_date(CAST((time_ms + 28800000) div 86400000 AS INT)), 'yyyy-MM-dd') AS date", "lpad(CAST(((time_ms + 28800000) % 86400000) div 3600000 AS STRING), 2, '0') AS h", "k")
    hours = hours.groupBy("date", "h").agg(F.count("*").cast("double").alias("temp_c"), F.max("k").cast("double").alias("chance_of_rain"))
    days = hours.groupBy("date").agg(F.collect_list(F.struct(F.concat_ws(" ", "date", F.concat("h", F.lit(":00"))).alias("time"), "temp_c", "chance_of_rain")).alias("hour"))
    now = F.when(F.exists("hour", lambda x: F.substring(x["time"], 12, 2) == "05"), F.struct(F.struct(F.concat("date", F.lit(" 05:20")).alias("localtime")).alias("location"), F.struct(F.lit(99.0).alias("temp_c")).alias("current")))
    report = F.struct(F.struct(F.array(F.struct("date", "hour")).alias("forecastday")).alias("forecast"), now["location"].alias("location"), now["current"].alias("current"))
    return weather.flatten_weather(days.select(F.to_json(report).alias("json"))).select("date", "hour", "temp", "chance_of_rain")


#: Ticks of a replayed range: at least, at most, and the ranges that a history in between is dealt to.
LEAST_TICKS, MOST_TICKS, RANGES = 30, 2000, 4


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _dense(spark, sf_dir, folder: str, shift_ms: int = 0) -> DataFrame:
    """The dense positions, numbered and written once, dealt by tick and event, all times moved by shift_ms."""
    moved = fx.pos_dense(spark, sf_dir)
    if shift_ms:
        moved = moved.withColumn("time_ms", F.col("time_ms") + F.lit(shift_ms))
    moved.repartitionByRange("tick_id", "event_id").write.parquet(f"{folder}/dense")
    return spark.read.parquet(f"{folder}/dense")


def _replay_rows(spark, pos: DataFrame, folder: str, run) -> None:
    """Runs a stream over positions once for each range of ticks, in their order.

    Each range is as many files as it has tasks and is taken as one micro-batch; ranges widen
    with the history up to MOST_TICKS, beyond which there are more of them.
    """
    last = pos.agg(F.max("tick_id")).first()[0] or 1
    width = min(max(LEAST_TICKS, -(-last // RANGES)), MOST_TICKS)
    for start in range(0, last, width):
        pos.filter((F.col("tick_id") > start) & (F.col("tick_id") <= start + width)).write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(pos.schema).parquet(f"{folder}/in")).awaitTermination()


def _replay(spark, sf_dir, folder: str, run) -> None:
    """Runs a stream over the dense positions, range by range."""
    _replay_rows(spark, _dense(spark, sf_dir, folder), folder, run)


@query("k2_kalman_stream", _KALMAN)
def k2(spark, sf_dir):
    """The streamed filter over replayed positions."""
    folder = _folder(spark)
    sink = lambda out: out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    _replay(spark, sf_dir, folder, lambda ticks: sink(live.kalman_stream(ticks)))
    return spark.read.parquet(f"{folder}/out").select("event_id", geo.round_half_up(F.col("speed_kalman"), 4).alias("speed_kalman"))


@query("k11_warm_filter", f"WITH {fx.POS_DENSE} SELECT q.* FROM ({_KALMAN}) AS q JOIN pos USING (event_id) WHERE tick_id > (SELECT max(tick_id) // 2 FROM pos)")
def k11f(spark, sf_dir):
    """The filter of the later half of ticks, by a session that starts from the state of the stored earlier half."""
    folder = _folder(spark)
    fx.pos_dense(spark, sf_dir).write.parquet(f"{folder}/dense")
    pos = spark.read.parquet(f"{folder}/dense")
    half = (pos.agg(F.max("tick_id")).first()[0] or 0) // 2
    pos.filter(F.col("tick_id") > half).write.parquet(f"{folder}/in")
    states = live.kalman_state(pos.filter(F.col("tick_id") <= half))
    with keyed.with_rocksdb(spark, pos.count()):
        out = live.kalman_stream(spark.readStream.schema(pos.schema).parquet(f"{folder}/in"), states)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, speed_kalman double").parquet(f"{folder}/out").select("event_id", geo.round_half_up(F.col("speed_kalman"), 4).alias("speed_kalman"))


#: From the positions' first tick, 06:00, to two minutes before local midnight, so that streams cross it.
_TO_MIDNIGHT = 17 * 3_600_000 + 58 * 60_000
_MOVED = f"{fx.POS_DENSE.replace('pos AS (', 'pos0 AS (')}, pos AS (SELECT * REPLACE (time_ms + {_TO_MIDNIGHT} AS time_ms) FROM pos0)"
_LIVE = "s AS (SELECT *, {day} AS day_no, CAST({hour} AS INT) AS hour_no FROM pos WHERE speed BETWEEN 0 AND 200), r AS (SELECT *, row_number() OVER (PARTITION BY day_no, route, hour_no, bus_id ORDER BY time_ms DESC, event_id DESC) AS i FROM s), b AS (SELECT day_no, route, hour_no, bus_id, median(speed) AS m FROM r WHERE i <= 60 GROUP BY ALL)".format(day=DAY, hour=HOUR)
_LIVE_CELLS = 'route, hour_no AS "hour", floor(median(m) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS "value", count(*) AS n FROM b'


_CELLS = "day long, route string, hour int, value double, bin string, n long, version long"
_BINS = "bus_id string, day long, bin int, raw double, corrected double, calc double, kalman double, trust double, n long, version long"


def _live(spark, sf_dir, view, schema: str, keys: list[str], shift_ms: int) -> DataFrame:
    """A view's rows after the whole stream, each micro-batch of which read its own positions alone."""
    folder = _folder(spark)
    pos = _dense(spark, sf_dir, folder, shift_ms)
    with keyed.with_rocksdb(spark, pos.count()):
        _replay_rows(spark, pos, folder, lambda ticks: keyed.keep(view(ticks), f"{folder}/view", f"{folder}/log"))
    return keyed.newest(spark.read.schema(schema).parquet(f"{folder}/view"), keys)


@query("k6_live_heatmap", f"WITH {fx.POS_DENSE}, {_LIVE} SELECT {_LIVE_CELLS} GROUP BY day_no, route, hour_no")
def k6(spark, sf_dir):
    return _live(spark, sf_dir, keyed.live_heatmap, _CELLS, ["day", "route", "hour"], 0).select("route", "hour", "value", "n")


@query("k6_live_over_midnight", f"WITH {_MOVED}, {_LIVE} SELECT CAST(day_no AS BIGINT) AS day_no, {_LIVE_CELLS} GROUP BY day_no, route, hour_no")
def k6m(spark, sf_dir):
    found = _live(spark, sf_dir, keyed.live_heatmap, _CELLS, ["day", "route", "hour"], _TO_MIDNIGHT)
    return found.select(F.col("day").alias("day_no"), "route", "hour", "value", "n")


_TIMELINE = f"SELECT bus_id, CAST({DAY} AS BIGINT) AS day_no, CAST({MS_OF_DAY} // 780000 AS INT) AS bin, {half_up(half_up('avg(speed)', 9), 2)} AS raw, count(*) AS n FROM pos GROUP BY ALL"


@query("k6_live_timeline", f"WITH {_MOVED} {_TIMELINE}")
def k6t(spark, sf_dir):
    found = _live(spark, sf_dir, keyed.live_timeline, _BINS, ["bus_id", "day", "bin"], _TO_MIDNIGHT)
    return found.select("bus_id", F.col("day").alias("day_no"), "bin", "raw", "n")


def _resumed(spark, sf_dir, view, schema: str, by_day: bool = True, shift_ms: int = _TO_MIDNIGHT) -> tuple[DataFrame, DataFrame]:
    """The stored first half of the ticks, and the rows that a session which starts from its state adds over the second."""
    folder = _folder(spark)
    moved = fx.pos_dense(spark, sf_dir).withColumn("time_ms", F.col("time_ms") + F.lit(shift_ms))
    moved.write.parquet(f"{folder}/dense")
    pos = spark.read.parquet(f"{folder}/dense")
    half = (pos.agg(F.max("tick_id")).first()[0] or 0) // 2
    stored = pos.filter(F.col("tick_id") <= half)
    pos.filter(F.col("tick_id") > half).write.parquet(f"{folder}/in")
    with keyed.with_rocksdb(spark, pos.count()):
        ticks = spark.readStream.schema(pos.schema).parquet(f"{folder}/in")
        keyed.keep(view(ticks, stored), f"{folder}/view", f"{folder}/log", by_day).awaitTermination()
    return stored, spark.read.schema(schema).parquet(f"{folder}/view")


@query("k11_warm_restart", f"WITH {_MOVED}, {_LIVE} SELECT {_LIVE_CELLS} WHERE day_no = (SELECT max({DAY}) FROM pos) GROUP BY route, hour_no")
def k11(spark, sf_dir):
    """The newest day's heatmap of a session that started midway from the rings of stored rows."""
    view = lambda ticks, stored: keyed.live_heatmap(ticks, warm=keyed.stored_rings(stored))
    stored, changes = _resumed(spark, sf_dir, view, _CELLS)
    cells = keyed.newest(keyed.stored_cells(keyed.stored_rings(stored)).select(*changes.columns).union(changes), ["day", "route", "hour"])
    newest = cells.agg(F.max("day")).first()[0] or 0
    return cells.filter(F.col("day") == newest).select("route", "hour", "value", "n")


@query("k11_warm_timeline", f"WITH {_MOVED} {_TIMELINE}")
def k11t(spark, sf_dir):
    """Timelines of a session that started midway from the sums of stored rows."""
    view = lambda ticks, stored: keyed.live_timeline(ticks, keyed.stored_bins(stored))
    stored, changes = _resumed(spark, sf_dir, view, _BINS)
    first = keyed.stored_timeline(keyed.stored_bins(stored)).select(*changes.columns)
    bins = keyed.newest(first.union(changes), ["bus_id", "day", "bin"])
    return bins.select("bus_id", F.col("day").alias("day_no"), "bin", "raw", "n")


@query("k11_warm_trail", f"WITH {fx.POS_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY time_ms DESC, event_id DESC) AS i FROM pos) SELECT bus_id, count(*) AS n, string_agg(event_id, ',' ORDER BY time_ms, event_id) AS events FROM r WHERE i <= 20 GROUP BY bus_id")
def k11tr(spark, sf_dir):
    """Trails of a session that started midway from the last points of stored rows."""
    view = lambda ticks, stored: keyed.live_trails(ticks, warm=keyed.stored_trails(stored))
    stored, changes = _resumed(spark, sf_dir, view, "bus_id string, time_ms long, event_id long, lat double, lon double, speed double, version long", False, 0)
    first = keyed.stored_trails(stored).withColumn("version", F.lit(0).cast("long")).select(*changes.columns)
    points = keyed.newest(first.union(changes), ["bus_id"])
    ordered = F.array_sort(F.collect_list(F.struct("time_ms", "event_id")))
    return points.groupBy("bus_id").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda p: p["event_id"].cast("string")), ",").alias("events"))


@query("k10_without_repeats", f"WITH {fx.POS_DENSE} SELECT bus_id, tick_id, count(*) OVER () AS whole FROM pos GROUP BY bus_id, tick_id")
def k10(spark, sf_dir):
    """Every position comes twice and one of each stays, within a day's delay."""
    folder = _folder(spark)

    def run(ticks):
        twice = ticks.select("bus_id", "tick_id", F.timestamp_millis(F.col("time_ms")).alias("at")).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
        once = live.without_repeats(twice, "at", "1 day")
        return once.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()

    _replay(spark, sf_dir, folder, run)
    found = spark.read.parquet(f"{folder}/out")
    return found.select("bus_id", "tick_id", F.lit(found.count()).cast("long").alias("whole"))


@query("a21_heatmap_stats", f"WITH {fx.POS_SPARSE}, c AS (SELECT bus_id, {HOUR} AS h, least(count(*), 60) AS held, min(time_ms) AS oldest FROM pos WHERE speed BETWEEN 0 AND 200 GROUP BY ALL) SELECT count(DISTINCT bus_id) AS buses, CAST(coalesce(sum(held), 0) AS BIGINT) AS samples, count(*) AS cells, min(oldest) AS oldest_ms FROM c")
def a21(spark, sf_dir):
    return heatmap.heatmap_stats(fx.pos_sparse(spark, sf_dir))


@query("u4_days_missing", f"WITH {fx.POS_SPARSE} SELECT DISTINCT {DAY} AS day FROM pos WHERE {DAY} NOT IN (SELECT {DAY} FROM pos WHERE {DAY} % 3 = 1)")
def u4d(spark, sf_dir):
    days = fx.pos_sparse(spark, sf_dir).selectExpr("(time_ms + 28800000) div 86400000 AS day")
    return crossday.days_missing(days, days.filter("day % 3 = 1"))


@query("s6_k10_append_ticks", f"WITH {fx.POS_DENSE} SELECT CAST(DATE '1970-01-01' + CAST((time_ms + 600000 * k + 28800000) // 86400000 AS INT) AS DATE) AS ingest_date, count(*) AS n FROM pos GROUP BY ALL")
def s6(spark, sf_dir):
    folder = _folder(spark)
    arrived = lambda ticks: ticks.withColumn("arrival_ms", F.col("time_ms") + 600_000 * F.col("k"))
    _replay(spark, sf_dir, folder, lambda ticks: live.append_ticks(arrived(ticks), f"{folder}/table", f"{folder}/log"))
    return spark.read.parquet(f"{folder}/table").groupBy("ingest_date").agg(F.count("*").alias("n"))
