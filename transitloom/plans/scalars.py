"""Queries of the scalar functions and the heatmap, grid and timeline operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, labels, speed, timeparts
from ..operators import heatmap, speeds
from . import fixtures as fx
from .base import DAY, FRAC_HOUR, HOUR, MS_OF_DAY, STEP, X_SCALE, Y_SCALE, hav_sql, half_up, query, r6, s6

#: The other speed columns of the sparse positions, some of them missing.
_MODES = [
    "CASE WHEN k % 7 = 0 THEN NULL ELSE least(speed, 150.0D) END AS speed_corrected",
    "floor(speed * 2 + 0.5D) / 10 AS calculated_speed",
    "floor(speed * 9 + 0.5D) / 10 AS speed_kalman",
    "CASE WHEN k % 5 = 0 THEN NULL ELSE floor(speed * 8 + 0.5D) / 10 END AS weighted_speed",
    "CASE WHEN k % 10 = 0 THEN lat + 0.001D END AS adj_lat",
    "CASE WHEN k % 10 = 0 THEN lon - 0.001D END AS adj_lon",
]


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.pos_sparse(spark, sf_dir).selectExpr("*", *_MODES)


MODES_SQL = f"{fx.POS_SPARSE}, m AS (SELECT *, {fx._duck(', '.join(_MODES))} FROM pos)"
UNPIVOT = "u AS (" + " UNION ALL ".join(f"SELECT *, '{m}' AS mode, {c} AS v FROM m" for m, c in speed.MODES.items()) + ")"


def bin_sql(mode: str, v: str) -> str:
    edges = speed.fixed_edges(mode)
    steps = " ".join(f"WHEN {v} > {a!r}::DOUBLE AND {v} <= {b!r}::DOUBLE THEN '{label}'" for label, a, b in zip(speed.BIN_LABELS, edges, edges[1:]))
    return f"CASE WHEN {v} = 0 THEN 'stopped' WHEN {v} > {speed.SPIKE[mode]} THEN 'spike' {steps} END"


@query("p1_haversine", f"WITH {fx.POS_SPARSE} SELECT event_id, {s6(hav_sql('lat', 'lon', '3.139::DOUBLE', '101.6869::DOUBLE'))} AS km, {half_up(hav_sql('lat', 'lon', '3.139::DOUBLE', '101.6869::DOUBLE', '6371000'), 3)} AS m, {s6(hav_sql('lat', 'lon', '3.139::DOUBLE', '101.6869::DOUBLE', '6371'))} AS km_short FROM pos")
def p1(spark, sf_dir):
    pos = fx.pos_sparse(spark, sf_dir)
    to = [F.col("lat"), F.col("lon"), F.lit(geo.CENTRE_LAT), F.lit(geo.CENTRE_LON)]
    return pos.select("event_id", r6(geo.haversine(*to), "km"), geo.round_half_up(geo.haversine(*to, geo.EARTH_M), 3).alias("m"), r6(geo.haversine(*to, geo.EARTH_KM_SHORT), "km_short"))


@query("p2_local_xy", f"WITH {fx.POS_SPARSE}, xy AS (SELECT event_id, (lon - 101.6869::DOUBLE) * ({X_SCALE}) AS x, (lat - 3.139::DOUBLE) * ({Y_SCALE}) AS y FROM pos) SELECT event_id, {half_up('x', 3)} AS x, {half_up('y', 3)} AS y, {s6(f'y / ({Y_SCALE}) + 3.139::DOUBLE')} AS lat, {s6(f'x / ({X_SCALE}) + 101.6869::DOUBLE')} AS lon FROM xy")
def p2(spark, sf_dir):
    x, y = geo.local_x(F.col("lon")), geo.local_y(F.col("lat"))
    return fx.pos_sparse(spark, sf_dir).select("event_id", geo.round_half_up(x, 3).alias("x"), geo.round_half_up(y, 3).alias("y"), r6(geo.to_lat(y), "lat"), r6(geo.to_lon(x), "lon"))


@query("p3_local_time", f"WITH {fx.POS_SPARSE} SELECT event_id, CAST(DATE '1970-01-01' + CAST({DAY} AS INT) AS DATE) AS local_date, CAST({HOUR} AS INT) AS local_hour, {s6(FRAC_HOUR)} AS frac_hour, {DAY} * 86400000 - 28800000 AS midnight_ms FROM pos")
def p3(spark, sf_dir):
    t = F.col("time_ms")
    return fx.pos_sparse(spark, sf_dir).select("event_id", timeparts.local_date(t).alias("local_date"), timeparts.local_hour(t).alias("local_hour"), r6(timeparts.frac_hour(t), "frac_hour"), timeparts.midnight_ms(t).alias("midnight_ms"))


@query("p4_buckets", f"WITH {fx.POS_SPARSE} SELECT event_id, CAST({MS_OF_DAY} // 1800000 AS INT) AS slot, {s6(f'({MS_OF_DAY} // 1000) / 1800::DOUBLE')} AS slot_frac FROM pos")
def p4(spark, sf_dir):
    t = F.col("time_ms")
    return fx.pos_sparse(spark, sf_dir).select("event_id", timeparts.half_hour_bucket(t).alias("slot"), r6(timeparts.fractional_bucket(t), "slot_frac"))


@query("p5_round_half_up", f"WITH {fx.POS_SPARSE}, x AS (SELECT event_id, (k - 50) / 4::DOUBLE AS v FROM pos) SELECT event_id, {half_up('v', 0)} AS r0, {half_up('v', 1)} AS r1, {half_up('v / 7', 5)} AS r5 FROM x")
def p5(spark, sf_dir):
    v = (F.col("k") - 50) / 4.0
    return fx.pos_sparse(spark, sf_dir).select("event_id", geo.round_half_up(v).alias("r0"), geo.round_half_up(v, 1).alias("r1"), geo.round_half_up(v / 7, 5).alias("r5"))


@query("p6_p7_p8_speeds", f"WITH {MODES_SQL} SELECT event_id, coalesce({half_up('(CASE WHEN k % 9 = 0 THEN NULL ELSE speed END) * 3.6::DOUBLE', 1)}, 0) AS kmh, {s6('speed * 0.621371::DOUBLE')} AS mph, {s6('speed / 3.6::DOUBLE')} AS ms, coalesce(weighted_speed, speed) AS trust, coalesce(speed_corrected, speed) AS corrected FROM m")
def p6(spark, sf_dir):
    raw = F.when(F.col("k") % 9 != 0, F.col("speed"))
    return modes(spark, sf_dir).select("event_id", speed.raw_speed_kmh(raw).alias("kmh"), r6(speed.convert_speed(F.col("speed"), "mph"), "mph"), r6(speed.convert_speed(F.col("speed"), "m/s"), "ms"), speed.effective_speed("trust").alias("trust"), speed.effective_speed("corrected").alias("corrected"))


@query("p9_staleness", f"WITH {fx.POS_SPARSE}, a AS (SELECT event_id, coalesce(greatest(1706659200 - (CASE WHEN k % 10 = 0 THEN NULL ELSE time_ms // 1000 + k * 26000 END), 0), 0) AS age FROM pos) SELECT event_id, age, age > 90 AS stale FROM a")
def p9(spark, sf_dir):
    seen = F.when(F.col("k") % 10 != 0, F.floor(F.col("time_ms") / 1000) + F.col("k") * 26000)
    return fx.pos_sparse(spark, sf_dir).select("event_id", speed.age_s(F.lit(1706659200), seen).alias("age")).withColumn("stale", speed.is_stale(F.col("age")))


@query("p11_p12_classes", f"WITH {MODES_SQL} SELECT event_id, CASE WHEN weighted_speed IS NULL THEN 'none' WHEN weighted_speed < 20 THEN 'slow' WHEN weighted_speed < 40 THEN 'medium' ELSE 'fast' END AS class, CASE WHEN coalesce(weighted_speed, speed_kalman) IS NULL THEN 'none' WHEN (coalesce(weighted_speed, speed_kalman) + coalesce(speed_kalman, weighted_speed)) / 2 < 20 THEN 'slow' WHEN (coalesce(weighted_speed, speed_kalman) + coalesce(speed_kalman, weighted_speed)) / 2 < 40 THEN 'medium' ELSE 'fast' END AS segment, speed BETWEEN 0 AND 200 AS plausible FROM m")
def p11(spark, sf_dir):
    w, k = F.col("weighted_speed"), F.col("speed_kalman")
    return modes(spark, sf_dir).select("event_id", speed.speed_class(w).alias("class"), speed.segment_class(w, k).alias("segment"), speed.plausible(F.col("speed")).alias("plausible"))


_PERIOD = "CASE " + " ".join(f"WHEN h >= {a} AND h < {b} THEN '{k}'" if b <= 24 else f"WHEN h >= {a} OR h < {b - 24} THEN '{k}'" for k, (a, b) in timeparts.PERIODS.items()) + " END"


@query("p13_p14_periods", f"WITH {fx.POS_SPARSE}, x AS (SELECT event_id, {FRAC_HOUR} AS h FROM pos) SELECT event_id, {_PERIOD} AS period, h BETWEEN 6.5 AND 9 AS in_range FROM x")
def p13(spark, sf_dir):
    h = timeparts.frac_hour(F.col("time_ms"))
    return fx.pos_sparse(spark, sf_dir).select("event_id", timeparts.period_of(h).alias("period"), timeparts.in_hour_range(h, 6.5, 9.0).alias("in_range"))


@query("p15_fleet_filter", f"WITH {MODES_SQL} SELECT event_id, bus_id, route FROM m WHERE route <> 'Unknown' AND coalesce(weighted_speed, speed) > 1 AND (contains(lower(route), '3') OR contains(lower(bus_id), '3')) AND route IN (SELECT route FROM pos GROUP BY route HAVING count(*) >= 5)")
def p15(spark, sf_dir):
    from ..operators.routes import fleet_filter

    rows = modes(spark, sf_dir)
    members = rows.groupBy("route").count().filter("count >= 5").select("route")
    return fleet_filter(rows, hide_unknown=True, hide_stationary=True, mode="trust", search="3", routes=members).select("event_id", "bus_id", "route")


@query("p16_weather_labels", f"WITH {fx.WEATHER}, {fx.POS_SPARSE}, h AS (SELECT {DAY} AS d, {HOUR} AS h, count(*) AS n FROM pos GROUP BY ALL) SELECT day_no, hr, n, CASE code WHEN 1183 THEN 'Light rain' WHEN 1000 THEN 'Clear' WHEN 1003 THEN 'Partly cloudy' WHEN 1063 THEN 'Patchy rain' ELSE 'Code ' || code END AS label, precip > 0 OR code IN (1183, 1063) AS rainy FROM h JOIN weather ON d = day_no AND h = hr")
def p16(spark, sf_dir):
    t = F.col("time_ms")
    hours = fx.pos_sparse(spark, sf_dir).groupBy(timeparts.day_number(t).alias("day_no"), timeparts.local_hour(t).alias("hr")).agg(F.count("*").alias("n"))
    found = hours.join(F.broadcast(fx.weather(spark)), ["day_no", "hr"])  # 701 rows
    return found.select(F.col("day_no").cast("int").alias("day_no"), "hr", "n", labels.weather_label(F.col("code")).alias("label"), labels.is_rainy(F.col("precip"), F.col("code")).alias("rainy"))


@query("p17_p18_speed_bins", f"WITH {MODES_SQL}, {UNPIVOT} SELECT event_id, mode, CASE mode " + " ".join(f"WHEN '{m}' THEN {bin_sql(m, 'v')}" for m in speed.MODES) + " END AS bin FROM u")
def p17(spark, sf_dir):
    rows = heatmap.unpivot_modes(modes(spark, sf_dir), "event_id")
    return rows.select("event_id", "mode", speed.mode_bin(F.col("mode"), F.col("v")).alias("bin"))


@query("p21_service_progress", f"WITH {fx.POS_SPARSE}, x AS (SELECT event_id, least(({MS_OF_DAY} // 60000 + 1140) % 1440, 1230) AS m FROM pos) SELECT event_id, CAST(m AS INT) AS minutes, {s6('m / 1230::DOUBLE')} AS progress FROM x")
def p21(spark, sf_dir):
    m = timeparts.service_minutes(F.col("time_ms"))
    return fx.pos_sparse(spark, sf_dir).select("event_id", m.alias("minutes"), r6(m / 1230.0, "progress"))


@query("p22_unknown_route", f"WITH {fx.POS_SPARSE}, x AS (SELECT event_id, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'null' ELSE route END AS r FROM pos) SELECT event_id, r IS NULL OR r IN ('', 'Unknown') AS model, r IS NULL OR r IN ('', 'Unknown', 'null') AS learning FROM x")
def p22(spark, sf_dir):
    r = F.expr("CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'null' ELSE route END")
    return fx.pos_sparse(spark, sf_dir).select("event_id", labels.is_unknown_route(r).alias("model"), labels.is_unknown_route(r, learning=True).alias("learning"))


def _cells(keys: str, source: str) -> str:
    return f"r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, bus_id ORDER BY time_ms DESC, event_id DESC) AS k60 FROM {source} WHERE v BETWEEN 0 AND 200), b AS (SELECT {keys}, bus_id, median(v) AS m FROM r WHERE k60 <= 60 GROUP BY {keys}, bus_id), c AS (SELECT {keys}, median(m) AS x, count(*) AS n FROM b GROUP BY {keys})"


@query("a1_speed_heatmap", f"WITH {fx.POS_SPARSE}, s AS (SELECT *, CAST({HOUR} AS INT) AS hour_no, speed AS v FROM pos), {_cells('route, hour_no', 's')} SELECT route, hour_no AS \"hour\", {half_up('x', 2)} AS \"value\", {bin_sql('raw', 'x')} AS bin, n FROM c")
def a1(spark, sf_dir):
    return heatmap.speed_heatmap(fx.pos_sparse(spark, sf_dir))


@query("a2_speed_heatmap_all", f"WITH {MODES_SQL}, {UNPIVOT}, s AS (SELECT *, CAST({HOUR} AS INT) AS hour_no FROM u), {_cells('mode, route, hour_no', 's')} SELECT mode, route, hour_no AS \"hour\", {half_up('x', 2)} AS \"value\", CASE mode " + " ".join(f"WHEN '{m}' THEN {bin_sql(m, 'x')}" for m in speed.MODES) + " END AS bin, n FROM c")
def a2(spark, sf_dir):
    return heatmap.speed_heatmap_all(modes(spark, sf_dir))


@query("a3_pooled_anchors", f"WITH {MODES_SQL}, {UNPIVOT}, b AS (SELECT mode, {DAY} AS d, bus_id, median(v) AS x FROM u WHERE v BETWEEN 0 AND 200 GROUP BY ALL), p AS (SELECT mode, median(x) AS a, count(*) AS n FROM b GROUP BY mode) SELECT mode, CASE WHEN a > 0 THEN {s6('a')} END AS anchor, n FROM p")
def a3(spark, sf_dir):
    return heatmap.pooled_anchors(modes(spark, sf_dir)).select("mode", r6("anchor"), "n")


_GRID = f"g AS (SELECT floor(lat / {STEP} + 0.5) AS lat_bin, floor(lon / {STEP} + 0.5) AS lon_bin, count(DISTINCT bus_id) AS n FROM pos GROUP BY ALL)"


@query("a9_density_grid", f"WITH {fx.POS_SPARSE}, {_GRID} SELECT CAST(lat_bin AS BIGINT) AS lat_bin, CAST(lon_bin AS BIGINT) AS lon_bin, n AS count, {s6(f'lat_bin * {STEP}')} AS lat, {s6(f'lon_bin * {STEP}')} AS lon, {s6(f'lon_bin * {STEP} - {STEP} / 2')} AS west, {s6(f'lat_bin * {STEP} + {STEP} / 2')} AS north FROM g")
def a9(spark, sf_dir):
    grid = heatmap.density_grid(fx.pos_sparse(spark, sf_dir)).withColumn("p", heatmap.cell_polygon(F.col("lat"), F.col("lon")))
    return grid.select("lat_bin", "lon_bin", "count", r6("lat"), r6("lon"), r6(F.col("p")[0][0], "west"), r6(F.col("p")[2][1], "north"))


_Q = f"q AS (SELECT [CAST(greatest(floor(x + 0.5), 1) AS INT) FOR x IN list_value({', '.join(f'quantile_cont(n, {min((k + 1) / 6, 0.95 if k == 4 else 1)!r})' for k in range(5))})] AS r FROM g)"
_T = "t AS (SELECT list_value(a, b, c, d, e) AS thresholds FROM (SELECT *, CASE WHEN r[5] <= d THEN d + 1 ELSE r[5] END AS e FROM (SELECT *, CASE WHEN r[4] <= c THEN c + 1 ELSE r[4] END AS d FROM (SELECT *, CASE WHEN r[3] <= b THEN b + 1 ELSE r[3] END AS c FROM (SELECT *, r[1] AS a, CASE WHEN r[2] <= r[1] THEN r[1] + 1 ELSE r[2] END AS b FROM q)))))"


@query("a10_a11_density_classes", f"WITH {fx.POS_SPARSE}, {_GRID}, {_Q}, {_T} SELECT CAST(lat_bin AS BIGINT) AS lat_bin, CAST(lon_bin AS BIGINT) AS lon_bin, n AS count, CAST(CASE WHEN n <= thresholds[1] THEN 0 WHEN n <= thresholds[2] THEN 1 WHEN n <= thresholds[3] THEN 2 WHEN n <= thresholds[4] THEN 3 WHEN n <= thresholds[5] THEN 4 ELSE 5 END AS INT) AS class, thresholds FROM g CROSS JOIN t")
def a10(spark, sf_dir):
    grid = heatmap.density_grid(fx.pos_sparse(spark, sf_dir))
    classed = grid.crossJoin(F.broadcast(heatmap.density_thresholds(grid)))  # one row
    return classed.select("lat_bin", "lon_bin", "count", heatmap.density_class(F.col("count"), F.col("thresholds")).alias("class"), "thresholds")


@query("a11_density_ranks", f"WITH {fx.POS_SPARSE}, {_GRID}, d AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT n FROM g)) SELECT CAST(lat_bin AS BIGINT) AS lat_bin, CAST(lon_bin AS BIGINT) AS lon_bin, g.n AS count, CAST(CASE WHEN c = 1 THEN 6 ELSE least(floor(i / (c - 1)::DOUBLE * 7), 6) END AS INT) AS stop FROM g JOIN d ON g.n = d.n")
def a11(spark, sf_dir):
    return heatmap.density_rank_class(heatmap.density_grid(fx.pos_sparse(spark, sf_dir))).select("lat_bin", "lon_bin", "count", "stop")


@query("a12_compare_periods", f"WITH {fx.POS_SPARSE}, x AS (SELECT *, {FRAC_HOUR} AS h FROM pos), y AS (SELECT *, {_PERIOD} AS period FROM x) SELECT period, CAST(floor(lat / {STEP} + 0.5) AS BIGINT) AS lat_bin, CAST(floor(lon / {STEP} + 0.5) AS BIGINT) AS lon_bin, count(DISTINCT bus_id) AS count FROM y WHERE period IN ('morning_peak', 'evening_peak') GROUP BY ALL")
def a12(spark, sf_dir):
    rows = fx.pos_sparse(spark, sf_dir).withColumn("period", timeparts.period_of(timeparts.frac_hour(F.col("time_ms"))))
    return heatmap.density_grid(rows.filter(F.col("period").isin("morning_peak", "evening_peak")), 200.0, "period").drop("lat", "lon")


_HEX = f"h AS (SELECT *, lon / {STEP} * (sqrt(3::DOUBLE) / 3) - lat / {STEP} / 3 AS q, lat / {STEP} * (2 / 3::DOUBLE) AS r FROM pos WHERE speed BETWEEN 0 AND 200), hh AS (SELECT *, -q - r AS s, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM h), hd AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM hh)"


@query("a13_speed_hexbin", f"WITH {fx.POS_SPARSE}, {_HEX}, c AS (SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r, speed FROM hd) SELECT q, r, {s6('avg(speed)')} AS \"value\", count(*) AS n FROM c GROUP BY ALL")
def a13(spark, sf_dir):
    return heatmap.speed_hexbin(fx.pos_sparse(spark, sf_dir)).select("q", "r", r6("value"), "n")


@query("a15_busiest_day_bbox", f"WITH {MODES_SQL}, p AS (SELECT bus_id, {DAY} AS d, coalesce(adj_lat, lat) AS y, coalesce(adj_lon, lon) AS x FROM m), r AS (SELECT DISTINCT d FROM p ORDER BY d DESC LIMIT 14), b AS (SELECT bus_id, d, count(*) AS n, min(y) AS a, max(y) AS b, min(x) AS e, max(x) AS f FROM p WHERE d IN (SELECT d FROM r) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY n DESC, d DESC) AS i FROM b) SELECT bus_id, n, d AS day, {s6('a')} AS min_lat, {s6('b')} AS max_lat, {s6('e')} AS min_lon, {s6('f')} AS max_lon FROM k WHERE i = 1")
def a15(spark, sf_dir):
    return heatmap.busiest_day_bbox(modes(spark, sf_dir)).select("bus_id", "n", "day", r6("min_lat"), r6("max_lat"), r6("min_lon"), r6("max_lon"))


@query("a19_data_hour_range", f"WITH {fx.POS_SPARSE} SELECT CAST(floor(min({FRAC_HOUR})) AS INT) AS first_hour, CAST(least(ceil(max({FRAC_HOUR})), 23) AS INT) AS last_hour FROM pos")
def a19(spark, sf_dir):
    return heatmap.data_hour_range(fx.pos_sparse(spark, sf_dir))


@query("a20_principal_bearing", f"WITH {fx.POS_DENSE}, m AS (SELECT *, (min(lat) OVER (PARTITION BY bus_id) + max(lat) OVER (PARTITION BY bus_id)) / 2 AS mid FROM pos), x AS (SELECT bus_id, lat, lon * cos(radians(mid)) AS x FROM m), t AS (SELECT bus_id, count(*) AS n, -degrees(0.5 * atan2(2 * covar_pop(x, lat), var_pop(x) - var_pop(lat))) AS d FROM x GROUP BY bus_id), f AS (SELECT bus_id, n, CASE WHEN d > 90 THEN d - 180 WHEN d <= -90 THEN d + 180 ELSE d END AS d FROM t) SELECT bus_id, CASE WHEN n >= 3 THEN CAST(floor(d + 0.5) AS INT) END AS bearing FROM f")
def a20(spark, sf_dir):
    return heatmap.principal_bearing(fx.pos_dense(spark, sf_dir), "bus_id")


@query("t1_recent_days", f"WITH {fx.POS_SPARSE} SELECT DISTINCT {DAY} AS day FROM pos ORDER BY day DESC LIMIT 14")
def t1(spark, sf_dir):
    return heatmap.recent_days(fx.pos_sparse(spark, sf_dir).select(timeparts.day_number(F.col("time_ms")).alias("day")), 14)


@query("w3_latest_per_cell", f"WITH {fx.POS_SPARSE}, r AS (SELECT *, row_number() OVER (PARTITION BY route, {HOUR} ORDER BY time_ms DESC, event_id DESC) AS i FROM pos) SELECT event_id, route FROM r WHERE i <= 60")
def w3(spark, sf_dir):
    rows = fx.pos_sparse(spark, sf_dir).withColumn("hour", timeparts.local_hour(F.col("time_ms")))
    return heatmap.latest_per_cell(rows, ["route", "hour"], ["time_ms", "event_id"]).select("event_id", "route")


_PREV = f"{fx.POS_DENSE}, lagged AS (SELECT *, lag(tick_id) OVER w AS pt, lag(time_ms) OVER w AS ptime, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM pos WINDOW w AS (PARTITION BY bus_id ORDER BY tick_id, event_id)), prev AS (SELECT *, tick_id - pt = 1 AS ok FROM lagged), moved AS (SELECT * EXCLUDE (ok), coalesce(ok, false) AS has_previous, CASE WHEN ok THEN (time_ms - ptime) / 1000::DOUBLE END AS dt_s, CASE WHEN ok THEN {hav_sql('plat', 'plon', 'lat', 'lon')} * 1000 END AS moved_m FROM prev), calc AS (SELECT *, CASE WHEN dt_s > 0 THEN moved_m / dt_s * 3.6 END AS calc_kmh FROM moved)"


@query("j2_previous_tick", f"WITH {_PREV} SELECT event_id, has_previous, dt_s, {half_up('moved_m', 3)} AS moved_m, {half_up('calc_kmh', 3)} AS calc_kmh, CASE WHEN NOT has_previous OR coalesce(moved_m, 0) > 20 OR speed > 1 THEN 'Moving' ELSE 'Stationary' END AS status FROM calc")
def j2(spark, sf_dir):
    rows = speeds.with_motion(speeds.with_previous_tick(fx.pos_dense(spark, sf_dir)))
    return rows.select("event_id", "has_previous", "dt_s", geo.round_half_up(F.col("moved_m"), 3).alias("moved_m"), geo.round_half_up(F.col("calc_kmh"), 3).alias("calc_kmh"), "status")


@query("w1_trust_weighted", f"WITH {_PREV}, tr AS (SELECT *, (CASE WHEN calc_kmh IS NULL THEN 0.7::DOUBLE ELSE greatest(0.1::DOUBLE, least(1::DOUBLE, 1 - abs(speed - calc_kmh) / (greatest(speed, calc_kmh, 1) + 10))) END) * CASE WHEN speed > 120 THEN 0.1::DOUBLE ELSE 1::DOUBLE END AS tr FROM calc), w AS (SELECT *, sum(speed * tr) OVER l / sum(tr) OVER l AS ws FROM tr WINDOW l AS (PARTITION BY bus_id, {DAY} ORDER BY tick_id, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT event_id, {half_up('ws', 1)} AS weighted_speed, {half_up('tr', 2)} AS trust_score FROM w")
def w1(spark, sf_dir):
    return speeds.trust_weighted(speeds.with_previous_tick(fx.pos_dense(spark, sf_dir))).select("event_id", "weighted_speed", "trust_score")


def _clip(low: str, high: str) -> str:
    return f"WITH {fx.POS_DENSE}, q AS (SELECT tick_id, count(*) AS n, quantile_cont(speed, 0.05) AS p5, quantile_cont(speed, 0.25) AS q1, median(speed) AS md, quantile_cont(speed, 0.75) AS q3, quantile_cont(speed, 0.95) AS p95 FROM pos GROUP BY tick_id) SELECT event_id, CASE WHEN n < 4 THEN speed ELSE {s6(f'greatest({low}, least({high}, speed))')} END AS speed_corrected FROM pos JOIN q USING (tick_id)"


for _method, _bounds in {"iqr": ("q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"), "robust": ("md - 1.5 * (q3 - q1)", "md + 1.5 * (q3 - q1)"), "percentile": ("p5", "p95")}.items():

    @query(f"a5_correct_{_method}", _clip(*_bounds))
    def a5(spark, sf_dir, method=_method):
        return speeds.correct_outliers(fx.pos_dense(spark, sf_dir), method).select("event_id", r6("speed_corrected"))


@query("a5_correct_zscore", f"WITH {fx.POS_DENSE}, a AS (SELECT tick_id, count(*) AS n, avg(speed) AS mu, stddev_pop(speed) AS sd FROM pos GROUP BY tick_id), b AS (SELECT tick_id, avg(speed) AS mu, stddev_pop(speed) AS sd FROM pos JOIN a USING (tick_id) WHERE a.sd > 0 AND abs(speed - a.mu) / a.sd <= 2.5 GROUP BY tick_id) SELECT event_id, CASE WHEN n < 4 OR b.sd IS NULL OR b.sd = 0 THEN {s6('speed')} ELSE {s6('greatest(b.mu - 3 * b.sd, least(b.mu + 3 * b.sd, speed))')} END AS speed_corrected FROM pos JOIN a USING (tick_id) LEFT JOIN b USING (tick_id)")
def a5z(spark, sf_dir):
    return speeds.correct_outliers(fx.pos_dense(spark, sf_dir), "zscore").select("event_id", r6("speed_corrected"))


_LINE = f"{MODES_SQL}, tl AS (SELECT bus_id, {DAY} AS day, CAST({MS_OF_DAY} // 780000 AS INT) AS bin, {', '.join(f'{half_up(half_up(f"avg(coalesce({c}, speed))", 9), 2)} AS {m}' for m, c in speed.MODES.items())}, count(*) AS n FROM m GROUP BY ALL)"


@query("a6_speed_timeline", f"WITH {_LINE} SELECT * FROM tl")
def a6(spark, sf_dir):
    return speeds.speed_timeline(modes(spark, sf_dir))


@query("a7_timeline_stats", f"WITH {_LINE} SELECT bus_id, {half_up('avg(trust)', 9)} AS mean, max(trust) AS highest, min(trust) AS lowest, count(*) AS bins FROM tl GROUP BY bus_id")
def a7(spark, sf_dir):
    return speeds.timeline_stats(speeds.speed_timeline(modes(spark, sf_dir)), "trust").select("bus_id", geo.round_half_up(F.col("mean"), 9).alias("mean"), "highest", "lowest", "bins")


@query("a8_fleet_summary", f"WITH {MODES_SQL}, f AS (SELECT bus_id, arg_max(route, (time_ms, event_id)) AS route, arg_max(coalesce(weighted_speed, speed), (time_ms, event_id)) AS v FROM m GROUP BY bus_id), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM f WHERE v > 0) SELECT (SELECT count(*) FROM f) AS vehicles, (SELECT count(DISTINCT route) FROM f) AS routes, (SELECT v FROM s WHERE i = n // 2) AS median_speed")
def a8(spark, sf_dir):
    fleet = modes(spark, sf_dir).groupBy("bus_id").agg(F.max_by(F.struct("route", "speed", "weighted_speed"), F.struct("time_ms", "event_id")).alias("l")).select("bus_id", "l.*")
    return speeds.fleet_summary(fleet)


@query("w2_recent_trail", f"WITH {fx.POS_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY time_ms DESC, event_id DESC) AS i FROM pos) SELECT bus_id, count(*) AS n, string_agg(event_id, ',' ORDER BY time_ms, event_id) AS events FROM r WHERE i <= 20 GROUP BY bus_id")
def w2(spark, sf_dir):
    trails = speeds.recent_trail(fx.pos_dense(spark, sf_dir))
    return trails.select("bus_id", F.size("trail").cast("long").alias("n"), F.array_join(F.transform("trail", lambda p: p["event_id"].cast("string")), ",").alias("events"))


@query("w4_last_known", f"WITH {fx.POS_DENSE} SELECT bus_id, arg_min(route, (time_ms, event_id)) AS route, max(time_ms) AS time_ms, {s6('arg_max(lat, (time_ms, event_id))')} AS lat, {s6('arg_max(lon, (time_ms, event_id))')} AS lon, arg_max(speed, (time_ms, event_id)) AS speed FROM pos GROUP BY bus_id")
def w4(spark, sf_dir):
    return speeds.last_known(fx.pos_dense(spark, sf_dir)).select("bus_id", "route", "time_ms", r6("lat"), r6("lon"), "speed")


@query("w5_even_sample", f"WITH {fx.POS_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY time_ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY bus_id) AS n FROM pos), x AS (SELECT bus_id, n, CASE WHEN k = 39 THEN n - 1 ELSE k * n // 40 END AS i FROM (SELECT DISTINCT bus_id, n FROM r) CROSS JOIN range(40) AS g(k)) SELECT event_id FROM r WHERE n <= 40 OR (bus_id, i) IN (SELECT (bus_id, i) FROM x)")
def w5(spark, sf_dir):
    return speeds.even_sample(fx.pos_dense(spark, sf_dir), 40).select("event_id")


@query("w6_spatial_sample", f"WITH {fx.POS_SPARSE}, c AS (SELECT *, floor(lat / {STEP} + 0.5) AS a, floor(lon / {STEP} + 0.5) AS b FROM pos), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY time_ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY a, b) AS n FROM c), p AS (SELECT greatest(1, ceil(500::DOUBLE / count(*))) AS cap FROM (SELECT DISTINCT a, b FROM c)), x AS (SELECT DISTINCT a, b, floor(kk * (n::DOUBLE / cap)) AS i FROM r CROSS JOIN p CROSS JOIN range(100) AS g(kk) WHERE kk < cap) SELECT event_id FROM r CROSS JOIN p WHERE n <= cap OR (a, b, i) IN (SELECT (a, b, i) FROM x)")
def w6(spark, sf_dir):
    return speeds.spatial_sample(fx.pos_sparse(spark, sf_dir), 500).select("event_id")


@query("w10_moving_average", f"WITH {fx.POS_DENSE}, v AS (SELECT *, CASE WHEN k % 4 = 0 THEN NULL ELSE speed END AS sp FROM pos), l AS (SELECT *, (time_ms - lag(time_ms) OVER w) / 1000::DOUBLE AS dt, {hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon', '6371')} * 1000 AS m FROM v WINDOW w AS (PARTITION BY bus_id ORDER BY time_ms, event_id)), x AS (SELECT *, coalesce(sp, CASE WHEN dt > 0 THEN m / dt * 3.6 END) AS y FROM l) SELECT event_id, {half_up('avg(y) OVER (PARTITION BY bus_id ORDER BY time_ms, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 3)} AS smooth_speed FROM x")
def w10(spark, sf_dir):
    rows = fx.pos_dense(spark, sf_dir).withColumn("speed", F.when(F.col("k") % 4 != 0, F.col("speed")))
    return speeds.moving_average(rows).select("event_id", geo.round_half_up(F.col("smooth_speed"), 3).alias("smooth_speed"))


@query("k9_empty_streak", f"WITH {fx.SWEEPS}, r AS (SELECT *, sum(CASE WHEN vehicles > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_idx ORDER BY sweep_id) AS run FROM sweeps) SELECT sweep_id, source_idx, CAST(sum(CASE WHEN vehicles > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY source_idx, run ORDER BY sweep_id) AS BIGINT) AS streak FROM r")
def k9(spark, sf_dir):
    return speeds.empty_streak(fx.sweeps(spark, sf_dir)).select("sweep_id", "source_idx", "streak")


@query("t2_ordered_listing", f"WITH {fx.POS_SPARSE}, l AS (SELECT DISTINCT route, bus_id FROM pos) SELECT route, bus_id, row_number() OVER (PARTITION BY route ORDER BY bus_id) AS place FROM l")
def t2(spark, sf_dir):
    from pyspark.sql import Window

    listed = fx.pos_sparse(spark, sf_dir).select("route", "bus_id").distinct()
    return listed.withColumn("place", F.row_number().over(Window.partitionBy("route").orderBy("bus_id"))).orderBy("route", "bus_id")


