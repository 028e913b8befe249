"""Queries of the Kalman, cross-day, map-matching, clustering, feed and road operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, labels, timeparts
from ..operators import clusters, crossday, feeds, heatmap, kalman, roads, routes, shapes, speeds
from ..runtime import written
from . import fixtures as fx
from .base import DAY, HOUR, MS_OF_DAY, X_SCALE, Y_SCALE, hav_sql, half_up, query, r6, s6
from .scalars import MODES_SQL, UNPIVOT, _PREV, modes

XY = f"(lon - 101.6869::DOUBLE) * ({X_SCALE}) AS px, (lat - 3.139::DOUBLE) * ({Y_SCALE}) AS py"

# ---- K1 -------------------------------------------------------------------------------------
# the 7-number filter, a row at a time over each bus
_KALMAN = f"""
WITH RECURSIVE {_PREV},
z AS MATERIALIZED (SELECT event_id, bus_id, tick_id, speed::DOUBLE AS ms, coalesce(dt_s, 1::DOUBLE) AS dt0, {XY},
       row_number() OVER (PARTITION BY bus_id ORDER BY tick_id, event_id) AS i FROM calc),
d AS MATERIALIZED (SELECT *, CASE WHEN dt0 <= 0 THEN 1::DOUBLE WHEN dt0 > 120 THEN 120::DOUBLE ELSE dt0 END AS dt FROM z),
k AS (
  SELECT bus_id, i, event_id, ms AS outv, true AS live, px AS x, py AS y, 0::DOUBLE AS vx, 0::DOUBLE AS vy, 10::DOUBLE AS p11, 0::DOUBLE AS p12, 10::DOUBLE AS p22, 0 AS st FROM d WHERE i = 1
  UNION ALL
  SELECT bus_id, i, event_id,
    CASE WHEN NOT live OR dt > 90 THEN ms WHEN jump THEN sqrt(svx * svx + svy * svy) * 3.6 WHEN wild THEN ms ELSE spd END,
    CASE WHEN NOT live OR dt > 90 OR jump THEN true ELSE NOT wild END,
    CASE WHEN NOT live THEN px WHEN dt > 90 THEN x WHEN jump THEN qx ELSE ux END,
    CASE WHEN NOT live THEN py WHEN dt > 90 THEN y WHEN jump THEN qy ELSE uy END,
    CASE WHEN NOT live OR dt > 90 THEN 0 WHEN jump THEN svx ELSE wx END,
    CASE WHEN NOT live OR dt > 90 THEN 0 WHEN jump THEN svy ELSE wy END,
    CASE WHEN NOT live OR dt > 90 THEN 10 WHEN jump THEN a11 ELSE (1 - k1) * a11 END,
    CASE WHEN NOT live OR dt > 90 THEN 0 WHEN jump THEN a12 ELSE (1 - k1) * a12 END,
    CASE WHEN NOT live OR dt > 90 THEN 10 WHEN jump THEN a22 ELSE a22 - k2 * a12 END,
    CASE WHEN NOT live THEN 0 WHEN dt > 90 THEN st ELSE st2 END
  FROM (SELECT *, sqrt(wx * wx + wy * wy) * 3.6 AS spd, sqrt(wx * wx + wy * wy) * 3.6 > 200 OR 2 * ((1 - k1) * a11 + (a22 - k2 * a12)) > 1000 AS wild
  FROM (SELECT *, tx * least(1, (150 / 3.6::DOUBLE) / greatest(sqrt(tx * tx + ty * ty), 1e-12)) AS wx, ty * least(1, (150 / 3.6::DOUBLE) / greatest(sqrt(tx * tx + ty * ty), 1e-12)) AS wy
  FROM (SELECT *, qx + k1 * dx AS ux, qy + k1 * dy AS uy, svx + k2 * dx AS tx, svy + k2 * dy AS ty
  FROM (SELECT *, g * a11 / (a11 + 25) AS k1, g * a12 / (a11 + 25) AS k2
  FROM (SELECT *, sqrt(dx * dx + dy * dy) > 500 AS jump, CASE WHEN sqrt((dx * dx + dy * dy) / (a11 + 25)) > 3 THEN 0.3::DOUBLE ELSE 1::DOUBLE END AS g
  FROM (SELECT *, px - qx AS dx, py - qy AS dy
  FROM (SELECT *, x + svx * dt AS qx, y + svy * dt AS qy, p11 + 2 * dt * p12 + dt * dt * p22 + q * dt * dt * dt * dt / 4 AS a11, p12 + dt * p22 + q * dt * dt * dt / 2 AS a12, p22 + q * dt * dt AS a22
  FROM (SELECT *, CASE WHEN abs(ms - sqrt(svx * svx + svy * svy) * 3.6) > 20 THEN 2::DOUBLE ELSE 0.5::DOUBLE END AS q
  FROM (SELECT *, CASE WHEN st < 2 THEN rx * least(1, (150 / 3.6::DOUBLE) / greatest(sqrt(rx * rx + ry * ry), 1e-12)) ELSE vx END AS svx,
                  CASE WHEN st < 2 THEN ry * least(1, (150 / 3.6::DOUBLE) / greatest(sqrt(rx * rx + ry * ry), 1e-12)) ELSE vy END AS svy, least(st + 1, 2) AS st2
  FROM (SELECT d.bus_id, d.i, d.event_id, d.ms, d.dt, d.px, d.py, k.live, k.x, k.y, k.vx, k.vy, k.p11, k.p12, k.p22, k.st, (d.px - k.x) / d.dt AS rx, (d.py - k.y) / d.dt AS ry
        FROM k JOIN d ON d.bus_id = k.bus_id AND d.i = k.i + 1))))))))))
)
SELECT event_id, {half_up('outv', 4)} AS speed_kalman FROM k
"""


@query("k1_kalman_speed", _KALMAN)
def k1(spark, sf_dir):
    rows = speeds.with_previous_tick(fx.pos_dense(spark, sf_dir))
    return kalman.kalman_speed(rows).select("event_id", geo.round_half_up(F.col("speed_kalman"), 4).alias("speed_kalman"))


# ---- cross-day ------------------------------------------------------------------------------
_MODEL = f"days AS (SELECT DISTINCT {DAY} AS d FROM pos ORDER BY d DESC LIMIT 60), mp AS (SELECT *, CAST({MS_OF_DAY} // 1800000 AS INT) AS slot FROM pos WHERE {DAY} IN (SELECT d FROM days)), model AS (SELECT 1 AS tier, bus_id, route, slot, median(lat) AS lat, median(lon) AS lon, count(*) AS n FROM mp WHERE route <> 'Unknown' GROUP BY ALL UNION ALL SELECT 2, NULL, route, slot, median(lat), median(lon), count(*) FROM mp WHERE route <> 'Unknown' GROUP BY route, slot UNION ALL SELECT 3, bus_id, NULL, slot, median(lat), median(lon), count(*) FROM mp GROUP BY bus_id, slot)"


@query("a4_cross_day_model", f"WITH {fx.POS_SPARSE}, {_MODEL} SELECT tier, bus_id, route, slot, {s6('lat')} AS lat, {s6('lon')} AS lon, n FROM model")
def a4(spark, sf_dir):
    return crossday.cross_day_model(fx.pos_sparse(spark, sf_dir)).select("tier", "bus_id", "route", "slot", r6("lat"), r6("lon"), "n")


_LOOK = " ".join(f"LEFT JOIN model {e}1 ON {e}1.tier = 1 AND {e}1.bus_id = t.bus_id AND {e}1.route = t.route AND {e}1.slot = t.lo + {s} LEFT JOIN model {e}2 ON {e}2.tier = 2 AND {e}2.route = t.route AND {e}2.slot = t.lo + {s} LEFT JOIN model {e}3 ON {e}3.tier = 3 AND {e}3.bus_id = t.bus_id AND {e}3.slot = t.lo + {s}" for e, s in (("l", 0), ("h", 1)))


_ADJ = "CASE s WHEN 'model' THEN t{0} WHEN 'raw' THEN {0} END"


def _pick(c: str) -> str:
    return ", ".join(f"CASE WHEN t.route <> 'Unknown' THEN coalesce({e}1.{c}, {e}2.{c}) ELSE {e}3.{c} END AS {e}{c}" for e in "lh")


@query("j3_adjust_positions", f"WITH {fx.POS_SPARSE}, {_MODEL}, t AS (SELECT *, ({MS_OF_DAY} // 1000) / 1800::DOUBLE AS f, CAST(floor(({MS_OF_DAY} // 1000) / 1800::DOUBLE - 0.5) AS INT) AS lo FROM pos), u AS (SELECT t.event_id, t.lat, t.lon, f - (lo + 0.5::DOUBLE) AS w, {_pick('lat')}, {_pick('lon')} FROM t {_LOOK}), v AS (SELECT *, coalesce(llat * (1 - w) + hlat * w, llat, hlat) AS tlat, coalesce(llon * (1 - w) + hlon * w, llon, hlon) AS tlon FROM u), x AS (SELECT *, CASE WHEN tlat IS NULL THEN 'none' WHEN {hav_sql('lat', 'lon', 'tlat', 'tlon')} > 2 THEN 'model' ELSE 'raw' END AS s FROM v) SELECT event_id, s AS adj_source, {s6(_ADJ.format('lat'))} AS adj_lat, {s6(_ADJ.format('lon'))} AS adj_lon FROM x")
def j3(spark, sf_dir):
    pos = fx.pos_sparse(spark, sf_dir)
    return crossday.adjust_positions(pos, crossday.cross_day_model(pos)).select("event_id", "adj_source", r6("adj_lat"), r6("adj_lon"))


# buses B1 and B4 already have a shape, and every bus's days up to 19730 divisible by 4 are recorded
_SEEN = f"obs AS (SELECT bus_id, {DAY} AS day, time_ms, lat, lon FROM pos WHERE NOT ({DAY} % 4 = 0 AND {DAY} <= 19730) AND bus_id NOT IN ('B1', 'B4'))"


def _observations(spark, sf_dir):
    pos = fx.pos_learn(spark, sf_dir)
    seen = pos.select("bus_id", timeparts.day_number(F.col("time_ms")).alias("day")).filter("day % 4 = 0 and day <= 19730").distinct()
    learned = pos.select("bus_id").filter("bus_id in ('B1', 'B4')").distinct()
    return crossday.new_unknown_observations(pos, seen, learned)


@query("j7_new_observations", f"WITH {fx.POS_LEARN}, {_SEEN} SELECT bus_id, day, time_ms, {s6('lat')} AS lat, {s6('lon')} AS lon FROM obs")
def j7(spark, sf_dir):
    return _observations(spark, sf_dir).select("bus_id", "day", "time_ms", r6("lat"), r6("lon"))


_PROMOTE = f"{fx.POS_LEARN}, o AS (SELECT *, {DAY} AS day FROM pos), sl AS (SELECT bus_id, slot, sqrt(pow(coalesce(stddev_samp(lat), 0), 2) + pow(coalesce(stddev_samp(lon), 0), 2)) * 111000 AS sp, median(lat) AS mlat, median(lon) AS mlon FROM o GROUP BY ALL), tight AS (SELECT bus_id, median(sp) AS spread_m FROM sl GROUP BY ALL), tot AS (SELECT bus_id, count(DISTINCT day) AS days, count(*) AS points FROM o GROUP BY ALL), j AS (SELECT *, days >= 3 AND points >= 100 AND spread_m <= 200 AND bus_id <> 'B3' AS promoted FROM tot JOIN tight USING (bus_id))"


def _judged(spark, sf_dir):
    obs = fx.pos_learn(spark, sf_dir).withColumn("day", timeparts.day_number(F.col("time_ms")))
    existing = obs.select(F.concat(F.lit("LRN_"), F.col("bus_id")).alias("shape_id")).filter("shape_id = 'LRN_B3'").distinct()
    return obs, existing, crossday.promotion(obs, existing)


@query("a14_promotion", f"WITH {_PROMOTE} SELECT bus_id, days, points, {half_up('spread_m', 4)} AS spread_m, promoted FROM j")
def a14(spark, sf_dir):
    return _judged(spark, sf_dir)[2].select("bus_id", "days", "points", geo.round_half_up(F.col("spread_m"), 4).alias("spread_m"), "promoted")


@query("a14_s13_learned_shapes", f"WITH {_PROMOTE} SELECT 'LRN_' || bus_id AS shape_id, CAST(row_number() OVER (PARTITION BY bus_id ORDER BY slot) AS INT) AS seq, {s6('mlat')} AS lat, {s6('mlon')} AS lon FROM sl JOIN j USING (bus_id) WHERE promoted")
def a14s(spark, sf_dir):
    obs, existing, judged = _judged(spark, sf_dir)
    new = crossday.learned_shapes(obs, judged)
    return crossday.publish_learned(existing, new).select("shape_id", "seq", r6("lat"), r6("lon"))


@query("a21_promotion_report", f"WITH {_PROMOTE} SELECT count(*) FILTER (promoted) AS promoted, count(*) FILTER (NOT promoted) AS skipped, count(*) AS candidates FROM j")
def a21(spark, sf_dir):
    return crossday.promotion_report(_judged(spark, sf_dir)[2])


@query("u4_without_graduated", f"WITH {_PROMOTE} SELECT event_id, bus_id FROM pos JOIN j USING (bus_id) WHERE NOT promoted")
def u4(spark, sf_dir):
    obs, _, judged = _judged(spark, sf_dir)
    return crossday.without_graduated(obs, judged).select("event_id", "bus_id")


# ---- shapes ---------------------------------------------------------------------------------
_CUM = f"v AS (SELECT *, {XY.replace('px', 'x').replace('py', 'y')} FROM shapes), st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM v WINDOW w AS (PARTITION BY shape_id ORDER BY seq)), cv AS (SELECT *, sum(step) OVER (PARTITION BY shape_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM st), sg AS MATERIALIZED (SELECT route, shape_id, row_number() OVER w - 1 AS seg, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y, cum FROM cv WINDOW w AS (PARTITION BY shape_id ORDER BY seq))"


def _proj(name: str, points: str, reach: int, own: bool = True) -> str:
    where = "p.route = s.route AND " if own else ""
    return f"{name}0 AS (SELECT p.event_id, s.shape_id, s.seg, s.cum, (bx - ax) AS dx, (b_y - ay) AS dy, px, py, ax, ay FROM {points} p JOIN sg s ON {where}bx IS NOT NULL AND px >= least(ax, bx) - {reach} AND px <= greatest(ax, bx) + {reach} AND py >= least(ay, b_y) - {reach} AND py <= greatest(ay, b_y) + {reach}), {name}1 AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM {name}0), {name}2 AS (SELECT event_id, shape_id, seg, cum + t * sqrt(dx * dx + dy * dy) AS arc, pow(px - ax - t * dx, 2) + pow(py - ay - t * dy, 2) AS d2 FROM {name}1), {name} AS MATERIALIZED (SELECT event_id, shape_id, sqrt(min(d2)) AS perp, arg_min(arc, (d2, seg)) AS cum FROM {name}2 WHERE d2 <= {reach} * {reach} GROUP BY ALL)"


_POINTS = f"pt AS MATERIALIZED (SELECT *, {XY} FROM pos)"


@query("w7_shape_cumdist", f"WITH {fx.POS_DENSE}, shapes AS (SELECT bus_id AS shape_id, route, rn AS seq, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY tick_id, event_id) AS rn FROM pos)), {_CUM} SELECT shape_id, seq, {half_up('cum', 3)} AS cum FROM cv")
def w7(spark, sf_dir):
    from pyspark.sql import Window

    tracks = fx.pos_dense(spark, sf_dir).select(F.col("bus_id").alias("shape_id"), "route", F.row_number().over(Window.partitionBy("bus_id").orderBy("tick_id", "event_id")).cast("long").alias("seq"), "lat", "lon")
    return shapes.shape_cumdist(tracks).select("shape_id", "seq", geo.round_half_up(F.col("cum"), 3).alias("cum"))


@query("j4_snap_points", f"WITH {fx.POS_DENSE}, {fx.SHAPES}, {_CUM}, {_POINTS}, {_proj('m', 'pt', 200)} SELECT event_id, arg_min(shape_id, (perp, shape_id)) AS shape_id, {half_up('min(perp)', 3)} AS perp, {half_up('arg_min(cum, (perp, shape_id))', 2)} AS cum FROM m GROUP BY event_id")
def j4(spark, sf_dir):
    found = shapes.snap_points(fx.pos_dense(spark, sf_dir), fx.shapes(spark))
    return found.select("event_id", "shape_id", geo.round_half_up(F.col("perp"), 3).alias("perp"), geo.round_half_up(F.col("cum"), 2).alias("cum"))


@query("k3_sticky_shape", f"WITH RECURSIVE {fx.POS_DENSE}, {fx.SHAPES}, {_CUM}, {_POINTS}, {_proj('m', 'pt', 200)}, best AS MATERIALIZED (SELECT event_id, arg_min(shape_id, (perp, shape_id)) AS shape_id, min(perp) AS perp FROM m GROUP BY event_id), r AS MATERIALIZED (SELECT p.event_id, p.bus_id, row_number() OVER (PARTITION BY p.bus_id ORDER BY p.tick_id, p.event_id) AS i, b.shape_id, b.perp FROM pos p LEFT JOIN best b USING (event_id)), k AS (SELECT bus_id, i, event_id, shape_id AS pick, shape_id AS last FROM r WHERE i = 1 UNION ALL SELECT r.bus_id, r.i, r.event_id, CASE WHEN m.perp <= r.perp + 30 THEN k.last ELSE r.shape_id END, coalesce(CASE WHEN m.perp <= r.perp + 30 THEN k.last ELSE r.shape_id END, k.last) FROM k JOIN r ON r.bus_id = k.bus_id AND r.i = k.i + 1 LEFT JOIN m ON m.event_id = r.event_id AND m.shape_id = k.last) SELECT k.event_id, k.pick AS snap_shape_id, {half_up('m.cum', 2)} AS snap_cumdist FROM k LEFT JOIN m ON m.event_id = k.event_id AND m.shape_id = k.pick")
def k3(spark, sf_dir):
    found = shapes.sticky_shape(fx.pos_dense(spark, sf_dir), fx.shapes(spark))
    return found.select("event_id", "snap_shape_id", geo.round_half_up(F.col("snap_cumdist"), 2).alias("snap_cumdist"))


_PAIRS = "pr AS MATERIALIZED (SELECT * FROM (SELECT event_id, bus_id, route, tick_id, lat, lon, lead(event_id) OVER w AS next_id, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM pos WINDOW w AS (PARTITION BY bus_id ORDER BY tick_id, event_id)) WHERE next_id IS NOT NULL)"
_ENDS = "(SELECT p.event_id, a.shape_id, floor((a.perp + b.perp) / 2 * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS mean, a.cum AS c1, b.cum AS c2 FROM pr p JOIN {m} a ON a.event_id = p.event_id JOIN {m} b ON b.event_id = p.next_id AND b.shape_id = a.shape_id)"


@query("j5_snap_pairs", f"WITH {fx.POS_DENSE}, {fx.SHAPES}, {_CUM}, {_POINTS}, {_proj('m', 'pt', 400)}, {_PAIRS}, e AS {_ENDS.format(m='m')} SELECT event_id, shape_id, {half_up('mean', 3)} AS mean, {half_up('c1', 2)} AS from_cum, {half_up('c2', 2)} AS to_cum FROM e")
def j5(spark, sf_dir):
    found = shapes.snap_pairs(fx.pos_dense(spark, sf_dir), fx.shapes(spark))
    return found.select("event_id", "shape_id", *[geo.round_half_up(F.col(c), n).alias(c) for c, n in (("mean", 3), ("from_cum", 2), ("to_cum", 2))])


_CROSS = f"{_proj('mo', 'pt', 400)}, {_proj('ma', 'pt', 200, own=False)}, {_PAIRS}, eo AS MATERIALIZED {_ENDS.format(m='mo')}, box AS (SELECT shape_id, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM shapes GROUP BY shape_id), ec AS MATERIALIZED (SELECT e.* FROM {_ENDS.format(m='ma')} e JOIN pr USING (event_id) JOIN box USING (shape_id) WHERE event_id NOT IN (SELECT event_id FROM eo) AND least(lat, lat2) >= a - 200 / 111000::DOUBLE AND greatest(lat, lat2) <= b + 200 / 111000::DOUBLE AND least(lon, lon2) >= c - 200 / 111000::DOUBLE AND greatest(lon, lon2) <= d + 200 / 111000::DOUBLE)"


@query("j6_snap_pairs_any_route", f"WITH {fx.POS_DENSE}, {fx.SHAPES}, {_CUM}, {_POINTS}, {_CROSS} SELECT event_id, shape_id, {half_up('mean', 3)} AS mean FROM ec")
def j6(spark, sf_dir):
    return shapes.snap_pairs_any_route(fx.pos_dense(spark, sf_dir), fx.shapes(spark)).select("event_id", "shape_id", geo.round_half_up(F.col("mean"), 3).alias("mean"))


@query("k4_snap_trail", f"WITH RECURSIVE {fx.POS_DENSE}, {fx.SHAPES}, {_CUM}, {_POINTS}, {_CROSS}, bo AS (SELECT event_id, arg_min(shape_id, (mean, shape_id)) AS sid, min(mean) AS mean FROM eo GROUP BY event_id), bc AS (SELECT event_id, arg_min(shape_id, (mean, shape_id)) AS sid FROM ec GROUP BY event_id), r AS MATERIALIZED (SELECT p.event_id, p.bus_id, row_number() OVER (PARTITION BY p.bus_id ORDER BY p.tick_id, p.event_id) AS i, bo.sid AS o, bo.mean, bc.sid AS c, {hav_sql('p.lat', 'p.lon', 'p.lat2', 'p.lon2')} * 1000 AS chord FROM pr p LEFT JOIN bo USING (event_id) LEFT JOIN bc USING (event_id)), k AS (SELECT bus_id, i, event_id, coalesce(o, c) AS pick, coalesce(o, c) AS last FROM r WHERE i = 1 UNION ALL SELECT r.bus_id, r.i, r.event_id, coalesce(CASE WHEN e.mean <= r.mean + 30 THEN k.last ELSE r.o END, r.c), coalesce(CASE WHEN e.mean <= r.mean + 30 THEN k.last ELSE r.o END, r.c, k.last) FROM k JOIN r ON r.bus_id = k.bus_id AND r.i = k.i + 1 LEFT JOIN eo e ON e.event_id = r.event_id AND e.shape_id = k.last) SELECT k.event_id, CASE WHEN r.o IS NOT NULL THEN 'on_route' WHEN r.c IS NOT NULL THEN 'cross_route' WHEN chord <= 3000 THEN 'fallback' ELSE 'gap' END AS source, k.pick AS shape_id FROM k JOIN r USING (event_id)")
def k4(spark, sf_dir):
    return shapes.snap_trail(fx.pos_dense(spark, sf_dir), fx.shapes(spark)).select("event_id", "source", "shape_id")


# three buses in four carry shapes from an earlier pass, some rows without a place, and one shape that nobody knows
_CARRY = ["CASE WHEN u % 4 = 0 THEN NULL WHEN u % 4 = 3 AND k % 9 = 0 THEN 'LOST' ELSE 'S' || (u % 10 + 10 * (rn0 div 7 % 2)) END AS snap_shape_id", "CASE WHEN k % 13 = 0 THEN NULL ELSE k * 10.0D END AS snap_cumdist"]
_CARRIED = f"{fx.POS_DENSE.replace('pos AS (', 'pos0 AS (')}, pos AS (SELECT *, {', '.join(_CARRY).replace('10.0D', '10::DOUBLE').replace('rn0 div 7', 'tick_id // 7')} FROM pos0)"


@query("k4_snap_trail_carried", f"WITH RECURSIVE {_CARRIED}, {fx.SHAPES}, {_CUM}, {_POINTS}, {_CROSS}, bo AS (SELECT event_id, arg_min(shape_id, (mean, shape_id)) AS sid, min(mean) AS mean FROM eo GROUP BY event_id), gv AS (SELECT event_id, snap_shape_id AS g FROM (SELECT event_id, snap_shape_id, snap_cumdist, lead(snap_shape_id) OVER w AS s2, lead(snap_cumdist) OVER w AS d2 FROM pos WINDOW w AS (PARTITION BY bus_id ORDER BY tick_id, event_id)) WHERE snap_shape_id = s2 AND snap_cumdist IS NOT NULL AND d2 IS NOT NULL AND snap_shape_id IN (SELECT shape_id FROM shapes)), bc AS (SELECT event_id, arg_min(shape_id, (mean, shape_id)) AS sid FROM ec GROUP BY event_id), r AS MATERIALIZED (SELECT p.event_id, p.bus_id, row_number() OVER (PARTITION BY p.bus_id ORDER BY p.tick_id, p.event_id) AS i, bo.sid AS o, bo.mean, bc.sid AS c, gv.g, {hav_sql('p.lat', 'p.lon', 'p.lat2', 'p.lon2')} * 1000 AS chord FROM pr p LEFT JOIN bo USING (event_id) LEFT JOIN bc USING (event_id) LEFT JOIN gv USING (event_id)), k AS (SELECT bus_id, i, event_id, coalesce(g, o, c) AS pick, coalesce(g, o, c) AS last FROM r WHERE i = 1 UNION ALL SELECT r.bus_id, r.i, r.event_id, coalesce(r.g, CASE WHEN e.mean <= r.mean + 30 THEN k.last ELSE r.o END, r.c), coalesce(r.g, CASE WHEN e.mean <= r.mean + 30 THEN k.last ELSE r.o END, r.c, k.last) FROM k JOIN r ON r.bus_id = k.bus_id AND r.i = k.i + 1 LEFT JOIN eo e ON e.event_id = r.event_id AND e.shape_id = k.last) SELECT k.event_id, CASE WHEN r.g IS NOT NULL OR r.o IS NOT NULL THEN 'on_route' WHEN r.c IS NOT NULL THEN 'cross_route' WHEN chord <= 3000 THEN 'fallback' ELSE 'gap' END AS source, k.pick AS shape_id FROM k JOIN r USING (event_id)")
def k4c(spark, sf_dir):
    pos = fx.pos_dense(spark, sf_dir)
    carried = pos.selectExpr("*", *[x.replace("rn0", "tick_id") for x in _CARRY])
    return shapes.snap_trail(carried, fx.shapes(spark)).select("event_id", "source", "shape_id")


@query("w8_w9_merged_paths")
def w8(spark, sf_dir):
    pos, shp = fx.pos_dense(spark, sf_dir), fx.shapes(spark)
    paths = shapes.trail_paths(shapes.snap_trail(pos, shp), pos, shp)
    return shapes.merge_segments(paths)


# ---- routes ---------------------------------------------------------------------------------
_HEAD = "hs AS (SELECT route_id, trip_headsign AS headsign FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY n DESC, trip_headsign) AS i FROM (SELECT route_id, trip_headsign, count(*) AS n FROM trips WHERE direction_id = '0' GROUP BY ALL)) WHERE i = 1)"

@query("a18_headsign_mode", f"WITH {fx.TRIPS}, {_HEAD} SELECT * FROM hs")
def a18(spark, sf_dir):
    return routes.headsign_mode(fx.trips(spark, sf_dir))


def _labelled(spark, sf_dir):
    trips = fx.trips(spark, sf_dir)
    return trips, routes.labelled_routes(fx.routes(spark), routes.headsign_mode(trips))


_TITLE = "array_to_string(list_transform(regexp_extract_all(lower({0}), '[a-z0-9_]+|[^a-z0-9_]+'), lambda w: upper(w[1]) || substr(w, 2)), '')"
for _word in labels.ACRONYMS:
    _TITLE = rf"regexp_replace({_TITLE}, '\b{_word}\b', '{_word.upper()}', 'g')"
_TITLE = f"replace({_TITLE}, ' - ', ' ~ ')"
_BARE = r"'^[A-Z]{0,3}\d+[A-Za-z]*$'"
_NAMED = f"nm AS (SELECT route_id, trim(coalesce(route_short_name, '')) AS s, trim(coalesce(route_long_name, '')) AS l, headsign FROM routes LEFT JOIN hs USING (route_id)), cd AS (SELECT *, CASE WHEN s <> '' THEN s ELSE l END AS c FROM nm)"


@query("p19_p20_route_labels", f"WITH {fx.TRIPS}, {fx.ROUTES}, {_HEAD}, {_NAMED} SELECT route_id, headsign, CASE WHEN s <> '' AND l <> '' THEN s || ' – ' || l WHEN regexp_matches(c, {_BARE}) AND coalesce(headsign, '') <> '' THEN c || ' – ' || {_TITLE.format('headsign')} WHEN c <> '' THEN c ELSE route_id END AS label FROM cd")
def p19(spark, sf_dir):
    return _labelled(spark, sf_dir)[1].select("route_id", "label", "headsign")


_PLAIN = "lb AS (SELECT route_id, route_short_name, route_long_name, CASE WHEN route_short_name <> '' AND route_long_name <> '' THEN route_short_name || ' – ' || route_long_name WHEN route_short_name <> '' THEN route_short_name ELSE route_long_name END AS label FROM routes)"


def _plain(spark):
    return routes.labelled_routes(fx.routes(spark), fx.routes(spark).select("route_id", F.lit(None).cast("string").alias("headsign")))


@query("j1_resolve_route", f"WITH {fx.TRIPS}, {fx.ROUTES}, {_PLAIN}, {fx.POS_SPARSE}, tl AS (SELECT trip_id, coalesce(label, 'Unknown') AS label FROM trips LEFT JOIN lb USING (route_id)), ix AS (SELECT key, arg_max(label, (route_id, place)) AS label FROM (SELECT route_id AS key, route_id, 0 AS place, label FROM lb UNION ALL SELECT route_short_name, route_id, 1, label FROM lb UNION ALL SELECT route_long_name, route_id, 2, label FROM lb) WHERE key <> '' GROUP BY key), fd AS (SELECT event_id, bus_id, 'T' || (event_id * 3) AS trip_id, CASE k % 4 WHEN 0 THEN 'R' || (k % 12) WHEN 1 THEN 'T' || (100 + k % 12) WHEN 2 THEN '' END AS rt FROM pos), ln AS (SELECT DISTINCT bus_id, 'LRN – ' || bus_id AS label FROM pos WHERE u % 7 = 0) SELECT event_id, coalesce(tl.label, ix.label, CASE WHEN rt <> '' THEN rt END, ln.label, 'Unknown') AS route FROM fd LEFT JOIN (SELECT * FROM tl WHERE label <> 'Unknown') tl USING (trip_id) LEFT JOIN ix ON ix.key = rt LEFT JOIN ln USING (bus_id)")
def j1(spark, sf_dir):
    pos, labelled = fx.pos_sparse(spark, sf_dir), _plain(spark)
    feed = pos.selectExpr("event_id", "bus_id", "'T' || (event_id * 3) AS trip_id", "CASE k % 4 WHEN 0 THEN 'R' || (k % 12) WHEN 1 THEN 'T' || (100 + k % 12) WHEN 2 THEN '' END AS rt_route_id")
    learned = pos.filter("u % 7 = 0").select("bus_id").distinct().withColumn("label", F.concat(F.lit("LRN – "), F.col("bus_id")))
    return routes.resolve_route(feed, routes.trip_labels(fx.trips(spark, sf_dir), labelled), routes.route_index(labelled), learned).select("event_id", "route")


@query("j11_shape_routes", f"WITH {fx.TRIPS}, {fx.ROUTES}, {_PLAIN} SELECT DISTINCT coalesce(label, 'Unknown') AS label, shape_id FROM trips LEFT JOIN lb USING (route_id)")
def j11(spark, sf_dir):
    return routes.shape_routes(fx.trips(spark, sf_dir), _plain(spark))


@query("j11_route_of_shape", f"WITH {fx.TRIPS}, {fx.ROUTES}, {_PLAIN}, x AS (SELECT coalesce(label, 'Unknown') AS label, shape_id, CAST(substr(trip_id, 2) AS BIGINT) AS o FROM trips LEFT JOIN lb USING (route_id)), f AS (SELECT label, min(o) AS o FROM x GROUP BY label) SELECT shape_id, arg_min(label, f.o) AS label FROM (SELECT DISTINCT label, shape_id FROM x) JOIN f USING (label) GROUP BY shape_id")
def j11b(spark, sf_dir):
    trips = fx.trips(spark, sf_dir).withColumn("trip_order", F.expr("CAST(substring(trip_id, 2) AS BIGINT)"))
    return routes.route_of_shape(trips, _plain(spark))


@query("j12_inferred_shape", f"WITH {fx.POS_SPARSE} SELECT event_id, CASE WHEN route = 'Unknown' AND u % 2 = 0 THEN 'LRN_' || bus_id END AS inferred_shape FROM pos")
def j12(spark, sf_dir):
    pos = fx.pos_sparse(spark, sf_dir)
    learned = pos.filter("u % 2 = 0").select(F.concat(F.lit("LRN_"), F.col("bus_id")).alias("shape_id"))
    return routes.inferred_shape(pos, learned).select("event_id", "inferred_shape")


@query("u1_u2_networks", f"WITH {fx.TRIPS}, a AS (SELECT route_id, count(*) AS n FROM trips WHERE direction_id = '0' GROUP BY ALL), b AS (SELECT route_id, count(*) AS n FROM trips WHERE direction_id = '1' AND route_id < 'R5' GROUP BY ALL) SELECT * FROM b UNION ALL SELECT * FROM a WHERE route_id NOT IN (SELECT route_id FROM b)")
def u2(spark, sf_dir):
    trips = fx.trips(spark, sf_dir)
    count = lambda rows: rows.groupBy("route_id").agg(F.count("*").alias("n"))
    return routes.merged_networks(count(trips.filter("direction_id = '0'")), count(trips.filter("direction_id = '1' and route_id < 'R5'")), "route_id")


@query("u1_with_learned", f"WITH {_PROMOTE}, {fx.TRIPS} SELECT shape_id, count(*) AS n FROM (SELECT shape_id FROM trips UNION ALL SELECT 'LRN_' || bus_id FROM sl JOIN j USING (bus_id) WHERE promoted) GROUP BY shape_id")
def u1(spark, sf_dir):
    obs, _, judged = _judged(spark, sf_dir)
    both = routes.with_learned(fx.trips(spark, sf_dir).select("shape_id"), crossday.learned_shapes(obs, judged).select("shape_id"))
    return both.groupBy("shape_id").agg(F.count("*").alias("n"))


# ---- clusters -------------------------------------------------------------------------------
_CELLS = f"{MODES_SQL}, {UNPIVOT}, s AS (SELECT *, {DAY} AS day, CAST({HOUR} AS INT) AS h FROM u WHERE v BETWEEN 0 AND 200), bm AS (SELECT day, mode, route, h, bus_id, median(v) AS x FROM (SELECT *, row_number() OVER (PARTITION BY day, mode, route, h, bus_id ORDER BY time_ms DESC, event_id DESC) AS i FROM s) WHERE i <= 60 GROUP BY ALL), cl AS (SELECT day, mode, route, h, {half_up('median(x)', 2)} AS x FROM bm GROUP BY day, mode, route, h), sp AS (SELECT day, route, mode, h FROM (SELECT DISTINCT day, route FROM cl), (SELECT DISTINCT mode FROM u), (SELECT CAST(h AS INT) AS h FROM range(24) AS g(h))), ft AS MATERIALIZED (SELECT sp.day, sp.route, sp.mode, sp.h, coalesce(x, avg(x) OVER (PARTITION BY sp.day, sp.mode, sp.h), 0) AS v FROM sp LEFT JOIN cl USING (day, mode, route, h))"


def _cells(spark, sf_dir):
    t = F.col("time_ms")
    samples = heatmap.unpivot_modes(modes(spark, sf_dir), timeparts.day_number(t).alias("day"), "route", timeparts.local_hour(t).alias("hour"), "bus_id", "time_ms", "event_id").filter("v between 0 and 200")
    medians = heatmap._two_stage(samples, ["day", "mode", "route", "hour"])
    # its readers join it with itself; a few rows a day
    return written(medians.select("day", "mode", "route", "hour", geo.round_half_up(F.col("raw_value"), 2).alias("value")), "cells")


@query("c1_route_features", f"WITH {_CELLS} SELECT day, route AS item, mode || '|' || lpad(CAST(h AS VARCHAR), 8, '0') AS feature, {half_up('v', 9)} AS v FROM ft")
def c1(spark, sf_dir):
    return clusters.features(_cells(spark, sf_dir)).select("day", "item", "feature", geo.round_half_up(F.col("v"), 9).alias("v"))


@query("c2_pairwise_euclidean", f"WITH {_CELLS} SELECT a.day, a.route AS a, b.route AS b, {half_up('sqrt(sum(pow(a.v - b.v, 2)))', 5)} AS d FROM ft a JOIN ft b ON a.day = b.day AND a.mode = b.mode AND a.h = b.h AND a.route < b.route GROUP BY a.day, a.route, b.route")
def c2(spark, sf_dir):
    rows = clusters.features(_cells(spark, sf_dir))
    return clusters.pairwise_distance(rows).select("day", "a", "b", geo.round_half_up(F.col("d"), 5).alias("d"))


@query("c2_pairwise_correlation", f"WITH {_CELLS} SELECT a.day, a.route AS a, b.route AS b, {half_up('1 - coalesce(corr(a.v, b.v), 0)', 6)} AS d FROM ft a JOIN ft b ON a.day = b.day AND a.mode = b.mode AND a.h = b.h AND a.route < b.route GROUP BY a.day, a.route, b.route")
def c2c(spark, sf_dir):
    rows = clusters.features(_cells(spark, sf_dir))
    return clusters.pairwise_distance(rows, "correlation").select("day", "a", "b", r6("d"))


@query("c3_c4_route_clusters")
def c3(spark, sf_dir):
    return clusters.route_clusters(_cells(spark, sf_dir))


@query("c5_hour_order")
def c5(spark, sf_dir):
    return clusters.hour_order(_cells(spark, sf_dir))


@query("a22_cluster_sizes")
def a22(spark, sf_dir):
    return clusters.cluster_sizes(clusters.route_clusters(_cells(spark, sf_dir), "correlation"))


@query("t3_active_axis")
def t3(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return clusters.active_axis(cells, clusters.route_clusters(cells))


@query("u3_all_routes", f"WITH {_CELLS} SELECT DISTINCT route FROM cl")
def u3(spark, sf_dir):
    return routes.all_routes(_cells(spark, sf_dir))


# ---- feeds ----------------------------------------------------------------------------------
def _sources(spark):
    from ..sources.network import sources

    return sources(spark)


@query("k7_feed_counts", f"WITH {fx.SWEEPS} SELECT sweep_id, count(*) FILTER (vehicles > 0) AS live, count(*) FILTER (vehicles = 0) AS empty, count(*) FILTER (vehicles = -1) AS unreachable, CAST(sum(greatest(vehicles, 0)) AS BIGINT) AS vehicles FROM sweeps GROUP BY sweep_id")
def k7(spark, sf_dir):
    return feeds.feed_counts(fx.sweeps(spark, sf_dir))


@query("k7_feed_outage", f"WITH {fx.SWEEPS}, o AS (SELECT sweep_id, count(*) FILTER (vehicles > 0) AS live, count(*) AS n FROM sweeps WHERE source_idx > 1 GROUP BY sweep_id) SELECT s.sweep_id, source_idx, vehicles = 0 AND coalesce(live, 0) > coalesce(n, 0) / 2::DOUBLE AS outage FROM sweeps s LEFT JOIN o USING (sweep_id) WHERE source_idx <= 1")
def k7b(spark, sf_dir):
    return feeds.feed_outage(fx.sweeps(spark, sf_dir), _sources(spark))


@query("k8_choose_source", f"WITH RECURSIVE {fx.SWEEPS}, w AS MATERIALIZED (SELECT sweep_id % 8 AS region, sweep_id, row_number() OVER (PARTITION BY sweep_id % 8 ORDER BY sweep_id) AS i, coalesce(max(vehicles) FILTER (source_idx = 0), -1) AS c0, coalesce(max(vehicles) FILTER (source_idx = 1), -1) AS c1 FROM sweeps GROUP BY sweep_id), k AS (SELECT region, i, sweep_id, CASE WHEN c0 > 0 THEN 0 WHEN c1 >= 10 THEN 1 ELSE 0 END AS active FROM w WHERE i = 1 UNION ALL SELECT w.region, w.i, w.sweep_id, CASE WHEN active = 0 THEN CASE WHEN c0 > 0 THEN 0 WHEN c1 >= 10 THEN 1 ELSE 0 END ELSE CASE WHEN c1 > 0 THEN CASE WHEN c0 >= 10 THEN 0 ELSE 1 END WHEN c0 >= 10 THEN 0 ELSE 1 END END FROM k JOIN w ON w.region = k.region AND w.i = k.i + 1) SELECT region, sweep_id, CAST(active AS INT) AS active FROM k")
def k8(spark, sf_dir):
    return feeds.choose_source(fx.sweeps(spark, sf_dir).withColumn("region", F.col("sweep_id") % 8))


@query("u5_collectable", f"WITH {fx.SWEEPS} SELECT sweep_id, source_idx FROM sweeps WHERE source_idx <= 1")
def u5(spark, sf_dir):
    listed = _sources(spark)
    rows = fx.sweeps(spark, sf_dir).join(F.broadcast(listed.select("source_idx", F.col("id").alias("feed_source"))), "source_idx")
    return routes.collectable(rows, listed).select("sweep_id", "source_idx")


# ---- roads ----------------------------------------------------------------------------------
_SPEED = "CASE highway WHEN 'motorway' THEN 110 WHEN 'primary' THEN 60 WHEN 'tertiary' THEN 40 ELSE 30 END"
_EDGES = f"st AS (SELECT way_id, highway, oneway, unnest(nodes) AS node_id, generate_subscripts(nodes, 1) AS place FROM road_ways), kn AS (SELECT s.*, lat, lon FROM st s JOIN road_nodes USING (node_id)), hp AS (SELECT *, lead(node_id) OVER w AS b, {hav_sql('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w', '6371000')} AS m FROM kn WINDOW w AS (PARTITION BY way_id ORDER BY place)), ed AS (SELECT node_id AS from_node, b AS to_node, CAST(floor(m + 0.5) AS BIGINT) AS dist_m, {_SPEED} AS kmh FROM hp WHERE m >= 0.5 AND (oneway IS NULL OR oneway <> '-1') UNION ALL SELECT b, node_id, CAST(floor(m + 0.5) AS BIGINT), {_SPEED} FROM hp WHERE m >= 0.5 AND (oneway IS NULL OR oneway <> 'yes'))"


@query("s12_road_edges", f"WITH {fx.ROAD_NODES}, {fx.ROAD_WAYS}, {_EDGES} SELECT from_node, to_node, dist_m, CAST(kmh AS INT) AS kmh FROM ed")
def s12(spark, sf_dir):
    return roads.road_edges(fx.road_ways(spark, sf_dir), fx.road_nodes(spark, sf_dir))


@query("j9_nearest_node", f"WITH {fx.POS_SPARSE}, {fx.ROAD_NODES}, c AS (SELECT event_id, node_id, node_id % 3 = 0 AS main, {hav_sql('p.lat', 'p.lon', 'n.lat', 'n.lon', '6371000')} AS d FROM pos p JOIN road_nodes n ON abs(floor(p.lat / 0.002::DOUBLE) - floor(n.lat / 0.002::DOUBLE)) <= 4 AND abs(floor(p.lon / 0.002::DOUBLE) - floor(n.lon / 0.002::DOUBLE)) <= 4 ) SELECT event_id AS point_id, arg_min(node_id, (NOT main, d, node_id)) AS node_id, {half_up('arg_min(d, (NOT main, d, node_id))', 3)} AS dist_m FROM c GROUP BY event_id")
def j9(spark, sf_dir):
    points = fx.pos_sparse(spark, sf_dir).select(F.col("event_id").alias("point_id"), "lat", "lon")
    nodes = fx.road_nodes(spark, sf_dir)
    found = roads.nearest_node(points, nodes, nodes.filter("node_id % 3 = 0"))
    return found.select("point_id", "node_id", geo.round_half_up(F.col("dist_m"), 3).alias("dist_m"))


_MAIN = f"{fx.ROAD_NODES}, {fx.ROAD_WAYS}, {_EDGES}, e AS MATERIALIZED (SELECT DISTINCT from_node, to_node FROM ed), seed AS (SELECT node_id FROM road_nodes WHERE node_id IN (SELECT from_node FROM e) ORDER BY {hav_sql('lat', 'lon', str(roads.SEED[0]) + '::DOUBLE', str(roads.SEED[1]) + '::DOUBLE', '6371000')}, node_id LIMIT 1), k AS (SELECT node_id FROM seed UNION SELECT to_node FROM k JOIN e ON from_node = node_id)"


def _main(spark, sf_dir):
    nodes = fx.road_nodes(spark, sf_dir)
    return nodes, roads.main_component(roads.road_edges(fx.road_ways(spark, sf_dir), nodes), nodes)


@query("g1_main_component", f"WITH RECURSIVE {_MAIN} SELECT node_id FROM k")
def g1_main(spark, sf_dir):
    return _main(spark, sf_dir)[1]


@query("j9_router_node", f"WITH RECURSIVE {_MAIN}, {fx.POS_SPARSE}, c AS (SELECT event_id, node_id, node_id IN (SELECT node_id FROM k) AS main, {hav_sql('p.lat', 'p.lon', 'n.lat', 'n.lon', '6371000')} AS d FROM pos p JOIN road_nodes n ON abs(floor(p.lat / 0.002::DOUBLE) - floor(n.lat / 0.002::DOUBLE)) <= 4 AND abs(floor(p.lon / 0.002::DOUBLE) - floor(n.lon / 0.002::DOUBLE)) <= 4) SELECT event_id AS point_id, arg_min(node_id, (NOT main, d, node_id)) AS node_id, {half_up('arg_min(d, (NOT main, d, node_id))', 3)} AS dist_m FROM c GROUP BY event_id")
def j9_router(spark, sf_dir):
    """The nearest node as the router looks for it: of the main component that its seed gives, else of any."""
    nodes, main = _main(spark, sf_dir)
    points = fx.pos_sparse(spark, sf_dir).select(F.col("event_id").alias("point_id"), "lat", "lon")
    return roads.nearest_node(points, nodes, main).select("point_id", "node_id", geo.round_half_up(F.col("dist_m"), 3).alias("dist_m"))


@query("j10_a16_a17_congestion", f"WITH {fx.ROAD_NODES}, {fx.ROAD_WAYS}, {_EDGES}, {fx.POS_DENSE}, me AS (SELECT ed.*, floor((a.lat + b.lat) / 2 / 0.001::DOUBLE) AS r, floor((a.lon + b.lon) / 2 / 0.001::DOUBLE) AS c FROM ed JOIN road_nodes a ON a.node_id = from_node JOIN road_nodes b ON b.node_id = to_node), pc AS (SELECT floor(lat / 0.001::DOUBLE) AS r, floor(lon / 0.001::DOUBLE) AS c, speed FROM pos WHERE speed >= 0), nb AS (SELECT m.r, m.c, list_sort(list(speed)) AS s FROM (SELECT DISTINCT r, c FROM me) m JOIN pc ON abs(pc.r - m.r) <= 1 AND abs(pc.c - m.c) <= 1 GROUP BY m.r, m.c), x AS (SELECT from_node, to_node, dist_m, kmh, coalesce(greatest(5, least(kmh, s[len(s) // 2 + 1])), kmh) AS g FROM me LEFT JOIN nb ON nb.r = me.r AND nb.c = me.c) SELECT from_node, to_node, dist_m, CAST(kmh AS INT) AS kmh, CAST(g AS DOUBLE) AS congestion_kmh, {half_up('dist_m / (g / 3.6::DOUBLE)', 3)} AS travel_s FROM x")
def j10(spark, sf_dir):
    nodes = fx.road_nodes(spark, sf_dir)
    edges = roads.road_edges(fx.road_ways(spark, sf_dir), nodes)
    found = roads.edge_congestion(edges, nodes, fx.pos_dense(spark, sf_dir))
    return found.withColumn("travel_s", geo.round_half_up(F.col("travel_s"), 3))


@query("g1_reachable", f"WITH RECURSIVE {fx.ROAD_NODES}, {fx.ROAD_WAYS}, {_EDGES}, e AS MATERIALIZED (SELECT DISTINCT from_node, to_node FROM ed), k AS (SELECT min(from_node) AS node_id FROM e UNION SELECT to_node FROM k JOIN e ON from_node = node_id) SELECT node_id FROM k")
def g1(spark, sf_dir):
    edges = roads.road_edges(fx.road_ways(spark, sf_dir), fx.road_nodes(spark, sf_dir))
    return roads.reachable(edges, edges.agg(F.min("from_node").alias("node_id")))
