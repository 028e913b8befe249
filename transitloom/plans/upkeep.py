"""Queries of the daily maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.timeparts import day_number
from ..operators import maintenance
from ..runtime import shared_dir
from ..sources.manifest import Manifest
from . import fixtures as fx
from .base import DAY, MS_OF_DAY, hav_sql, half_up, query, r6, s6
from .matching import _CUM, _LOOK, _MODEL, _pick, _proj, XY

# riders of routes and learners side by side; the newest day is still being written
_COLUMNS = "route, time_ms, lat, lon"
_BOTH = f"{fx.POS_SPARSE.replace(', pos AS (', ', ps AS (')}, {fx.POS_LEARN.removeprefix(fx.EVENTS_SQL + ', ').replace(', pos AS (', ', pl AS (')}, un AS (SELECT event_id * 2 AS event_id, bus_id, {_COLUMNS} FROM ps UNION ALL SELECT event_id * 2 + 1, 'L' || bus_id, {_COLUMNS} FROM pl), pos AS MATERIALIZED (SELECT * FROM un WHERE {DAY} < (SELECT max({DAY}) FROM un))"
_LEARNT = f"o AS (SELECT bus_id, {DAY} AS day, CAST({MS_OF_DAY} // 1800000 AS INT) AS slot, lat, lon FROM pos WHERE route = 'Unknown'), sl AS (SELECT bus_id, slot, sqrt(pow(coalesce(stddev_samp(lat), 0), 2) + pow(coalesce(stddev_samp(lon), 0), 2)) * 111000 AS sp, median(lat) AS mlat, median(lon) AS mlon FROM o GROUP BY ALL), tight AS (SELECT bus_id, median(sp) AS spread_m FROM sl GROUP BY ALL), tot AS (SELECT bus_id, count(DISTINCT day) AS days, count(*) AS points FROM o GROUP BY ALL), j AS MATERIALIZED (SELECT *, days >= 3 AND points >= 100 AND spread_m <= 200 AS promoted FROM tot JOIN tight USING (bus_id))"
_NETWORK = f"{fx.SHAPES.replace('shapes AS (', 'gtfs AS (', 1)}, shapes AS MATERIALIZED (SELECT shape_id, route, seq, lat, lon FROM gtfs UNION ALL SELECT 'LRN_' || bus_id, 'LRN_' || bus_id, row_number() OVER (PARTITION BY bus_id ORDER BY slot), mlat, mlon FROM sl JOIN j USING (bus_id) WHERE promoted)"
_ADJUSTED = f"t AS (SELECT *, ({MS_OF_DAY} // 1000) / 1800::DOUBLE AS f, CAST(floor(({MS_OF_DAY} // 1000) / 1800::DOUBLE - 0.5) AS INT) AS lo FROM pos), tu AS (SELECT t.event_id, f - (lo + 0.5::DOUBLE) AS w, {_pick('lat')}, {_pick('lon')} FROM t {_LOOK}), tv AS (SELECT event_id, coalesce(llat * (1 - w) + hlat * w, llat, hlat) AS tlat, coalesce(llon * (1 - w) + hlon * w, llon, hlon) AS tlon FROM tu), tx AS (SELECT pos.*, tlat, tlon, {DAY} AS day, tlat IS NOT NULL AND {hav_sql('lat', 'lon', 'tlat', 'tlon')} > 2 AS far FROM pos JOIN tv USING (event_id)), ad AS MATERIALIZED (SELECT event_id, bus_id, day, time_ms, CASE WHEN route = 'Unknown' THEN 'LRN_' || bus_id ELSE route END AS route, CASE WHEN far THEN tlat ELSE lat END AS lat, CASE WHEN far THEN tlon ELSE lon END AS lon FROM tx)"
_STUCK = f"pt AS MATERIALIZED (SELECT *, {XY} FROM ad), {_proj('m', 'pt', 200)}, best AS MATERIALIZED (SELECT event_id, arg_min(shape_id, (perp, shape_id)) AS shape_id, min(perp) AS perp FROM m GROUP BY event_id), r AS MATERIALIZED (SELECT p.event_id, p.bus_id, p.day, row_number() OVER (PARTITION BY p.bus_id, p.day ORDER BY p.time_ms, p.event_id) AS i, b.shape_id, b.perp FROM ad p LEFT JOIN best b USING (event_id)), k AS (SELECT bus_id, day, i, event_id, shape_id AS pick, shape_id AS last FROM r WHERE i = 1 UNION ALL SELECT r.bus_id, r.day, r.i, r.event_id, CASE WHEN m.perp <= r.perp + 30 THEN k.last ELSE r.shape_id END, coalesce(CASE WHEN m.perp <= r.perp + 30 THEN k.last ELSE r.shape_id END, k.last) FROM k JOIN r ON r.bus_id = k.bus_id AND r.day = k.day AND r.i = k.i + 1 LEFT JOIN m ON m.event_id = r.event_id AND m.shape_id = k.last)"
_ALL = f"WITH RECURSIVE {_BOTH}, {_MODEL}, {_LEARNT}, {_NETWORK}, {_CUM}, {_ADJUSTED}, {_STUCK}"


def _maintained(spark, sf_dir):
    """The folder and the report of a first run."""
    both = fx.pos_both(spark, sf_dir)
    # each event is a rider's position at least, so the newest day needs their times alone
    today = fx.pos_sparse(spark, sf_dir).agg(F.max(day_number(F.col("time_ms")))).first()[0] or 0
    folder = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    return folder, maintenance.run_maintenance(both, fx.shapes(spark), folder, today, ("time_ms", "event_id"))


@query("e3_augmented_days", f"{_ALL} SELECT k.event_id, CAST(k.day AS BIGINT) AS day, {s6('ad.lat')} AS adj_lat, {s6('ad.lon')} AS adj_lon, k.pick AS snap_shape_id, {half_up('m.cum', 2)} AS snap_cumdist FROM k JOIN ad ON ad.event_id = k.event_id LEFT JOIN m ON m.event_id = k.event_id AND m.shape_id = k.pick")
def e3(spark, sf_dir):
    folder, _ = _maintained(spark, sf_dir)
    days = Manifest(spark, f"{folder}/days").read("event_id long, adj_lat double, adj_lon double, snap_shape_id string, snap_cumdist double")
    return days.select("event_id", "day", r6("adj_lat"), r6("adj_lon"), "snap_shape_id", geo.round_half_up(F.col("snap_cumdist"), 2).alias("snap_cumdist"))


_OF = "(SELECT count(*) FROM {}) AS {}".format
_REPORT = [
    _OF("pos", "scanned_rows"), f"(SELECT count(DISTINCT {DAY}) FROM pos) AS scanned_days", _OF("o", "observations_written"),
    *[_OF(f"model WHERE tier = {n}", c) for n, c in enumerate(("bus_route_cells", "route_cells", "bus_cells"), 1)],
    _OF("j WHERE promoted", "promoted"), _OF("j WHERE NOT promoted", "skipped"), _OF("j", "candidates"),
    f"(SELECT count(DISTINCT {DAY}) FROM pos) AS days_augmented", _OF("pos", "rows_converted"), _OF("k WHERE pick IS NOT NULL", "rows_with_snap"), "CAST(0 AS BIGINT) AS days_held_back",
]


@query("e3_maintenance_report", f"{_ALL} SELECT {', '.join(_REPORT)}")
def e3r(spark, sf_dir):
    return _maintained(spark, sf_dir)[1]
