"""Sliced and merged paths against SQL: the trail's twin goes on to cut shapes and to join runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes
from . import fixtures as fx
from .base import ORACLES, query

_TRAIL, _LAST = ORACLES["k4_snap_trail"].rsplit(" SELECT k.event_id, ", 1)
_PARTS = [
    f"{_TRAIL}, tr AS MATERIALIZED (SELECT k.event_id, {_LAST})",
    "sp AS (SELECT event_id, bus_id, tick_id, speed, lead(speed) OVER (PARTITION BY bus_id ORDER BY tick_id, event_id) AS speed2 FROM pos)",
    "en AS (SELECT event_id, shape_id, c1, c2 FROM eo UNION ALL SELECT event_id, shape_id, c1, c2 FROM ec)",
    "vn AS MATERIALIZED (SELECT shape_id, row_number() OVER (PARTITION BY shape_id ORDER BY seq) AS i, cum, lon, lat, count(*) OVER (PARTITION BY shape_id) AS n, max(cum) OVER (PARTITION BY shape_id) AS total FROM cv)",
    # both arc lengths within the shape, and the vertices that end the segments where they lie
    "rg AS MATERIALIZED (SELECT event_id, shape_id, c1 > c2 AS back, greatest(0, least(total, least(c1, c2))) AS lo, greatest(0, least(total, greatest(c1, c2))) AS hi, n FROM tr JOIN en USING (event_id, shape_id) JOIN (SELECT DISTINCT shape_id, n, total FROM vn) USING (shape_id) WHERE source IN ('on_route', 'cross_route'))",
    "ed AS (SELECT event_id, any_value(shape_id) AS shape_id, greatest(2, least(any_value(n), count(*) FILTER (cum < lo) + 1)) AS e1, greatest(2, least(any_value(n), count(*) FILTER (cum < hi) + 1)) AS e2 FROM rg JOIN vn USING (shape_id, n) GROUP BY event_id)",
    "tips AS (SELECT event_id, lo AS d, e1 AS e, 0 AS place FROM rg JOIN ed USING (event_id, shape_id) UNION ALL SELECT event_id, hi, e2, 1000000 FROM rg JOIN ed USING (event_id, shape_id))",
    "dots AS (SELECT p.event_id, p.place, a.lon + t * (b.lon - a.lon) AS lon, a.lat + t * (b.lat - a.lat) AS lat FROM (SELECT tips.*, shape_id, CASE WHEN b.cum > a.cum THEN (d - a.cum) / (b.cum - a.cum) ELSE 0 END AS t FROM tips JOIN rg USING (event_id) JOIN vn a USING (shape_id) JOIN vn b USING (shape_id) WHERE a.i = e - 1 AND b.i = e) p JOIN vn a USING (shape_id) JOIN vn b USING (shape_id) WHERE a.i = p.e - 1 AND b.i = p.e UNION ALL SELECT event_id, i, lon, lat FROM rg JOIN vn USING (shape_id, n) WHERE i > 1 AND cum >= lo AND cum < hi)",
    "named AS (SELECT event_id, place, CAST(floor(lon * 100000::DOUBLE + 0.5::DOUBLE) AS BIGINT) || ' ' || CAST(floor(lat * 100000::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS p FROM (SELECT event_id, CASE WHEN back THEN -place ELSE place END AS place, lon, lat FROM dots JOIN rg USING (event_id) UNION ALL SELECT event_id, 0, lon, lat FROM pr JOIN tr USING (event_id) WHERE source = 'fallback' UNION ALL SELECT event_id, 1, lon2, lat2 FROM pr JOIN tr USING (event_id) WHERE source = 'fallback'))",
    "pa AS (SELECT event_id, list(p ORDER BY place) AS path FROM named GROUP BY event_id)",
    "al AS (SELECT tr.event_id, bus_id, tick_id, path, coalesce(len(path) >= 2, false) AS ok, (coalesce(speed, speed2) + coalesce(speed2, speed)) / 2 AS mean FROM tr JOIN sp USING (event_id) LEFT JOIN pa USING (event_id))",
    "cl AS (SELECT *, CASE WHEN mean IS NULL THEN 'none' WHEN mean < 20 THEN 'slow' WHEN mean < 40 THEN 'medium' ELSE 'fast' END AS class FROM al)",
    "jn AS (SELECT *, ok AND coalesce(lag(ok) OVER w AND lag(class) OVER w = class AND lag(path[-1]) OVER w = path[1], false) AS joins FROM cl WINDOW w AS (PARTITION BY bus_id ORDER BY tick_id, event_id))",
    "rn AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY bus_id ORDER BY tick_id, event_id ROWS UNBOUNDED PRECEDING) AS run FROM jn)",
    "mw AS (SELECT bus_id, run, class, count(*) AS parts, flatten(list(CASE WHEN joins THEN path[2:] ELSE path END ORDER BY tick_id, event_id)) AS path FROM rn WHERE ok GROUP BY ALL)",
    "mg AS (SELECT * REPLACE (list_filter(path, lambda x, i: i = 1 OR x <> path[i - 1]) AS path) FROM mw)",
]


@query("w8_w9_path_runs", f"{', '.join(_PARTS)} SELECT bus_id, CAST(run AS BIGINT) AS run, class, parts, len(path) AS points, array_to_string(path, ',') AS path FROM mg")
def w8_w9(spark, sf_dir):
    """Merged paths with their points as text, in units of the fifth decimal; a point is told once, since a vertex at a cut is there or not by the last bit of a length."""
    pos, network = fx.pos_dense(spark, sf_dir), fx.shapes(spark)
    merged = shapes.merge_segments(shapes.trail_paths(shapes.snap_trail(pos, network), pos, network))
    whole = lambda x: F.floor(x * 100000 + 0.5).cast("string")
    merged = merged.withColumn("p", F.transform("path", lambda p: F.concat_ws(" ", whole(p["lon"]), whole(p["lat"]))))
    merged = merged.withColumn("p", F.filter("p", lambda x, i: (i == 0) | (x != F.coalesce(F.try_element_at("p", F.greatest(i, F.lit(1))), F.lit("")))))
    return merged.select("bus_id", F.col("run").cast("long").alias("run"), "class", "parts", F.size("p").cast("long").alias("points"), F.array_join("p", ",").alias("path"))
