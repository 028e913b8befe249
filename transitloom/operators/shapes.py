"""Map matching of points and pairs to shapes, and path geometry.

Segments are exploded to the grid cells that they come near to and gathered by cell, so that
a point meets all its candidates in one row of an equi-join on its cell, and what is nearest
is told in that row: no candidate is shuffled or sorted. Cells are dilated by the threshold:
no segment in range is missed. The ends of a pair meet by a look at the bus's next row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.geo import haversine, local_x, local_y, round_half_up
from ..functions.speed import segment_class
from ..runtime import BROADCAST_BYTES, written
from .scans import key_starts

#: Fixed values, in metres.
POINT_M, OWN_ROUTE_M, STICKY_M, CHORD_M, BOX_PAD_DEG = 200.0, 400.0, 30.0, 3000.0, 200 / 111000
CELL_M = 400.0


def shape_cumdist(shapes: DataFrame) -> DataFrame:
    """Vertices with x, y and cum, the running arc length of their shape."""
    order = Window.partitionBy("shape_id").orderBy("seq")
    rows = shapes.withColumn("x", local_x(F.col("lon"))).withColumn("y", local_y(F.col("lat")))
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    rows = rows.withColumn("_step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return rows.withColumn("cum", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def segments(shapes: DataFrame) -> DataFrame:
    """(route, shape_id, seg, ax, ay, bx, by, cum) of consecutive vertices."""
    order = Window.partitionBy("shape_id").orderBy("seq")
    rows = shape_cumdist(shapes).withColumn("seg", F.row_number().over(order) - 1)
    return rows.select("route", "shape_id", "seg", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(order).alias("bx"), F.lead("y").over(order).alias("by"), "cum").filter("bx is not null")


def _cell(metres: Column) -> Column:
    return F.floor(metres / CELL_M)


def gridded(segs: DataFrame, reach: float) -> DataFrame:
    """A row of each segment for each cell within reach of it, column by column.

    In a column of cells only the part of the segment counts that comes within reach of the
    column, so a long slanted one has cells along its line and not those of its whole box.
    """
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    held = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    share = lambda x: F.when(dx != 0, held((x - F.col("ax")) / F.when(dx != 0, dx)))
    y = lambda t, other: F.col("ay") + F.coalesce(t, F.lit(other)) * dy
    columns = F.sequence(_cell(F.least("ax", "bx") - reach), _cell(F.greatest("ax", "bx") + reach))
    rows = segs.withColumn("cell_x", F.explode(columns))
    one, two = y(share(F.col("cell_x") * CELL_M - reach), 0.0), y(share((F.col("cell_x") + 1) * CELL_M + reach), 1.0)
    return rows.withColumn("cell_y", F.explode(F.sequence(_cell(F.least(one, two) - reach), _cell(F.greatest(one, two) + reach))))


_BOX = [f"{end}_{c}" for end in ("lo", "hi") for c in ("lat", "lon")]
_NEAR = "array<struct<perp:double,shape_id:string,cum:double>>"
#: Bytes of a segment in a cell's row, and of a vertex in its shape's.
SEGMENT_BYTES, VERTEX_BYTES = 96, 48


def shape_cells(shapes: DataFrame, reach: float, own_route: bool = True) -> DataFrame:
    """(of_route, of_cell_x, of_cell_y, of_shapes): the segments near each cell, by shape, each shape with its box; without own_route of all routes.

    Broadcast where its counted segments fit the bound.
    """
    keys = [*["route"] * own_route, "cell_x", "cell_y"]
    boxes = shapes.groupBy("shape_id").agg(F.min("lat").alias("lo_lat"), F.max("lat").alias("hi_lat"), F.min("lon").alias("lo_lon"), F.max("lon").alias("hi_lon"))
    lines = segments(shapes).withColumn("dx", F.col("bx") - F.col("ax")).withColumn("dy", F.col("by") - F.col("ay")).withColumn("size", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    near = gridded(lines, reach).groupBy(*keys, "shape_id").agg(F.collect_list(F.struct("seg", "ax", "ay", "dx", "dy", "size", "cum")).alias("segs"))
    cells = near.join(boxes, "shape_id").groupBy(*keys).agg(F.collect_list(F.struct("shape_id", "segs", *_BOX)).alias("of_shapes"), F.sum(F.size("segs")).alias("held"))
    cells = written(cells, "shape-cells")
    held = cells.agg(F.sum("held")).first()[0] or 0
    cells = cells.select(*[F.col(k).alias(f"of_{k}") for k in keys], "of_shapes")
    return F.broadcast(cells) if held * SEGMENT_BYTES <= BROADCAST_BYTES else cells


def nearest(shapes: Column, px: Column, py: Column, reach: float, keep: Callable[[Column], Column] | None = None) -> Column:
    """Of a cell's shapes those within reach: array<struct<perp, shape_id, cum>>, each at its nearest segment, the first among equals."""

    def placed(g: Column) -> Column:
        t = F.when(g["size"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - g["ax"]) * g["dx"] + (py - g["ay"]) * g["dy"]) / g["size"]))).otherwise(0.0)
        return F.struct(g.alias("g"), t.alias("t"))

    def distance(p: Column) -> Column:
        g, t = p["g"], p["t"]
        gap = lambda at, own, d: F.pow(at - (g[own] + t * g[d]), F.lit(2.0))
        return F.struct((gap(px, "ax", "dx") + gap(py, "ay", "dy")).alias("d2"), g["seg"].alias("seg"), (g["cum"] + t * F.sqrt(g["size"])).alias("at"))

    best = lambda s: F.array_min(F.transform(F.transform(s["segs"], placed), distance))
    held = F.filter(shapes, keep) if keep else shapes
    found = F.filter(F.transform(held, lambda s: F.struct(s["shape_id"].alias("shape_id"), best(s).alias("m"))), lambda s: s["m"]["d2"] <= reach * reach)
    told = F.transform(found, lambda s: F.struct(F.sqrt(s["m"]["d2"]).alias("perp"), s["shape_id"].alias("shape_id"), s["m"]["at"].alias("cum")))
    return F.coalesce(told, F.expr(f"CAST(array() AS {_NEAR})"))


def with_nearest(points: DataFrame, cells: DataFrame, reach: float, name: str = "near", own_route: bool = True, lat: str = "lat", lon: str = "lon", among: Column | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows with the shapes near their point, empty without one; ``among`` tells the rows that are looked up."""
    x, y = local_x(F.col(lon)), local_y(F.col(lat))
    at = lambda c: F.when(among, _cell(c)) if among is not None else _cell(c)
    rows = points.withColumn("_x", x).withColumn("_y", y).withColumn("_cx", at(x)).withColumn("_cy", at(y))
    match = (F.col("_cx") == F.col("of_cell_x")) & (F.col("_cy") == F.col("of_cell_y"))
    if own_route:
        match &= F.col("route") == F.col("of_route")
    met = rows.join(cells, match, "left")
    return met.select(*points.columns, nearest(F.col("of_shapes"), F.col("_x"), F.col("_y"), reach, keep).alias(name))


def snap_points(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(event_id, shape_id, perp, cum): the nearest own-route shape within 200 m, unmatched points left out."""
    found = with_nearest(points.select("event_id", "route", "lat", "lon"), shape_cells(shapes, POINT_M), POINT_M)
    # a filter on what inline makes stays above it, so the candidates are looked at once
    return found.select("event_id", F.inline(F.array(F.array_min("near")))).filter("shape_id is not null").select("event_id", "shape_id", "perp", "cum")


def with_sticky(rows: DataFrame, keys: list[str], order: list[str], near: str = "near", dealt_by: list[Column] | None = None) -> DataFrame:
    """Rows with snap_shape_id and snap_cumdist in place of their candidates: a key's previous shape is kept within 30 m of the best.

    A row without a match has none, and the previous shape outlives it. Rows are dealt to tasks
    by their keys, or by ``dealt_by``, which must hang on the keys alone.
    """
    kept = [c for c in rows.columns if c != near]
    places = [kept.index(k) for k in keys]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for batch in filter(len, batches):
            by = [batch.column(p) for p in places]
            options = batch.column(len(kept))
            sizes = options.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            perps, shape_ids, cums = options.flatten().flatten()
            perp = perps.to_numpy(zero_copy_only=False)
            at, begin, some = np.arange(len(batch)), np.cumsum(sizes) - sizes, sizes > 0
            of_row = np.repeat(at, sizes)
            close = perp <= perp[begin[of_row]] + STICKY_M
            picks = np.where(some, begin, -1)
            starts = key_starts(by)
            starts[0] = [c[0].as_py() for c in by] != own
            # the rows of its key so far begin at ``since``, and the last of them with a shape is ``before``
            since = np.maximum.accumulate(np.where(starts, at, -1))
            matched = np.maximum.accumulate(np.where(some, at, -1))
            before = np.append(-1, matched[:-1])
            # only where two or more are close does the choice hang on the row before
            for i in np.flatnonzero(np.bincount(of_row, close, len(batch)) > 1).tolist():
                j = before[i]
                held = shape_ids[picks[j]].as_py() if j >= max(since[i], 0) else None if since[i] >= 0 else last
                if held is not None:
                    same = next((k for k in range(begin[i], begin[i] + sizes[i]) if shape_ids[k].as_py() == held), None)
                    picks[i] = same if same is not None and close[same] else begin[i]
            own = [c[-1].as_py() for c in by]
            if matched[-1] >= max(since[-1], 0):
                last = shape_ids[picks[matched[-1]]].as_py()
            elif since[-1] >= 0:
                last = None
            chosen = pa.array(picks, mask=picks < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], shape_ids.take(chosen), cums.take(chosen)], [*kept, "snap_shape_id", "snap_cumdist"])

    tracks = rows.select(*kept, F.sort_array(near).alias(near))
    schema = StructType([*rows.select(*kept).schema.fields, StructField("snap_shape_id", StringType()), StructField("snap_cumdist", DoubleType())])
    return tracks.repartition(*(dealt_by or keys)).sortWithinPartitions(*keys, *order).mapInArrow(scan, schema)


def sticky_shape(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(event_id, snap_shape_id, snap_cumdist): the previous shape of a bus is kept within 30 m of the best (K3)."""
    rows = points.select("bus_id", "tick_id", "event_id", "route", "lat", "lon")
    near = with_nearest(rows, shape_cells(shapes, POINT_M), POINT_M).select("bus_id", "tick_id", "event_id", "near")
    return with_sticky(near, ["bus_id"], ["tick_id", "event_id"]).select("event_id", "snap_shape_id", "snap_cumdist")


def pairs(points: DataFrame, *more: str) -> DataFrame:
    """Consecutive points of a bus: (bus_id, route, event_id, tick_id, next_id, lat, lon, lat2, lon2, speed, speed2), and any column more with its next as c2."""
    order = Window.partitionBy("bus_id").orderBy("tick_id", "event_id")
    following = {"next_id": "event_id", "lat2": "lat", "lon2": "lon", "speed2": "speed"} | {f"{c}2": c for c in more}
    rows = points.select("bus_id", "route", "event_id", "tick_id", "lat", "lon", "speed", *more, *[F.lead(c).over(order).alias(a) for a, c in following.items()])
    return rows.filter("next_id is not null")


def _both_ends(near: Column, near2: Column) -> Column:
    """array<struct<mean, shape_id, from_cum, to_cum>> of the shapes near both ends, sorted.

    Means are compared to the micrometre, so that mirrored shapes tie and their ids decide.
    """
    other = lambda a: F.filter(near2, lambda b: b["shape_id"] == a["shape_id"])
    met = F.filter(F.transform(near, lambda a: F.struct(a.alias("a"), F.try_element_at(other(a), F.lit(1)).alias("b"))), lambda m: m["b"].isNotNull())
    mean = lambda m: round_half_up((m["a"]["perp"] + m["b"]["perp"]) / 2, 6)
    return F.array_sort(F.transform(met, lambda m: F.struct(mean(m).alias("mean"), m["a"]["shape_id"].alias("shape_id"), m["a"]["cum"].alias("from_cum"), m["b"]["cum"].alias("to_cum"))))


def pairs_on_route(points: DataFrame, shapes: DataFrame, *more: str) -> DataFrame:
    """pairs with ``own``: the own-route shapes within 400 m of both ends, by mean distance."""
    kept = points.select("bus_id", "route", "event_id", "tick_id", "lat", "lon", "speed", *more)
    links = pairs(with_nearest(kept, shape_cells(shapes, OWN_ROUTE_M), OWN_ROUTE_M), "near", *more)
    return links.withColumn("own", _both_ends(F.col("near"), F.col("near2"))).drop("near", "near2")


def snap_pairs(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(event_id, mean, shape_id, from_cum, to_cum): own-route shapes within 400 m of both ends of each pair."""
    return pairs_on_route(points, shapes).select("event_id", F.inline("own"))


def with_any_route(links: DataFrame, shapes: DataFrame, among: Column) -> DataFrame:
    """Pairs with ``cross``: of those that ``among`` tells, the shapes of any route within 200 m of both ends, whose padded boxes hold both."""
    cells = shape_cells(shapes, POINT_M, own_route=False)
    inside = lambda s, c, v: (F.col(v) >= s[f"lo_{c}"] - BOX_PAD_DEG) & (F.col(v) <= s[f"hi_{c}"] + BOX_PAD_DEG)
    holds = lambda s: inside(s, "lat", "lat") & inside(s, "lat", "lat2") & inside(s, "lon", "lon") & inside(s, "lon", "lon2")
    rows = with_nearest(links, cells, POINT_M, "_a", own_route=False, among=among, keep=holds)
    rows = with_nearest(rows, cells, POINT_M, "_b", own_route=False, lat="lat2", lon="lon2", among=among & (F.size("_a") > 0))
    return rows.withColumn("cross", _both_ends(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def snap_pairs_any_route(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(event_id, mean, shape_id, from_cum, to_cum): for pairs that no shape of their own route fits, those of any route."""
    missed = F.size("own") == 0
    return with_any_route(pairs_on_route(points, shapes), shapes, missed).select("event_id", F.inline("cross"))


def snap_trail(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(event_id, source, shape_id, from_cum, to_cum) for each consecutive pair (K4).

    on_route: the shape that both points carry in snap_shape_id, where they have such columns
    and the shape is known, without any projection; else an own-route shape, the previous one
    if near the best; cross_route: the nearest shape of any route; fallback: a straight chord
    up to 3 km; else gap. A matched shape is the next pair's previous one.
    """
    carried = ("snap_shape_id", "snap_cumdist")
    kinds = {"snap_shape_id": "string", "snap_cumdist": "double"}
    for name in carried:
        if name not in points.columns:
            points = points.withColumn(name, F.lit(None).cast(kinds[name]))
    known = written(shapes.groupBy("shape_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("shape_id").alias("snap_shape_id"), F.lit(True).alias("known")), "shape-ids")
    known = F.broadcast(known) if known.count() * 48 <= BROADCAST_BYTES else known
    ends = points.select("bus_id", "route", "event_id", "tick_id", "lat", "lon", "speed", *carried)
    # a point of a pair that is matched already is looked up only where its other pair is not
    order = Window.partitionBy("bus_id").orderBy("tick_id", "event_id")
    same = lambda shift: F.coalesce((shift("snap_shape_id") == F.col("snap_shape_id")) & shift("snap_cumdist").isNotNull() & F.col("snap_cumdist").isNotNull(), F.lit(False))
    ends = ends.withColumn("_on", same(lambda c: F.lead(c).over(order))).withColumn("_off", same(lambda c: F.lag(c).over(order))).join(known, "snap_shape_id", "left")
    settled = F.coalesce(F.col("known"), F.lit(False)) & F.col("_on") & F.col("_off")
    near = with_nearest(ends, shape_cells(shapes, OWN_ROUTE_M), OWN_ROUTE_M, among=~settled)
    links = pairs(near, "near", "known", "_on", *carried).withColumn("own", _both_ends(F.col("near"), F.col("near2")))
    given = F.coalesce(F.col("known"), F.lit(False)) & F.col("_on")
    links = links.withColumn("given", F.when(given, F.struct(F.col("snap_shape_id").alias("shape_id"), F.col("snap_cumdist").alias("from_cum"), F.col("snap_cumdist2").alias("to_cum"))))
    chord = haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) * 1000
    links = links.select("bus_id", "tick_id", "event_id", "lat", "lon", "lat2", "lon2", chord.alias("chord"), "given", "own")
    rows = with_any_route(links, shapes, F.col("given").isNull() & (F.size("own") == 0))
    rows = rows.select("bus_id", "tick_id", "event_id", "chord", "given", "own", F.try_element_at("cross", F.lit(1)).alias("cross"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bus, last = None, None
        for batch in batches:
            out = []
            for owner, chord, given, own, cross in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6)), strict=True):
                if owner != bus:
                    bus, last = owner, None
                pick, source = cross, "cross_route"
                if given:
                    pick, source = given, "on_route"
                elif own:
                    kept = next((o for o in own if o["shape_id"] == last), None)
                    pick, source = (kept if kept and kept["mean"] <= own[0]["mean"] + STICKY_M else own[0]), "on_route"
                if pick:
                    last = pick["shape_id"]
                    out.append((source, last, pick["from_cum"], pick["to_cum"]))
                else:
                    out.append(("fallback" if chord is not None and chord <= CHORD_M else "gap", None, None, None))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            types = [pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(2), *[pa.array(list(c), k) for c, k in zip(columns, types, strict=True)]], ["event_id", "source", "shape_id", "from_cum", "to_cum"])

    return rows.repartition("bus_id").sortWithinPartitions("bus_id", "tick_id", "event_id").mapInArrow(scan, "event_id long, source string, shape_id string, from_cum double, to_cum double")


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), of), 1)


def slice_shape(vertices: Column, low: Column, high: Column) -> Column:
    """The part of a shape between two arc lengths, as points (lon, lat).

    vertices: array<struct<cum, lon, lat>> in order of cum. Ends are interpolated; vertices from
    the second on with low <= cum < high lie between. Lengths outside are clamped. A row looks
    over the vertices once for each end.
    """
    total = F.try_element_at(vertices, F.lit(-1))["cum"]
    a, b = F.greatest(F.lit(0.0), F.least(total, low)), F.greatest(F.lit(0.0), F.least(total, high))
    point = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    below = lambda d: F.size(F.filter(vertices, lambda v: v["cum"] < d))

    def at(d: Column, under: Column) -> Column:
        # the first segment that ends at or past d
        end = F.greatest(F.lit(2), F.least(F.size(vertices), under + 1))
        segment = _let(end, lambda k: F.struct(F.try_element_at(vertices, k - 1).alias("one"), F.try_element_at(vertices, k).alias("two")))

        def between(s: Column) -> Column:
            one, two = s["one"], s["two"]
            length = two["cum"] - one["cum"]
            share = F.when(length > 0, (d - one["cum"]) / F.when(length > 0, length)).otherwise(0.0)
            return _let(share, lambda t: point(one["lon"] + t * (two["lon"] - one["lon"]), one["lat"] + t * (two["lat"] - one["lat"])))

        return _let(segment, between)

    def cut(c: Column) -> Column:
        start = F.greatest(F.lit(2), c["under_a"] + 1)
        inner = F.transform(F.slice(vertices, start, F.greatest(F.lit(0), c["under_b"] - start + 1)), lambda v: point(v["lon"], v["lat"]))
        return F.concat(F.array(at(c["a"], c["under_a"])), inner, F.array(at(c["b"], c["under_b"])))

    counted = _let(F.struct(a.alias("a"), b.alias("b")), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), below(e["a"]).alias("under_a"), below(e["b"]).alias("under_b")))
    return F.when((low <= high) & (F.size(vertices) > 1), _let(counted, cut))


def trail_paths(trail: DataFrame, points: DataFrame, shapes: DataFrame) -> DataFrame:
    """The trail with ``path``: five-decimal points (lon, lat) along the shape or the chord, null in gaps."""
    vertices = shape_cumdist(shapes).groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("seq", "cum", "lon", "lat"))).alias("v"))
    vertices = written(vertices.select("shape_id", F.transform("v", lambda x: F.struct(x["cum"], x["lon"], x["lat"])).alias("v")), "vertices")
    held = vertices.agg(F.sum(F.size("v"))).first()[0] or 0
    vertices = F.broadcast(vertices) if held * VERTEX_BYTES <= BROADCAST_BYTES else vertices
    # a shape's vertices come last, so that no shuffle of the trail carries them
    rows = trail.join(pairs(points).drop("route"), "event_id").join(vertices, "shape_id", "left")
    low, high = F.least("from_cum", "to_cum"), F.greatest("from_cum", "to_cum")
    along = _let(slice_shape(F.col("v"), low, high), lambda p: F.when(F.col("from_cum") > F.col("to_cum"), F.reverse(p)).otherwise(p))
    chord = F.array(F.struct("lon", "lat"), F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat")))
    path = F.when(F.col("source") == "gap", None).when(F.col("source") == "fallback", chord).otherwise(along)
    rounded = F.transform(path, lambda p: F.struct(round_half_up(p["lon"], 5).alias("lon"), round_half_up(p["lat"], 5).alias("lat")))
    return rows.select("bus_id", "tick_id", "event_id", "source", "shape_id", "speed", "speed2", rounded.alias("path"))


def merge_segments(paths: DataFrame) -> DataFrame:
    """(bus_id, run, class, path, parts): consecutive paths of one class whose ends touch, as one."""
    order = Window.partitionBy("bus_id").orderBy("tick_id", "event_id")
    rows = paths.withColumn("class", segment_class(F.col("speed"), F.col("speed2"))).withColumn("ok", F.coalesce(F.size("path") >= 2, F.lit(False)))
    before = F.lag(F.struct("ok", "class", F.try_element_at("path", F.lit(-1)).alias("end"))).over(order)
    rows = rows.withColumn("_b", before)
    joins = F.col("ok") & F.coalesce(F.col("_b.ok") & (F.col("_b.class") == F.col("class")) & (F.col("_b.end") == F.try_element_at("path", F.lit(1))), F.lit(False))
    rows = rows.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(order)).filter("ok")
    part = F.struct("tick_id", "event_id", "path")
    runs = rows.groupBy("bus_id", "run", "class").agg(F.array_sort(F.collect_list(part)).alias("p"), F.count("*").alias("parts"))
    whole = F.flatten(F.transform("p", lambda x, k: F.when(k == 0, x["path"]).otherwise(F.slice(x["path"], 2, F.size(x["path"])))))
    return runs.select("bus_id", "run", "class", whole.alias("path"), "parts")
