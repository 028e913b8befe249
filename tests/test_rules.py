"""Each rule on a few literal rows."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitloom.functions import geo, labels, speed
from transitloom.sources.folders import Files
from transitloom.sources.manifest import Manifest
from transitloom.operators import clusters, feeds, heatmap, kalman, maintenance, routes, shapes, speeds
from transitloom.plans import fixtures as fx
from transitloom.plans.registry import QUERIES
from transitloom.sources import history, network, weather
from transitloom.streaming import keyed

SF = "/root/testdata/sf0.001"


def one(df):
    return df.collect()[0]


# ---- Kalman -----------------------------------------------------------------------------------
def four_by_four(track):
    """The textbook filter with 4 x 4 matrices."""
    state, out = None, []
    for x, y, measured, dt in track:
        if state is None:
            state = [np.array([x, y, 0.0, 0.0]), np.eye(4) * 10, 0]
            out.append(measured)
            continue
        s, p, n = state
        dt = 1.0 if dt <= 0 else min(dt, 120.0)
        if dt > 90:
            state = [np.array([s[0], s[1], 0, 0]), np.eye(4) * 10, n]
            out.append(measured)
            continue
        if n < 2:
            v = np.array([x - s[0], y - s[1]]) / dt
            size = np.hypot(*v)
            s = np.r_[s[:2], v * min(1, 150 / 3.6 / size) if size else v]
            n += 1
        q = 2 if abs(measured - np.hypot(s[2], s[3]) * 3.6) > 20 else 0.5
        f = np.eye(4)
        f[0, 2] = f[1, 3] = dt
        g = np.array([[dt**2 / 2, 0], [0, dt**2 / 2], [dt, 0], [0, dt]])
        s, p = f @ s, f @ p @ f.T + q * g @ g.T
        h = np.eye(2, 4)
        inn = np.array([x, y]) - s[:2]
        if np.hypot(*inn) > 500:
            state = [s, p, n]
            out.append(np.hypot(s[2], s[3]) * 3.6)
            continue
        cov = h @ p @ h.T + 25 * np.eye(2)
        gain = p @ h.T @ np.linalg.inv(cov)
        if math.sqrt(inn @ np.linalg.inv(cov) @ inn) > 3:
            gain *= 0.3
        s, p = s + gain @ inn, (np.eye(4) - gain @ h) @ p
        size = np.hypot(s[2], s[3])
        if size > 150 / 3.6:
            s[2:] *= 150 / 3.6 / size
        v = np.hypot(s[2], s[3]) * 3.6
        if v > 200 or np.trace(p) > 1000:
            state = None
            out.append(measured)
            continue
        state = [s, p, n]
        out.append(v)
    return out


@pytest.mark.parametrize("seed,step", [(1, 3.0), (2, 5.0), (3, 20.0), (4, 100.0)])
def test_kalman_equals_matrix_form(seed, step):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(30, 40, (200, 2)), axis=0)
    x[rng.integers(0, 200, 5)] += 700
    track = [(a, b, abs(rng.normal(30, 20)), 0.0 if k % 37 == 0 else step) for k, (a, b) in enumerate(x)]
    state, out = None, []
    for row in track:
        state, v = kalman.kalman_step(state, *row)
        out.append(v)
    assert np.allclose(out, four_by_four(track), rtol=1e-8, atol=1e-8)


def test_kalman_branches():
    start, first = kalman.kalman_step(None, 0, 0, 12.0, 1)
    assert first == 12.0 and start[:4] == (0, 0, 0, 0)
    gap, told = kalman.kalman_step(start, 50, 0, 33.0, 91)
    assert told == 33.0 and gap[0] == 0 and gap[4:7] == (10, 0, 10)
    settled = (0, 0, 5.0, 0, 10, 0, 10, 2)
    gated, told = kalman.kalman_step(settled, 600, 0, 18.0, 1)
    assert told == pytest.approx(18.0) and gated[0] == pytest.approx(5.0)
    reset, told = kalman.kalman_step(settled, 300, 0, 20.0, 10)
    assert reset is None and told == 20.0


def test_streamed_kalman_equals_batch(spark):
    sort = lambda df: sorted(map(tuple, df.collect()))
    assert sort(QUERIES["k2_kalman_stream"](spark, SF)) == sort(QUERIES["k1_kalman_speed"](spark, SF))


# ---- ticks ------------------------------------------------------------------------------------
def ticks(spark, rows):
    return spark.createDataFrame(rows, "bus_id string, tick_id long, event_id long, time_ms long, lat double, lon double, speed double")


def test_previous_tick(spark):
    rows = [("a", 1, 1, 1000, 3.0, 101.0, 0.0), ("a", 2, 2, 31000, 3.001, 101.0, 0.0), ("a", 2, 3, 32000, 3.002, 101.0, 0.0), ("a", 3, 4, 32000, 3.003, 101.0, 0.0), ("a", 5, 5, 90000, 3.0, 101.0, 0.5)]
    got = {r.event_id: r for r in speeds.with_motion(speeds.with_previous_tick(ticks(spark, rows))).collect()}
    assert not got[1].has_previous and got[1].status == "Moving"
    assert got[2].dt_s == 30 and got[2].calc_kmh == pytest.approx(0.111195 / 30 * 3600, rel=1e-3)
    assert got[3].dt_s == 31  # the same tick's other row is not its previous
    assert got[4].dt_s == 0 and got[4].calc_kmh is None
    assert not got[5].has_previous


def test_trust_resets_by_day(spark):
    midnight = 1704038400000  # 00:00 at UTC+8
    rows = [("a", 1, 1, midnight - 60000, 3.0, 101.0, 10.0), ("a", 2, 2, midnight - 30000, 3.0, 101.0, 20.0), ("a", 3, 3, midnight, 3.0, 101.0, 90.0)]
    got = {r.event_id: r for r in speeds.trust_weighted(speeds.with_previous_tick(ticks(spark, rows))).collect()}
    assert got[1].trust_score == 0.7 and got[1].weighted_speed == 10.0
    assert got[3].weighted_speed == 90.0


def test_outliers_leave_small_and_even_ticks(spark):
    rows = [("b%d" % k, 1, k, 0, 0.0, 0.0, v) for k, v in enumerate([1.0, 2.0, 99.0])] + [("b%d" % k, 2, 10 + k, 0, 0.0, 0.0, 5.0) for k in range(5)]
    rows += [("b%d" % k, 3, 20 + k, 0, 0.0, 0.0, v) for k, v in enumerate([10.0, 11.0, 12.0, 13.0, 200.0])]
    for method in ("iqr", "robust", "percentile", "minmax", "zscore"):
        got = {r.event_id: r.speed_corrected for r in speeds.correct_outliers(ticks(spark, rows), method).collect()}
        assert [got[k] for k in range(3)] == [1.0, 2.0, 99.0] and got[12] == 5.0
        assert got[24] < 200 or method == "zscore"


def test_empty_streaks_and_source_choice(spark):
    rows = spark.createDataFrame([(k, 0, v) for k, v in enumerate([5, 0, -1, 0, 7, 0])], "sweep_id long, source_idx int, vehicles int")
    assert [r.streak for r in speeds.empty_streak(rows).orderBy("sweep_id").collect()] == [0, 1, 2, 3, 0, 1]
    assert feeds.next_source(0, 0, [0, 1], {0: 0, 1: 9}) == 0
    assert feeds.next_source(0, 0, [0, 1], {0: 0, 1: 10}) == 1
    assert feeds.next_source(1, 0, [0, 1], {0: 10, 1: 3}) == 0
    assert feeds.next_source(1, 0, [0, 1], {0: 9, 1: 3}) == 1


# ---- scalars ----------------------------------------------------------------------------------
def test_half_up_and_bins(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(geo.round_half_up(F.col("x"))).collect()] == [-2.0, 3.0, None, None]
    values = spark.createDataFrame([(0.0,), (5.0,), (6.2,), (8.5,), (21.0,), (22.0,), (81.0,)], "v double")
    got = [r[0] for r in values.select(speed.speed_bin(F.col("v"), speed.fixed_edges("calc"), speed.SPIKE["calc"])).collect()]
    assert got == ["stopped", None, "very slow", "normal", "very fast", None, "spike"]
    edges = spark.range(1).select(F.array(*speed.bin_edges("raw", 300.0)).alias("e")).first().e
    assert all(a < b for a, b in zip(edges, edges[1:]))


def test_headsigns_and_labels(spark):
    df = spark.createDataFrame([("KL SENTRAL - MRT/LRT HUB",), ("O'BRIEN 2nd",)], "h string")
    assert [r[0] for r in df.select(labels.title_case_headsign(F.col("h"))).collect()] == ["KL Sentral ~ MRT/LRT Hub", "O'Brien 2nd"]
    rows = spark.createDataFrame([("1", "T1", "Long", None), ("2", "T789", "", "PPR BARU"), ("3", "", "", "X"), ("4", "Odd name", "", "X")], "i string, s string, l string, h string")
    got = [r[0] for r in rows.select(labels.route_label(*map(F.col, "islh"))).collect()]
    assert got == ["T1 – Long", "T789 – PPR Baru", "3", "Odd name"]
    codes = spark.createDataFrame([(1183, 0.0), (1000, 0.2), (42, None), (None, None)], "c int, p double")
    assert [tuple(r) for r in codes.select(labels.weather_label(F.col("c")), labels.is_rainy(F.col("p"), F.col("c"))).collect()] == [("Light rain", True), ("Clear", True), ("Code 42", False), ("Unknown", False)]


def test_single_cell_density_and_bearing(spark):
    df = spark.createDataFrame([("a", 3.0, 101.0), ("a", 3.0, 101.0), ("b", 3.0, 101.0)], "bus_id string, lat double, lon double")
    grid = heatmap.density_grid(df)
    assert one(grid)["count"] == 2 and one(heatmap.density_rank_class(grid)).stop == 6
    assert one(heatmap.density_thresholds(grid)).thresholds == [2, 3, 4, 5, 6]
    two = spark.createDataFrame([("r", 3.0, 101.0), ("r", 3.1, 101.0)], "route string, lat double, lon double")
    assert one(heatmap.principal_bearing(two)).bearing is None
    assert tuple(one(heatmap.data_hour_range(spark.createDataFrame([], "time_ms long")))) == (0, 23)


# ---- shapes -----------------------------------------------------------------------------------
def test_sticky_shape_and_slices(spark):
    line = lambda sid, off: [(sid, "R", k, 3.139 + off, 101.6869 + k * 0.001) for k in range(5)]
    two = spark.createDataFrame(line("S1", 0.0) + line("S2", 0.00018), "shape_id string, route string, seq int, lat double, lon double")  # 20 m apart
    pts = [("a", 1, 1, 3.139, 101.6875), ("a", 2, 2, 3.13918, 101.6885), ("a", 3, 3, 3.2, 101.6885), ("a", 4, 4, 3.13918, 101.6890)]
    points = spark.createDataFrame(pts, "bus_id string, tick_id long, event_id long, lat double, lon double").withColumn("route", F.lit("R")).withColumn("speed", F.lit(5.0))
    got = {r.event_id: r.snap_shape_id for r in shapes.sticky_shape(points, two).collect()}
    assert got == {1: "S1", 2: "S1", 3: None, 4: "S1"}
    trail = shapes.snap_trail(points, two)
    assert {r.event_id: r.source for r in trail.collect()} == {1: "on_route", 2: "gap", 3: "gap"}
    paths = {r.event_id: r.path for r in shapes.trail_paths(trail, points, two).collect()}
    assert len(paths[1]) == 3 and paths[1][1].lon == pytest.approx(101.6879) and paths[2] is None
    assert shapes.merge_segments(shapes.trail_paths(trail, points, two)).count() == 1


# ---- clusters ---------------------------------------------------------------------------------
def plain_link(distances, method):
    """The pair of least distance in a full scan, again and again."""
    order, size, merges = list(range(len(distances))), {k: 1 for k in range(len(distances))}, []
    d = {(a, b): distances[a][b] for a in order for b in order}
    while len(order) > 1:
        best = min((d[a, b], x, y) for x, a in enumerate(order) for y, b in enumerate(order) if x < y)
        a, b, number = order[best[1]], order[best[2]], len(distances) + len(merges)
        size[number] = size[a] + size[b]
        merges.append((a, b, best[0], size[number]))
        order = [k for k in order if k not in (a, b)]
        for c in order:
            if method == "ward":
                new = max(0, ((size[a] + size[c]) * d[a, c] ** 2 + (size[b] + size[c]) * d[b, c] ** 2 - size[c] * best[0] ** 2) / (size[a] + size[b] + size[c])) ** 0.5
            else:
                new = (size[a] * d[a, c] + size[b] * d[b, c]) / (size[a] + size[b])
            d[number, c] = d[c, number] = np.floor(new * 1e9 + 0.5) / 1e9
        order.append(number)
    return merges


@pytest.mark.parametrize("method", ["ward", "average"])
def test_linkage_equals_a_full_scan(method):
    rng = np.random.default_rng(4)
    for n, values in ((2, 3), (5, 2), (17, 3), (30, 1000), (40, 4)):  # few values are many ties
        upper = np.triu(rng.integers(1, values + 1, (n, n)), 1).astype(float)
        distances = upper + upper.T
        got, want = clusters.link(distances, method), plain_link(distances, method)
        assert [m[:2] + m[3:] for m in got] == [m[:2] + m[3:] for m in want] and np.allclose([m[2] for m in got], [m[2] for m in want])
    assert clusters.link(np.zeros((1, 1)), method) == []


def test_linkage_of_two_thousand_routes():
    import time

    x = np.random.default_rng(5).normal(size=(2000, 8))
    distances = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    began = time.process_time()
    assert len(clusters.link(distances, "ward")) == 1999 and time.process_time() - began < 20


def test_linkage_and_cut():
    x = np.array([0.0, 1.0, 10.0, 11.5, 30.0])
    d = np.abs(x[:, None] - x[None, :])
    merges = clusters.link(d, "average")
    assert [m[:2] for m in merges] == [(0, 1), (2, 3), (5, 6), (4, 7)]
    assert merges[2][2] == pytest.approx(10.25)
    cut = clusters.cut(merges, 5, 3)
    assert cut == [(4, 1), (0, 2), (1, 2), (2, 3), (3, 3)]
    ties = clusters.link(np.ones((3, 3)) - np.eye(3), "ward")
    assert ties[0][:2] == (0, 1)


# ---- archives ---------------------------------------------------------------------------------
def test_json_archive_and_compaction(spark, tmp_path):
    good = {"bus_id": "a", "route": "R1", "t": 1700000000000, "lat": 3.0, "lon": 101.0, "speed_raw": 4.0}
    nowhere = {"bus_id": "b", "time": 1700000000001, "lat": None, "lon": None}
    (tmp_path / "day.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(nowhere) + '\n{"bus_id": "c", "ti')
    rows = history.normalize(history.read_ticks_json(spark, str(tmp_path / "day.jsonl"))).orderBy("bus_id").collect()
    assert [(r.bus_id, r.time, r.speed, r.feed_source) for r in rows] == [("a", 1700000000000, 4.0, "rapid-bus-kl"), ("b", 1700000000001, None, "rapid-bus-kl")]
    assert history.compact_day(spark, str(tmp_path / "day.jsonl"), str(tmp_path / "day.parquet")) == 2
    back = history.read_history(spark, str(tmp_path / "day.parquet")).collect()
    assert [r.bus_id for r in back] == ["a"]
    (tmp_path / "none.jsonl").write_text("\n")
    assert history.compact_day(spark, str(tmp_path / "none.jsonl"), str(tmp_path / "none.parquet")) == 0
    assert not (tmp_path / "none.parquet").exists()


def test_network_files(spark, tmp_path):
    (tmp_path / "shapes.txt").write_text("shape_id, shape_pt_lat,shape_pt_lon,shape_pt_sequence\nS1, 3.1,101.5,1\nS1,bad,101.6,2\n")
    rows = network.network_shapes(network.read_gtfs(spark, str(tmp_path), "shapes")).collect()
    assert [tuple(r) for r in rows] == [("S1", 1, 3.1, 101.5)]
    assert network.read_gtfs(spark, str(tmp_path), "extended_shapes").count() == 0
    with pytest.raises(FileNotFoundError):
        network.read_gtfs(spark, str(tmp_path), "routes")
    assert network.sources(spark).count() == 14


def field(number, kind, body):
    head = bytes([number << 3 | kind])
    return head + (bytes([len(body)]) + body if kind == 2 else body)


def test_feed_snapshots(spark, tmp_path):
    place = field(1, 5, struct.pack("<f", 3.5)) + field(2, 5, struct.pack("<f", 101.5)) + field(5, 5, struct.pack("<f", 10.0))
    vehicle = field(1, 2, field(1, 2, b"T9") + field(5, 2, b"R9")) + field(2, 2, place) + field(5, 0, b"\x80\x01") + field(8, 2, field(1, 2, b"BUS1"))
    bare = field(2, 2, place)
    message = field(2, 2, field(1, 2, b"e1") + field(4, 2, vehicle)) + field(2, 2, field(1, 2, b"e2") + field(4, 2, bare)) + field(2, 2, field(1, 2, b"e3"))
    (tmp_path / "a.pb").write_bytes(message)
    (tmp_path / "torn.pb").write_bytes(message[:-3] + b"\xff")
    rows = {r.entity_id: r for r in network.decode_feed(spark.read.format("binaryFile").load(str(tmp_path / "a.pb"))).collect()}
    assert set(rows) == {"e1", "e2"}
    assert (rows["e1"].bus_id, rows["e1"].trip_id, rows["e1"].rt_route_id, rows["e1"].timestamp_s, rows["e1"].speed_ms) == ("BUS1", "T9", "R9", 128, 10.0)
    assert rows["e2"].bus_id == "e2" and rows["e2"].timestamp_s > 1_700_000_000
    assert network.decode_feed(spark.read.format("binaryFile").load(str(tmp_path))).count() >= 2


def test_weather_range_is_bounded(spark):
    with pytest.raises(ValueError):
        weather.weather_range(spark, fx.weather(spark), 0, 90)


def test_live_views_from_state(spark, tmp_path):
    """Rows out of order, more than a ring holds and over midnight; the state of a day goes after it, and its stragglers with it."""
    noon = 1704081600000
    rows = [("b1", "R1", noon + (k * 37 % 200) * 1000, k, 3.0, 101.0, float(k % 90)) for k in range(200)]
    rows += [("b2", "R1", noon + k, 900 + k, 3.0, 101.0, 30.0 + k) for k in range(3)] + [("b2", None, noon, 990, None, 101.0, None), ("b2", "R1", noon, 991, 3.0, 101.0, 500.0)]
    pos = _wide(spark.createDataFrame(rows, "bus_id string, route string, time_ms long, event_id long, lat double, lon double, speed double"))
    folder = str(tmp_path)
    sort = lambda df: sorted(map(str, df.collect()))

    def session(view, name, keys):
        with keyed.with_rocksdb(spark):
            query = keyed.keep(view(spark.readStream.option("maxFilesPerTrigger", 1).schema(pos.schema).parquet(f"{folder}/in")), f"{folder}/{name}", f"{folder}/{name}-log", "day" in keys)
            query.awaitTermination()
        return keyed.newest(spark.read.parquet(f"{folder}/{name}"), keys), query.recentProgress

    for part in range(3):
        pos.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    cells, _ = session(keyed.live_heatmap, "cells", ["day", "route", "hour"])
    batch = heatmap.speed_heatmap(pos)
    assert sort(cells.select("route", "hour", "value", "bin", "n")) == sort(batch.select("route", "hour", "value", "bin", "n")) and cells.count() == 1
    bins, _ = session(keyed.live_timeline, "bins", ["bus_id", "day", "bin"])
    columns = ["bus_id", "bin", "raw", "trust", "n"]
    assert sort(bins.select(columns)) == sort(speeds.speed_timeline(pos).select(columns))
    trails, _ = session(keyed.live_trails, "trails", ["bus_id"])
    want = {r.bus_id: [p.event_id for p in r.trail] for r in speeds.recent_trail(pos).collect()}
    assert {r.bus_id: r.e for r in trails.groupBy("bus_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("time_ms", "event_id"))), lambda p: p["event_id"]).alias("e")).collect()} == want

    day = 86_400_000
    moved = pos.filter("speed = 31.0")
    for days in (1, 2):  # the second batch sees the watermark of the first
        moved.withColumn("time_ms", F.col("time_ms") + days * day).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    moved.withColumn("speed", F.lit(1.0)).coalesce(1).write.mode("append").parquet(f"{folder}/in")  # two days late
    cells, progress = session(keyed.live_heatmap, "cells", ["day", "route", "hour"])
    held = [sum(s["numRowsTotal"] for s in json.loads(p.json)["stateOperators"]) for p in progress]
    assert cells.count() == 3 and held[-1] < held[0]
    first = cells.filter(F.col("day") == noon // day).select("value", "n")
    assert sort(first) == sort(batch.select("value", "n"))


def _wide(pos):
    for c in ("speed_corrected", "calculated_speed", "speed_kalman", "weighted_speed"):
        pos = pos.withColumn(c, F.lit(None).cast("double"))
    return pos


def test_late_rows_are_filed_by_arrival(spark):
    midnight = 1704038400000
    rows = spark.createDataFrame([("a", midnight - 1000, midnight + 1000)], "bus_id string, time_ms long, arrival_ms long")
    assert str(one(history.with_ingest_date(rows)).ingest_date) == "2024-01-01"


def test_fleet_filter_same_route(spark):
    rows = spark.createDataFrame([("a", "R1", 5.0), ("b", "R1", 0.0), ("c", "R2", 9.0)], "bus_id string, route string, speed double")
    assert {r.bus_id for r in routes.fleet_filter(rows, same_as="a").collect()} == {"a", "b"}
    assert {r.bus_id for r in routes.fleet_filter(rows, hide_stationary=True).collect()} == {"a", "c"}


def test_replayed_ranges_are_bounded_and_in_order(spark, tmp_path, monkeypatch):
    from transitloom.plans import archive

    made = spark.range(2400).selectExpr("id AS event_id", "id div 4 + 1 AS tick_id")
    monkeypatch.setattr(archive.fx, "pos_dense", lambda spark, sf_dir: made)
    seen = []

    def run(ticks):
        each = lambda batch, number: seen.append(batch.selectExpr("min(tick_id)", "max(tick_id)", "count(*)").first())
        return ticks.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()

    archive._replay(spark, SF, str(tmp_path), run)
    assert [tuple(r) for r in seen] == [(1, 150, 600), (151, 300, 600), (301, 450, 600), (451, 600, 600)]


def test_a_torn_snapshot_gives_none():
    from transitloom.plans.files import message

    whole = message([{"entity": "e1", "bus": "b1", "trip": "t1", "route": "r1", "lat": 3.0, "lon": 101.0, "speed": 4.0, "stamp": None}])
    assert list(network.vehicles(whole, 7)) == [("e1", "b1", "t1", "r1", 3.0, 101.0, None, 4.0, 7)]
    for cut in range(3, len(whole)):
        with pytest.raises((IndexError, struct.error)):
            list(network.vehicles(whole[:cut], 7))


# ---- maintenance ------------------------------------------------------------------------------
def test_maintenance_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    day, store = 86_400_000, str(tmp_path / "archive")
    at = lambda d, slot, n: 1704038400000 + d * day + slot * 1_800_000 + n * 1000
    known = [(f"b{b}", "R1", at(d, s, b), 3.06 + s * 0.0016, 101.61 + s * 0.0012) for b in range(3) for d in range(4) for s in range(4)]
    learners = [("u", None, at(d, s, n), 3.2 + s * 0.001, 101.9) for d in range(4) for s in range(4) for n in range(10)]
    rows = spark.createDataFrame(known + learners, "bus_id string, route string, time_ms long, lat double, lon double").withColumn("shape_id", F.lit("clashes")).withColumn("adj_lat", F.lit(9.0))
    today = 1704038400000 // day + 1 + 3  # the local day of the newest rows
    run = lambda rows, today: one(maintenance.run_maintenance(rows, fx.shapes(spark), store, today)).asDict()

    none = run(rows.filter("false"), today)
    assert set(none.values()) == {0}
    back = maintenance._read_back
    monkeypatch.setattr(maintenance, "_read_back", lambda s, staged: back(s, staged).withColumn("wrote", F.when(F.col("day") == today - 1, 0).otherwise(F.col("wrote"))))
    first = run(rows, today)
    assert (first["scanned_days"], first["promoted"], first["days_augmented"], first["days_held_back"]) == (3, 1, 2, 1)
    monkeypatch.setattr(maintenance, "_read_back", back)
    second = run(rows, today)
    assert (second["observations_written"], second["promoted"], second["days_augmented"], second["days_held_back"]) == (0, 0, 1, 0)
    last = run(rows, today + 1)
    assert (last["observations_written"], last["days_augmented"], last["rows_converted"]) == (0, 1, 52)
    # a commit whose rename fails names no day, and the next run does them
    def no_rename(self, source, target):
        raise OSError("answered false")

    fresh = str(tmp_path / "fresh")
    with monkeypatch.context() as m:
        m.setattr(Files, "rename", no_rename)
        failed = one(maintenance.run_maintenance(rows, fx.shapes(spark), fresh, today)).asDict()
    assert (failed["days_augmented"], failed["days_held_back"], failed["rows_converted"]) == (0, 3, 0)
    assert Manifest(spark, f"{fresh}/days").read("bus_id string").count() == 0
    again = one(maintenance.run_maintenance(rows, fx.shapes(spark), fresh, today)).asDict()
    assert (again["days_augmented"], again["days_held_back"]) == (3, 0) and Manifest(spark, f"{fresh}/days").read("bus_id string").count() == again["rows_converted"]
    monkeypatch.setattr(maintenance, "FILE_ROWS", 20)  # several tasks a day
    dealt = str(tmp_path / "dealt")
    assert one(maintenance.run_maintenance(rows, fx.shapes(spark), dealt, today)).asDict() == {**again, "observations_written": first["observations_written"], "promoted": 1, "candidates": first["candidates"], "skipped": first["skipped"]}

    days = Manifest(spark, f"{store}/days")
    assert [(r.day, r.rows) for r in days.entries().orderBy("day").collect()] == [(today - 3 + k, 52) for k in range(4)] and len(days._commits()) == 3
    held = days.read(rows.schema.add("snap_shape_id", "string"))
    assert held.count() == rows.count() and held.filter("adj_lat = 9 or shape_id <> 'clashes'").count() == 0
    assert {r.snap_shape_id for r in held.filter("bus_id = 'u'").select("snap_shape_id").distinct().collect()} == {"LRN_u"}
    assert spark.read.parquet(f"{store}/learned").count() == 4 and not list((tmp_path / "archive").glob("staged-*"))


# archives and their files


def test_renames_are_checked(spark, tmp_path, monkeypatch):
    files = Files(spark, str(tmp_path))
    files.write_new(f"{tmp_path}/a", [{"day": 1}])
    with pytest.raises(Exception):
        files.write_new(f"{tmp_path}/a", [{"day": 2}])
    files.write(f"{tmp_path}/b", b"new")
    with pytest.raises(FileExistsError):
        files.rename(f"{tmp_path}/b", f"{tmp_path}/a")
    with pytest.raises(Exception):
        files.rename(f"{tmp_path}/none", f"{tmp_path}/c")
    rename = Files.rename

    def fails(self, source, target):
        if source.endswith("b"):
            raise OSError("no")
        rename(self, source, target)

    monkeypatch.setattr(Files, "rename", fails)
    with pytest.raises(OSError):
        files.replace(f"{tmp_path}/b", f"{tmp_path}/a")
    assert files.read(f"{tmp_path}/a") == b'{"day": 1}\n' and files.read(f"{tmp_path}/b") == b"new"
    monkeypatch.undo()
    files.replace(f"{tmp_path}/b", f"{tmp_path}/a")
    assert files.read(f"{tmp_path}/a") == b"new" and files.names(str(tmp_path)) == ["a"]


def test_a_scan_reads_the_days_asked_for_and_misses_nothing_silently(spark, tmp_path):
    from transitloom.sources import scan

    data = tmp_path / "data"
    rows = lambda n: spark.createDataFrame([(f"B{k}", "R1", k, 3.0, 101.0) for k in range(n)], "bus_id string, route string, time long, lat double, lon double")
    rows(3).coalesce(1).write.parquet(f"{data}/2024-01-01.parquet")
    rows(0).coalesce(1).write.parquet(f"{data}/2024-01-02.parquet")  # a day without rows is readable
    rows(5).write.json(f"{data}/2024-01-03.jsonl")
    (data / "2024-01-04.parquet").write_bytes(b"PAR1 torn")
    rows(2).write.json(f"{data}/old/2024-01-05.jsonl")  # not in the folder itself
    (data / "notes.parquet").write_bytes(b"no day")
    archive = scan.Archive(spark, {"data": str(data), "history": str(tmp_path / "none")})
    told = [(str(r.day), r.source, r.rows, r.passed_over) for r in archive.catalog.collect()]
    assert told == [("19726", None, None, 1), ("19725", "jsonl", None, 0), ("19724", "local_parquet", 0, 0), ("19723", "local_parquet", 3, 0)]
    assert archive.scan().count() == 8 and archive.scan(19725).count() == 5 and archive.scan(last=19723).count() == 3
    plan = archive.scan(last=19723).select("bus_id")._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-03" not in plan and "lat" in plan and "speed_kalman" not in plan.split("ReadSchema")[1]
    assert scan.Archive(spark, {"data": str(tmp_path / "none")}).scan().count() == 0
    part = next((data / "2024-01-01.parquet").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:200])  # torn after the probe
    with pytest.raises(Exception):
        archive.scan(last=19723).count()


def test_a_cluster_has_to_name_its_shared_folder():
    from types import SimpleNamespace as Made

    from transitloom.runtime import shared_dir

    def session(master, **conf):
        return Made(conf=Made(get=lambda key, other=None: conf.get(key.split(".")[1], other)), sparkContext=Made(master=master, getCheckpointDir=lambda: None))

    assert shared_dir(session("yarn", checkpoint="hdfs://store/shared/")) == "hdfs://store/shared"
    assert shared_dir(session("local[4]", sql="/tmp/warehouse")) == "/tmp/warehouse/shared"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            shared_dir(session(master, sql="/tmp/warehouse"))


def test_exact_medians_of_a_hot_key(spark):
    """Most rows are of one key; nulls are keys, and a key's middle may lie between two ranges."""
    from transitloom.operators.medians import exact_median

    rng = np.random.default_rng(6)
    rows = [("hot", None, float(v), int(n)) for v, n in zip(rng.normal(0, 40, 4000).round(2), rng.integers(1, 4, 4000))]
    rows += [("a", "x", 0.5, 1), ("a", "x", 7.5, 1), ("b", None, -3.25, 5), (None, None, 1.0, 1), (None, None, 2.0, 2), ("c", "y", None, 3), ("c", "y", 9.0, 0)]
    table = spark.createDataFrame(rows, "k string, l string, value double, n long")
    got = {(r.k, r.l): (r["median"], r.n) for r in exact_median(table, ["k", "l"], 1.0).collect()}
    groups = {}
    for k, l, v, n in rows:
        if v is not None and n:
            groups.setdefault((k, l), []).extend([v] * n)
    assert got == {key: (float(np.median(vs)), len(vs)) for key, vs in groups.items()}
    plan = exact_median(table, ["k", "l"], 1.0)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows and not any("value" in x and "part" not in x for x in windows)  # values are only ranked within a range


def test_nearest_nodes_by_a_full_scan(spark):
    from transitloom.operators import roads

    rng = np.random.default_rng(7)
    nodes = [(k, 3.0 + rng.random() * 0.03, 101.0 + rng.random() * 0.03) for k in range(150)] + [(900, 3.0101, 101.0101), (901, 3.0101, 101.0101), (902, None, 101.0)]
    main = [k for k in range(150) if nodes[k][1] < 3.012]
    points = [(k, 2.99 + rng.random() * 0.05, 100.99 + rng.random() * 0.05) for k in range(400)] + [(998, 3.0101, 101.0101), (999, None, 101.0)]
    schema = "node_id long, lat double, lon double"
    table = spark.createDataFrame(nodes, schema)
    found = roads.nearest_node(spark.createDataFrame(points, "point_id long, lat double, lon double"), table, table.filter(F.col("node_id").isin(main)).select("node_id"))
    got = {r.point_id: (r.node_id, r.dist_m) for r in found.collect()}

    def metres(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        return 2 * 6371000 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))

    want = {}
    for p, lat, lon in points[:-1]:
        near = [(n not in main, metres(lat, lon, y, x), n) for n, y, x in nodes if y is not None and abs(np.floor(lat / 0.002) - np.floor(y / 0.002)) <= 4 and abs(np.floor(lon / 0.002) - np.floor(x / 0.002)) <= 4]
        if near:
            want[p] = min(near)[::-1][:2]
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    assert len({n in main for n, _ in got.values()}) == 2


def test_cells_of_a_long_ferry_line(spark):
    """Every cell within reach of a segment, and few others: a diagonal of 40 km has its line's and not its box's."""
    reach, size = 200.0, shapes.CELL_M
    lines = [(0, 0.0, 0.0, 28_000.0, 28_000.0), (1, 500.0, 900.0, 500.0, -3_000.0), (2, 10.0, 10.0, 10.0, 10.0), (3, 3_000.0, 100.0, -2_000.0, 900.0)]
    rows = spark.createDataFrame(lines, "seg long, ax double, ay double, bx double, by double")
    got = {}
    for r in shapes.gridded(rows, reach).collect():
        got.setdefault(r.seg, []).append((r.cell_x, r.cell_y))
    rng = np.random.default_rng(9)
    for seg, ax, ay, bx, by in lines:
        cells = set(got[seg])
        assert len(cells) == len(got[seg])
        t, angle, far = rng.random(4000), rng.random(4000) * 2 * np.pi, np.sqrt(rng.random(4000)) * reach
        x, y = ax + t * (bx - ax) + far * np.cos(angle), ay + t * (by - ay) + far * np.sin(angle)
        assert {(int(a), int(b)) for a, b in zip(np.floor(x / size), np.floor(y / size))} <= cells
    assert len(got[0]) < 72 * 6


def test_ranks_of_a_hot_cell_in_pieces(spark):
    """Nine rows in ten are of one cell: places are those of one sort, and no window takes the whole cell."""
    from transitloom.operators.medians import ranked

    rng = np.random.default_rng(10)
    rows = [("hot" if k % 10 else None, None if k % 97 == 0 else int(t), k) for k, t in enumerate(rng.integers(0, 90_000_000, 3000))]
    table = spark.createDataFrame(rows, "cell string, time_ms long, event_id long")
    made = ranked(table, ["cell"])
    got = {r.event_id: (r._i, r._len) for r in made.collect()}
    for cell in ("hot", None):
        own = sorted((r for r in rows if r[0] == cell), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == [(i, len(own)) for i in range(len(own))]
    windows = [x for x in made._jdf.queryExecution().executedPlan().toString().split("\n") if "row_number" in x and "Window" in x]
    assert windows and all("_part" in x for x in windows)


def test_reachability_by_blocks(spark, tmp_path, monkeypatch):
    """A way of 600 hops in blocks of 100 takes some six rounds; random graphs as a plain search finds them."""
    from transitloom.operators import roads

    monkeypatch.setattr(roads, "shared_dir", lambda session: str(tmp_path))
    table = lambda rows: spark.createDataFrame(rows, "from_node long, to_node long")
    seeds = lambda *rows: spark.createDataFrame([(k,) for k in rows], "node_id long")
    got = roads.reachable(table([(k, k + 1) for k in range(600)] + [(None, 3), (4, None), (900, 5)]), seeds(0), block_nodes=100)
    assert sorted(r.node_id for r in got.collect()) == list(range(601))
    assert len(list(next(tmp_path.glob("reached-*")).glob("round=*"))) <= 10
    rng = np.random.default_rng(11)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (140, 2))]
    seen, waiting = set(), [3, 700]
    while waiting:
        node = waiting.pop()
        if node not in seen:
            seen.add(node)
            waiting += [b for a, b in edges if a == node]
    assert {r.node_id for r in roads.reachable(table(edges), seeds(3, 700, None), block_nodes=25).collect()} == seen
    assert roads.reachable(table(edges), seeds()).count() == 0
