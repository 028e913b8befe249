"""Small tables that larger ones brought up."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from transitloom.plans.registry import ORACLES, QUERIES


def _events(spark, tmp_path_factory, rows):
    """A folder with an events table of (event_id, user_id, value, k), a minute apart."""
    folder = tmp_path_factory.mktemp("events")
    first = datetime.datetime(2024, 1, 1)
    made = [{"event_id": e, "ts": first + datetime.timedelta(minutes=i), "user_id": u, "event_type": "view", "value": v, "props": f'{{"k": {k}}}'} for i, (e, u, v, k) in enumerate(rows)]
    kinds = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    pq.write_table(pa.Table.from_pylist(made, kinds), f"{folder}/events.parquet")
    return str(folder)


def _twin(folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    made = con.execute(ORACLES[name])
    return [c[0] for c in made.description], made.fetchall()


def _same(spark, folder, name):
    names, theirs = _twin(folder, name)
    ours = [tuple(r) for r in QUERIES[name](spark, folder).select(*names).collect()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))
    return ours


@pytest.mark.parametrize("name", ["k1_kalman_speed", "k2_kalman_stream", "k11_warm_filter"])
def test_a_speed_at_a_limit_of_the_filter_is_judged_as_in_sql(name, spark, tmp_path_factory):
    # clamped to 150 km/h, and 130.0 is measured: their difference is 20 but for the last bit
    rows = [(1501026, 24080, 44.63, 31), (1501729, 24080, 9.69, 61), (1502249, 24080, 129.98, 19), (1502835, 24080, 78.27, 38)]
    assert (1502835, 60.2296) in _same(spark, _events(spark, tmp_path_factory, rows), name)


def test_a_path_looks_over_its_shape_once_for_each_end(spark):
    from pyspark.sql import functions as F

    from transitloom.operators import shapes

    network = spark.createDataFrame([("S", "R", k, 3.1 + k * 0.001, 101.6 + k % 2 * 0.001) for k in range(12)], "shape_id string, route string, seq int, lat double, lon double")
    points = spark.createDataFrame([("B", "R", k, k, 3.1 + k * 0.0013, 101.6, 30.0) for k in range(8)], "bus_id string, route string, event_id long, tick_id long, lat double, lon double, speed double")
    paths = shapes.trail_paths(shapes.snap_trail(points, network), points, network)
    assert paths._jdf.queryExecution().optimizedPlan().toString().count("cum <") == 2
    vertices = spark.createDataFrame([([(0.0, 0.0, 0.0), (10.0, 1.0, 0.0), (10.0, 1.0, 0.0), (30.0, 3.0, 2.0)],)], "v array<struct<cum:double,lon:double,lat:double>>")
    cuts = {(0.0, 0.0): [(0, 0)] * 2, (-5.0, 10.0): [(0, 0), (1, 0)], (10.0, 20.0): [(1, 0)] * 3 + [(2, 1)], (20.0, 99.0): [(2, 1), (3, 2)], (0.0, 30.0): [(0, 0), (1, 0), (1, 0), (3, 2)], (9.0, 5.0): None}
    for (low, high), want in cuts.items():
        got = vertices.select(shapes.slice_shape(F.col("v"), F.lit(low), F.lit(high)).alias("p")).first().p
        assert (got and [tuple(p) for p in got]) == want


def test_a_position_meets_two_slots_of_its_bus_and_not_a_table_of_all(spark, tmp_path):
    from transitloom.operators import crossday

    half = 1_800_000
    midnight = 1_704_067_200_000 - 28_800_000
    at = lambda slot, lat: ("B", "R", midnight + slot * half, lat, 101.6)
    rows = [at(0, 3.0), at(2, 3.2), at(47, 3.4), ("B", "Unknown", midnight + 4 * half, 3.6, 101.6), ("C", "R", midnight + 2 * half, 3.3, 101.6), ("D", "", midnight, 3.1, 101.6), (None, "R", midnight, 3.5, 101.6)]
    pos = spark.createDataFrame(rows, "bus_id string, route string, time_ms long, lat double, lon double")
    found = crossday.adjust_positions(pos, crossday.cross_day_model(pos))
    assert "map<" not in str(found._jdf.queryExecution().analyzed().schemaString()) and "_slots" not in found._jdf.queryExecution().analyzed().toString()
    got = {(r.bus_id, r.route, r.time_ms): (r.adj_source, r.adj_lat and round(r.adj_lat, 6)) for r in found.collect()}
    key = lambda r: r[:3]
    assert got == {key(rows[0]): ("raw", 3.0), key(rows[1]): ("raw", 3.2), key(rows[2]): ("raw", 3.4), key(rows[3]): ("raw", 3.6), key(rows[4]): ("raw", 3.3), key(rows[5]): ("raw", 3.1), key(rows[6]): ("model", 3.25)}


def test_a_rolling_model_keeps_no_medians_of_speeds(spark, tmp_path):
    from transitloom.operators.rolling import RollingDays

    rows = spark.createDataFrame([("B", "R", 1_704_067_200_000, 3.0, 101.6)], "bus_id string, route string, time_ms long, lat double, lon double")
    held = RollingDays(spark, str(tmp_path), ("places",))
    held.enter(rows)
    assert sorted(r.tier for r in held.model().collect()) == [1, 2, 3]
    assert not (tmp_path / "speeds").exists()


@pytest.mark.parametrize("name", ["heatmap", "timeline", "trails"])
def test_buses_share_states(spark, tmp_path, name):
    """A live view of 1,200 buses, from stored rows on, holds and touches as many states as its buses have parts."""
    from pyspark.sql import functions as F

    from transitloom.operators import heatmap, speeds
    from transitloom.streaming import keyed

    start = 1704081600000
    pos = spark.range(3600).selectExpr("'B' || (id % 1200) AS bus_id", "'R1' AS route", f"{start} + id AS time_ms", "id AS event_id", "3.0D AS lat", "IF(id % 7 = 0, NULL, 101.0D) AS lon", "CAST(id * 31 % 900 / 10 AS DOUBLE) AS speed")
    for c in ("speed_corrected", "calculated_speed", "speed_kalman", "weighted_speed"):
        pos = pos.withColumn(c, F.lit(None).cast("double"))
    stored, folder = pos.filter("event_id < 1200"), str(tmp_path)
    pos.filter("event_id >= 1200").write.parquet(f"{folder}/in")
    views = {
        "heatmap": (lambda t: keyed.live_heatmap(t, warm=keyed.stored_rings(stored)), ["day", "route", "hour"], heatmap.speed_heatmap(pos), ["route", "hour", "value", "bin", "n"]),
        "timeline": (lambda t: keyed.live_timeline(t, keyed.stored_bins(stored)), ["bus_id", "day", "bin"], speeds.speed_timeline(pos), ["bus_id", "bin", "raw", "trust", "n"]),
        "trails": (lambda t: keyed.live_trails(t, warm=keyed.stored_trails(stored)), ["bus_id"], pos, ["bus_id", "time_ms", "event_id", "lat", "lon", "speed"]),
    }
    view, keys, want, columns = views[name]
    with keyed.with_rocksdb(spark):
        query = keyed.keep(view(spark.readStream.schema(pos.schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/log", "day" in keys)
        query.awaitTermination()
    held = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    assert held and max(held) <= 2 * keyed.PARTS
    sort = lambda df: sorted(map(str, df.select(columns).collect()))
    assert sort(keyed.newest(spark.read.parquet(f"{folder}/out"), keys)) == sort(want)


def test_a_stream_without_repeats_carries_what_its_result_needs(spark, tmp_path_factory, monkeypatch):
    from transitloom.plans import archive

    kept, seen = archive.live.without_repeats, []
    monkeypatch.setattr(archive.live, "without_repeats", lambda ticks, *rest: seen.append(set(ticks.columns)) or kept(ticks, *rest))
    _same(spark, _events(spark, tmp_path_factory, [(e, e % 3, 20.0, 1) for e in range(1, 40)]), "k10_without_repeats")
    assert seen and all(columns <= {"bus_id", "tick_id", "at", "copy"} for columns in seen)


def test_an_axis_reads_its_cells_where_they_were_written(spark, tmp_path_factory):
    folder = _events(spark, tmp_path_factory, [(e, e % 12, 20.0 + e % 7, e % 50) for e in range(1, 120)])
    _same(spark, folder, "t3_active_axis")
    assert not any("events.parquet" in file for file in QUERIES["t3_active_axis"](spark, folder).inputFiles())


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


def test_a_maintenance_reads_its_positions_once(spark, tmp_path):
    from transitloom.operators import maintenance
    from transitloom.plans import fixtures as fx

    first = 1_704_067_200_000
    rows = [(e, f"B{e % 5}", "R1" if e % 5 else "Unknown", first + e * 3_600_000, 3.06 + e % 7 * 0.0016, 101.61 + e % 7 * 0.0012) for e in range(72)]
    source = spark.createDataFrame(rows, "event_id long, bus_id string, route string, time_ms long, lat double, lon double")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    report = maintenance.run_maintenance(source.mapInArrow(counted, source.schema), fx.shapes(spark), str(tmp_path / "store"), first // 86_400_000 + 9).first()
    assert report.rows_converted == len(rows) and report.rows_with_snap > 0 and report.days_held_back == 0
    assert seen.value == len(rows)


def test_medians_of_a_bus_come_from_a_scan_of_its_slots(spark, small_batches):
    from pyspark.sql import functions as F

    from transitloom.operators import crossday

    first = 1_704_067_200_000 - 28_800_000
    buses, routes = ["A", "A", "A", "B", None, ""], ["R1", "R2", "Unknown", None, "", "R1"]
    rows = [(buses[i * i % 6], routes[i * 7 % 11 % 6], first + i % 3 * 1_800_000 + i % 4 * 86_400_000, None if i % 19 == 0 else float("nan") if i % 23 == 0 else i * 37 % 11 / 7, 101 + i * 53 % 17 / 3) for i in range(160)]
    pos = spark.createDataFrame(rows, "bus_id string, route string, time_ms long, lat double, lon double")
    found = crossday.cross_day_model(pos)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    kept = pos.filter("lat is not null").withColumn("slot", F.expr("CAST((time_ms + 28800000) % 86400000 div 1800000 AS INT)"))
    known, want = "route is not null and route not in ('', 'Unknown')", []
    for tier, keys, among in ((1, ["bus_id", "route", "slot"], known), (2, ["route", "slot"], known), (3, ["bus_id", "slot"], "true")):
        told = kept.filter(among).groupBy(*keys).agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.count("*").alias("n")).collect()
        want += [(tier, *[r[k] if k in keys else None for k in ("bus_id", "route", "slot")], r.lat, r.lon, r.n) for r in told]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert crossday.cross_day_model(pos.filter("false")).count() == 0


def test_a_shape_is_kept_over_batches(spark, small_batches):
    import random

    from transitloom.operators.shapes import with_sticky

    dealt, rows = random.Random(3), []
    for i in range(400):
        near = [(dealt.choice([0.0, 20.0, 30.0, 45.0, 90.0]), s, float(i)) for s in dealt.sample("PQRS", dealt.choice([0, 1, 2, 3]))]
        rows.append((i // 130 if i % 3 else None, "AB"[i // 65 % 2] if i < 330 else None, i, None if i % 29 == 0 else near))
    table = spark.createDataFrame(rows, "day long, bus_id string, t long, near array<struct<perp:double,shape_id:string,cum:double>>")
    got = {r.t: (r.snap_shape_id, r.snap_cumdist) for r in with_sticky(table, ["bus_id", "day"], ["t"]).collect()}
    want, last = {}, {}
    for day, bus, t, near in rows:
        options = sorted(near or [])
        pick = None
        if options:
            held = next((o for o in options if o[1] == last.get((bus, day))), None)
            pick = held if held and held[0] <= options[0][0] + 30 else options[0]
            last[bus, day] = pick[1]
        want[t] = (pick[1], pick[2]) if pick else (None, None)
    assert got == want
    assert with_sticky(table.filter("size(near) = 0"), ["bus_id", "day"], ["t"]).filter("snap_shape_id is not null").count() == 0


def test_cells_of_a_bus_over_all_routes_are_for_buses_without_one(spark, tmp_path, monkeypatch):
    from transitloom.operators import maintenance
    from transitloom.plans import fixtures as fx

    kept, used = maintenance.augmented, []
    monkeypatch.setattr(maintenance, "augmented", lambda rows, model, *rest: used.extend(model.select("tier", "bus_id").distinct().collect()) or kept(rows, model, *rest))
    first = 1_704_067_200_000
    rows = [(bus, route, first + k * 3_600_000, 3.06, 101.61) for k, (bus, route) in enumerate([("A", "R1"), ("B", "R1"), ("B", ""), ("C", None), ("D", "Unknown")])]
    source = spark.createDataFrame(rows, "bus_id string, route string, time_ms long, lat double, lon double")
    report = maintenance.run_maintenance(source, fx.shapes(spark), str(tmp_path / "store"), first // 86_400_000 + 9).first()
    assert {tuple(r) for r in used} == {(1, "A"), (1, "B"), (2, None), (3, "B"), (3, "C"), (3, "D")}
    assert (report.bus_cells, report.rows_converted) == (5, 5)


def test_riders_and_learners_come_from_one_parse(spark, tmp_path_factory):
    from transitloom.plans import fixtures as fx

    folder = _events(spark, tmp_path_factory, [(e, e % 47, 20.0, e % 50) for e in range(400)])
    both = fx.pos_both(spark, folder)
    assert both._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = fx.pos_sparse(spark, folder).selectExpr("event_id * 2 AS event_id", "bus_id", "route", "time_ms", "lat", "lon")
    learners = fx.pos_learn(spark, folder).selectExpr("event_id * 2 + 1 AS event_id", "'L' || bus_id AS bus_id", "route", "time_ms", "lat", "lon")
    want = rows.unionByName(learners)
    assert both.dtypes == want.dtypes
    assert sorted(map(str, both.collect())) == sorted(map(str, want.collect()))


def test_a_maintenance_writes_no_table_twice_and_bounds_batches_by_rows(spark, tmp_path, monkeypatch):
    from transitloom.operators import maintenance
    from transitloom.plans import fixtures as fx
    from transitloom.runtime import NO_BOUND, batches_by_rows

    size, rows_of = (f"spark.sql.execution.arrow.max{c}PerBatch" for c in ("Bytes", "Records"))
    before, rows_before, wrote = spark.conf.get(size), spark.conf.get(rows_of), {}

    def noted(kept):
        return lambda df, name: wrote.setdefault(name, spark.conf.get(size)) and kept(df, name)

    for module in (maintenance, maintenance.crossday):
        monkeypatch.setattr(module, "written", noted(module.written))
    first = 1_704_067_200_000
    rows = [(f"B{e % 5}", "R1" if e % 5 else "Unknown", first + e * 3_600_000, 3.06 + e % 7 * 0.0016, 101.61 + e % 7 * 0.0012) for e in range(72)]
    source = spark.createDataFrame(rows, "bus_id string, route string, time_ms long, lat double, lon double")
    store = maintenance.Store(spark, str(tmp_path / "store"))
    # an observation of an earlier run, of another day
    spark.createDataFrame([("B0", 1, 1.0, 1.0, 1)], maintenance._OBSERVED).write.parquet(f"{store.folder}/observations")
    report = maintenance.run_maintenance(source, fx.shapes(spark), store.folder, first // 86_400_000 + 9).first()
    assert (report.observations_written, report.rows_converted, store.read("observations", maintenance._OBSERVED).count()) == (15, 72, 16)
    assert not {"observations", "shaped", "cross-day-model"} & set(wrote)
    assert wrote["model"] == str(NO_BOUND) and wrote["past"] == spark.conf.get(size) == before
    try:
        spark.conf.set(rows_of, "0")
        with batches_by_rows(spark):
            assert spark.conf.get(size) == before
    finally:
        spark.conf.set(rows_of, rows_before)
