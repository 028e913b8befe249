"""Live views from state kept by key: a micro-batch reads its own rows and the state of what they touch.

The buses of a view are dealt to parts by a hash; a part's state is one value, its rows packed
as Arrow, so a batch calls Python and the state store once for each part and not for each bus.
Each view is a stream of changed rows with a ``version`` that grows; ``newest`` reads a sink's
current rows. A new session starts from stored rows: a batch job takes the state off them and
hands it over, without a bus's history ever being in one place. Sessions need the RocksDB
provider for states, see ``with_rocksdb``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.geo import round_half_up
from ..functions.speed import MODES, SPIKE, effective_speed, plausible, speed_bin
from ..functions.timeparts import day_number, local_hour, ms_of_day
from ..operators.heatmap import SAMPLES, fixed_edges, latest_per_cell
from ..operators.speeds import BIN_MS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"
#: Positions for each state store, at least.
STORE_ROWS = 2000
#: How late a position may be for a live view; a day's state goes once its end is so long ago.
LATE = "12 hours"
#: Points of a trail.
POINTS = 20
#: Parts that the buses of a view are dealt to; a part's rows are one value of a state.
PARTS = 256
_POINT = "time_ms long, event_id long, lat double, lon double, speed double"


@contextmanager
def with_rocksdb(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """The session keeps streamed states in RocksDB meanwhile.

    A stream has as many state stores as partitions when it first starts, each with files of
    its own; with the ``rows`` that are expected, there are no more than those give work to.
    """
    wanted = {_PROVIDER: _ROCKSDB}
    if rows is not None:
        most = int(spark.conf.get(_PARTITIONS))
        wanted[_PARTITIONS] = str(min(most, max(4, -(-rows // STORE_ROWS))))
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def day_end_ms(day: int) -> int:
    """The instant that ends a local day."""
    return (int(day) + 1) * 86_400_000 - 28_800_000


def middle(values: list[float]) -> float:
    """The median, with the mean of the two in the middle."""
    values = sorted(values)
    half = len(values) // 2
    return values[half] if len(values) % 2 else 0.5 * values[half - 1] + 0.5 * values[half]


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as one Arrow stream, the value of a state."""
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_pandas()


class _Rows(StatefulProcessor):
    """A part's rows as one value of its state, with a version that grows by one a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "held binary, version long")

    def held(self, key: tuple) -> tuple[list[pd.DataFrame], int]:
        """The rows so far, none or one frame of them, and their version; a day's first rows set the timer of its end."""
        if self.rows.exists():
            held, version = self.rows.get()
            return [_unpacked(held)], version
        if self.by_day:
            self.handle.registerTimer(day_end_ms(key[0]))
        return [], 0

    def put(self, rows: pd.DataFrame, version: int) -> None:
        self.rows.update((_packed(rows), version))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        return iter([])

    def close(self) -> None:
        pass


def _last(frames: list[pd.DataFrame], most: int) -> pd.DataFrame:
    """The last rows of each bus, in time order."""
    return pd.concat(frames, ignore_index=True).sort_values(["bus_id", "time_ms", "event_id"]).groupby("bus_id").tail(most)


class _Ring(_Rows):
    """(day, route, hour, part): the latest samples of its buses, and the median of each bus after each batch."""

    by_day = True

    def _keep(self, key: tuple, frames: list[pd.DataFrame]) -> pd.DataFrame:
        held, version = self.held(key)
        rings = _last([*held, *[f[["bus_id", "time_ms", "event_id", "v"]] for f in frames]], SAMPLES)
        self.put(rings, version + 1)
        return rings

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        medians = self._keep(key, frames).groupby("bus_id")["v"].median()
        yield pd.DataFrame({"day": [key[0]], "route": [key[1]], "hour": [key[2]], "part": [key[3]], "medians": [medians.tolist()], "at": [max(f["at"].max() for f in frames)]})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self._keep(key, [initialState])


class _Cell(StatefulProcessor):
    """(day, route, hour): the medians of each part's buses, and theirs after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part int", "medians array<double>")
        self.version = handle.getValueState("version", "n long")

    def _put(self, key: tuple, frame: pd.DataFrame) -> None:
        if not self.parts.exists():
            self.handle.registerTimer(day_end_ms(key[0]))
        for part, medians in zip(frame.part, frame.medians, strict=True):
            self.parts.updateValue((int(part),), ([float(m) for m in medians],))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self._put(key, frame)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        medians = [m for v in self.parts.values() for m in v[0]]
        yield pd.DataFrame({"day": [key[0]], "route": [key[1]], "hour": [key[2]], "raw_value": [middle(medians)], "n": [len(medians)], "version": [version]})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self._put(key, initialState)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.parts.clear()
        self.version.clear()
        return iter([])

    def close(self) -> None:
        pass


def _dealt(rows: DataFrame) -> DataFrame:
    """With the part of each row's bus."""
    return rows.withColumn("part", F.pmod(F.xxhash64("bus_id"), F.lit(PARTS)).cast("int"))


def _samples(rows: DataFrame, mode: str) -> DataFrame:
    stamp = F.timestamp_millis(F.col("time_ms").cast("long")).alias("at")
    read = rows.select(day_number(F.col("time_ms")).cast("long").alias("day"), "route", local_hour(F.col("time_ms")).cast("int").alias("hour"), "bus_id", F.col("time_ms").cast("long").alias("time_ms"), F.col("event_id").cast("long").alias("event_id"), F.col(MODES[mode]).cast("double").alias("v"), stamp)
    return read.filter(plausible(F.col("v")) & F.col("bus_id").isNotNull())


_RING, _CELL, _PART = ["day", "route", "hour", "bus_id"], ["day", "route", "hour"], ["day", "route", "hour", "part"]


def _shown(cells: DataFrame, mode: str) -> DataFrame:
    name = speed_bin(F.col("raw_value"), fixed_edges(mode, None), SPIKE[mode])
    return cells.select(*_CELL, round_half_up(F.col("raw_value"), 2).alias("value"), name.alias("bin"), F.col("n").cast("long").alias("n"), "version")


def stored_rings(rows: DataFrame, mode: str = "raw") -> DataFrame:
    """The latest samples of each bus in each cell of stored rows: what a live heatmap restarts from."""
    return latest_per_cell(_samples(rows, mode).drop("at"), _RING, ["time_ms", "event_id"])


def stored_cells(rings: DataFrame, mode: str = "raw") -> DataFrame:
    """The heatmap that a session starts with, version 0."""
    medians = rings.groupBy(*_RING).agg(F.median("v").alias("m"))
    return _shown(medians.groupBy(*_CELL).agg(F.median("m").alias("raw_value"), F.count("*").alias("n")).withColumn("version", F.lit(0).cast("long")), mode)


def live_heatmap(ticks: DataFrame, mode: str = "raw", warm: DataFrame | None = None, late: str = LATE) -> DataFrame:
    """A stream of the cells that changed: (day, route, hour, value, bin, n, version).

    A bus's latest samples of a cell are a ring in state, so a cell's value is that of
    ``speed_heatmap`` over all rows so far, whatever their order. The buses of a route are
    dealt to parts that are spread over tasks, and a route's task gets the medians of each
    part in which a bus moved. A day's states go
    when positions are ``late`` beyond its end, and what comes later still is left out. With
    ``warm``, from ``stored_rings``, the stream goes on from there.
    """
    samples = _dealt(_samples(ticks, mode)).withWatermark("at", late)
    start = medians = None
    if warm is not None:
        start = _dealt(warm).groupBy(*_PART)
        medians = _dealt(warm.groupBy(*_RING).agg(F.median("v").alias("m"))).groupBy(*_PART).agg(F.collect_list("m").alias("medians")).groupBy(*_CELL)
    parts = samples.groupBy(*_PART).transformWithStateInPandas(_Ring(), "day long, route string, hour int, part int, medians array<double>, at timestamp", "append", "eventtime", start, "at")
    cells = parts.groupBy(*_CELL).transformWithStateInPandas(_Cell(), "day long, route string, hour int, raw_value double, n long, version long", "append", "eventtime", medians)
    return _shown(cells, mode)


class _Trail(_Rows):
    """A part's last points of each bus, in time order, across absences and midnight."""

    by_day = False

    def __init__(self, points: int) -> None:
        self.points = points

    def _keep(self, key: tuple, frames: list[pd.DataFrame]) -> tuple[pd.DataFrame, int]:
        held, version = self.held(key)
        trails = _last([*held, *[f[["bus_id", "time_ms", "event_id", "lat", "lon", "speed"]] for f in frames]], self.points)
        self.put(trails, version + 1)
        return trails, version + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        trails, version = self._keep(key, frames)
        moved = pd.concat([f["bus_id"] for f in frames]).unique()
        yield trails[trails["bus_id"].isin(moved)].assign(version=version)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self._keep(key, [initialState])


def _points(rows: DataFrame) -> DataFrame:
    whole = lambda c: F.col(c).cast("long").alias(c)
    return rows.filter(F.col("bus_id").isNotNull()).select("bus_id", whole("time_ms"), whole("event_id"), *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "speed")])


def stored_trails(rows: DataFrame, points: int = POINTS) -> DataFrame:
    """The last points of each bus in stored rows, a row each: what live trails restart from."""
    latest = Window.partitionBy("bus_id").orderBy(F.desc("time_ms"), F.desc("event_id"))
    return _points(rows).withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= points).drop("_rank")


def live_trails(ticks: DataFrame, points: int = POINTS, warm: DataFrame | None = None) -> DataFrame:
    """A stream of the trails that changed, a row for each point: (bus_id, time_ms, event_id, lat, lon, speed, version)."""
    start = _dealt(warm).groupBy("part") if warm is not None else None
    return _dealt(_points(ticks)).groupBy("part").transformWithStateInPandas(_Trail(points), f"bus_id string, {_POINT}, version long", "append", "none", start)


_SUMS, _COUNTS = [f"s{k}" for k in range(len(MODES))], [f"c{k}" for k in range(len(MODES))]


class _Timeline(_Rows):
    """(day, bin, part): sums and counts of each bus and mode."""

    by_day = True

    def _add(self, key: tuple, frames: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray, int]:
        """All sums, whether each bus moved, and the version."""
        held, version = self.held(key)
        both = pd.concat([*held, *[f[["bus_id", *_SUMS, *_COUNTS, "n"]] for f in frames]], ignore_index=True)
        codes, buses = pd.factorize(both["bus_id"])
        sums, counts, moved = np.zeros((len(buses), len(_SUMS))), np.zeros((len(buses), len(_COUNTS) + 1), dtype="int64"), np.zeros(len(buses), dtype=bool)
        np.add.at(sums, codes, both[_SUMS].to_numpy())
        np.add.at(counts, codes, both[[*_COUNTS, "n"]].to_numpy())
        moved[codes[sum(map(len, held)) :]] = True
        bins = pd.DataFrame({"bus_id": buses, **dict(zip(_SUMS, sums.T, strict=True)), **dict(zip([*_COUNTS, "n"], counts.T, strict=True))})
        self.put(bins, version + 1)
        return bins, moved, version + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        bins, moved, version = self._add(key, list(rows))
        out = bins[moved]
        means = [[s / c if c else None for s, c in zip(*row, strict=True)] for row in zip(out[_SUMS].to_numpy().tolist(), out[_COUNTS].to_numpy().tolist(), strict=True)]
        yield pd.DataFrame({"bus_id": out["bus_id"].to_numpy(), "day": key[0], "bin": key[1], "means": means, "n": out["n"].to_numpy(), "version": version})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self._add(key, [initialState])


def _binned(rows: DataFrame) -> DataFrame:
    """(bus_id, day, bin, sums, counts, n) of each row alone."""
    missing = {c: F.lit(None).cast("double") for c in MODES.values() if c not in rows.columns}
    speeds = [effective_speed(m).cast("double") for m in MODES]
    bin_no = F.floor(ms_of_day(F.col("time_ms")) / F.lit(BIN_MS)).cast("int").alias("bin")
    whole = rows.withColumns(missing) if missing else rows
    array = lambda f: F.array(*[f(s) for s in speeds])
    sums, counts = array(lambda s: F.coalesce(s, F.lit(0.0))), array(lambda s: s.isNotNull().cast("long"))
    stamp = F.timestamp_millis(F.col("time_ms").cast("long")).alias("at")
    return whole.filter(F.col("bus_id").isNotNull()).select("bus_id", day_number(F.col("time_ms")).cast("long").alias("day"), bin_no, sums.alias("sums"), counts.alias("counts"), F.lit(1).cast("long").alias("n"), stamp)


def stored_bins(rows: DataFrame) -> DataFrame:
    """Sums and counts of each bus, day and bin of stored rows: what live timelines restart from."""
    each = range(len(MODES))
    of = lambda c: F.array(*[F.sum(F.col(c)[k]) for k in each]).alias(c)
    return _binned(rows).groupBy("bus_id", "day", "bin").agg(of("sums"), of("counts"), F.sum("n").alias("n"))


def _wide(bins: DataFrame) -> DataFrame:
    """Sums and counts as a column each, and the part of each bus."""
    of = lambda c, names: {name: F.col(c)[k] for k, name in enumerate(names)}
    return _dealt(bins).withColumns(of("sums", _SUMS) | of("counts", _COUNTS)).drop("sums", "counts")


def _means(rows: DataFrame, mean: Column) -> list[Column]:
    return [round_half_up(round_half_up(F.get(mean, F.lit(k)), 9), 2).alias(m) for k, m in enumerate(MODES)]


def stored_timeline(bins: DataFrame) -> DataFrame:
    """The timeline that a session starts with, version 0."""
    means = F.zip_with("sums", "counts", lambda s, c: F.try_divide(s, c))
    return bins.select("bus_id", "day", "bin", *_means(bins, means), "n", F.lit(0).cast("long").alias("version"))


def live_timeline(ticks: DataFrame, warm: DataFrame | None = None, late: str = LATE) -> DataFrame:
    """A stream of the bins that changed: (bus_id, day, bin, mode columns, n, version), as ``speed_timeline`` over all rows so far."""
    keyed = _wide(_binned(ticks)).withWatermark("at", late).groupBy("day", "bin", "part")
    start = _wide(warm).groupBy("day", "bin", "part") if warm is not None else None
    bins = keyed.transformWithStateInPandas(_Timeline(), "bus_id string, day long, bin int, means array<double>, n long, version long", "append", "eventtime", start)
    return bins.select("bus_id", "day", "bin", *_means(bins, F.col("means")), "n", "version")


def keep(view: DataFrame, path: str, checkpoint: str, by_day: bool = True) -> StreamingQuery:
    """Appends a view's changed rows to a table, each exactly once, by day where it has one."""
    out = view.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (out.partitionBy("day") if by_day else out).start()


def newest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The current rows of a view: those of each key's last version."""
    last = changes.groupBy(*keys).agg(F.max("version").alias("_last"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"c.{k}").eqNullSafe(F.col(f"l.{k}"))
    return changes.alias("c").join(last.alias("l"), same & (F.col("c.version") == F.col("l._last"))).select("c.*").drop("version")
