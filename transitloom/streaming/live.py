"""Structured Streaming over the same functions (K2, K10, K11, S6); live views are in keyed.py."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import local_x, local_y
from ..operators.kalman import kalman_step
from ..sources.history import with_ingest_date

_FLOATS = ["x", "y", "vx", "vy", "p11", "p12", "p22"]
_STATE = "x double, y double, vx double, vy double, p11 double, p12 double, p22 double, starts int, live boolean, tick long, time_ms long"


class _Track:
    """A bus's filter, row by row in tick order: its state, and the last row with that of the tick before it."""

    def __init__(self, saved: tuple | None = None) -> None:
        *kept, starts, live, tick, time_ms = saved or (*[0.0] * 7, 0, False, None, None)
        self.own = (*kept, starts) if live else None
        self.before = self.current = (tick, time_ms)

    def step(self, tick: int, time_ms: int, x: float | None, y: float | None, speed: float | None) -> float | None:
        if tick != self.current[0]:
            self.before = self.current
        near = self.before[0] is not None and tick - self.before[0] == 1
        out = None
        if not (pd.isna(x) or pd.isna(y) or pd.isna(speed)):
            self.own, out = kalman_step(self.own, x, y, speed, (time_ms - self.before[1]) / 1000 if near else 1.0)
        self.current = (tick, time_ms)
        return out

    def saved(self) -> tuple:
        return (*(self.own or (*[0.0] * 7, 0)), self.own is not None, int(self.current[0]), int(self.current[1]))


def _advance(saved: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list]:
    """A bus's state after its rows, which are in tick order, and the speed of each."""
    track = _Track(saved)
    out = [track.step(r.tick_id, r.time_ms, r.x, r.y, r.speed) for r in rows.itertuples(index=False)]
    return track.saved(), out


def _tracks(ticks: DataFrame) -> DataFrame:
    whole = lambda c: F.col(c).cast("long").alias(c)
    return ticks.select("bus_id", whole("tick_id"), whole("event_id"), whole("time_ms"), local_x(F.col("lon")).alias("x"), local_y(F.col("lat")).alias("y"), "speed")


_ORDER = ["tick_id", "event_id"]


class _Filter(StatefulProcessor):
    """K1's filter with the state of each bus in the store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("track", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values(_ORDER)
        saved, out = _advance(self.saved.get() if self.saved.exists() else None, frame)
        self.saved.update(saved)
        yield pd.DataFrame({"bus_id": key[0], "tick_id": frame.tick_id, "event_id": frame.event_id, "speed_kalman": pd.Series(out, index=frame.index, dtype="float64")})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        row = initialState.iloc[0]
        self.saved.update((*[float(row[c]) for c in _FLOATS], int(row.starts), bool(row.live), int(row.tick), int(row.time_ms)))

    def close(self) -> None:
        pass


def kalman_state(rows: DataFrame) -> DataFrame:
    """(bus_id and the filter's state) after rows that are already stored, one row a bus: what a new session starts from.

    Sorted rows are scanned with the state carried over batches: one batch of memory, however long a history is.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, track, found = None, None, []
        for batch in batches:
            for bus, *row in zip(*(batch.column(k).to_pylist() for k in ("bus_id", "tick_id", "time_ms", "x", "y", "speed")), strict=True):
                if track is None or bus != own:
                    if track is not None:
                        found.append((own, *track.saved()))
                    own, track = bus, _Track()
                track.step(*row)
            if found:
                yield _state_batch(found)
                found = []
        if track is not None:
            yield _state_batch([(own, *track.saved())])

    return _tracks(rows).repartition("bus_id").sortWithinPartitions("bus_id", *_ORDER).mapInArrow(scan, f"bus_id string, {_STATE}")


def _state_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.float64()] * 7, pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bus_id", *_FLOATS, "starts", "live", "tick", "time_ms"])


def kalman_stream(ticks: DataFrame, warm: DataFrame | None = None) -> DataFrame:
    """(bus_id, tick_id, event_id, speed_kalman) of a stream of positions: K1's filter with its state kept per bus.

    Rows of a micro-batch are taken in tick order. A step's length is the time since the bus's
    row in the tick just before, and 1 without one. The state never expires, as in the batch
    form it outlives absences and midnight. With ``warm``, a state as ``kalman_state`` gives
    it, a stream without a checkpoint goes on from there; its session keeps states in RocksDB.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(_ORDER)
        saved, out = _advance(state.get if state.exists else None, rows)
        state.update(saved)
        yield pd.DataFrame({"bus_id": key[0], "tick_id": rows.tick_id, "event_id": rows.event_id, "speed_kalman": out})

    made = "bus_id string, tick_id long, event_id long, speed_kalman double"
    buses = _tracks(ticks).groupBy("bus_id")
    if warm is None:
        return buses.applyInPandasWithState(step, made, _STATE, "append", GroupStateTimeout.NoTimeout)
    return buses.transformWithStateInPandas(_Filter(), made, "append", "none", warm.groupBy("bus_id"))


def append_ticks(ticks: DataFrame, path: str, checkpoint: str, arrival_ms: str = "arrival_ms") -> StreamingQuery:
    """Appends a stream to a table partitioned by the local date of arrival (S6); late rows are kept."""
    return with_ingest_date(ticks, arrival_ms).writeStream.format("parquet").partitionBy("ingest_date").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def without_repeats(ticks: DataFrame, event_time: str, delay: str = "10 minutes", keys: tuple[str, ...] = ("bus_id", "tick_id")) -> DataFrame:
    """Optional: one row for each key within a watermark. The faithful path drops nothing."""
    return ticks.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
