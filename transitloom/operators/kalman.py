"""Constant-velocity Kalman speed of each bus, as a sorted scan (K1).

Both axes share transition, process noise and measurement noise, so the covariance is the
same 2 x 2 block for each: a state is x, y, vx, vy, p11, p12, p22 and the number of starting
updates. Rows of a bus arrive sorted and the state is carried over Arrow batches; memory is
one batch however long a history is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import local_x, local_y

#: Fixed values of the filter.
MAX_MS, GATE_M, MAX_DT, GAP_DT = 150 / 3.6, 500.0, 120.0, 90.0
WILD_KMH, WILD_TRACE, FIRST_VARIANCE, NOISE = 200.0, 1000.0, 10.0, 25.0
Q_HIGH, Q_LOW, Q_STEP_KMH, FAR_SIGMA, FAR_GAIN, STARTS = 2.0, 0.5, 20.0, 3.0, 0.3, 2

State = tuple[float, float, float, float, float, float, float, int]


def kalman_step(state: State | None, x: float, y: float, measured: float, dt: float) -> tuple[State | None, float]:
    """The next state and the filtered speed in km/h.

    The operations and their order are those of the SQL twin, to the last bit: a clamped speed is
    150 km/h, and speeds of one decimal lie just on the limits that it is compared with.
    """
    fresh = (FIRST_VARIANCE, 0.0, FIRST_VARIANCE)
    if state is None:
        return (x, y, 0.0, 0.0, *fresh, 0), measured
    sx, sy, vx, vy, p11, p12, p22, starts = state
    dt = min(dt, MAX_DT) if dt > 0 else 1.0
    if dt > GAP_DT:
        return (sx, sy, 0.0, 0.0, *fresh, starts), measured
    if starts < STARTS:
        vx, vy = _clamped((x - sx) / dt, (y - sy) / dt)
        starts += 1
    q = Q_HIGH if abs(measured - _size(vx, vy) * 3.6) > Q_STEP_KMH else Q_LOW
    sx, sy = sx + vx * dt, sy + vy * dt
    p11, p12, p22 = p11 + 2 * dt * p12 + dt * dt * p22 + q * dt * dt * dt * dt / 4, p12 + dt * p22 + q * dt * dt * dt / 2, p22 + q * dt * dt
    dx, dy = x - sx, y - sy
    if _size(dx, dy) > GATE_M:
        return (sx, sy, vx, vy, p11, p12, p22, starts), _size(vx, vy) * 3.6
    spread = p11 + NOISE
    damp = FAR_GAIN if math.sqrt((dx * dx + dy * dy) / spread) > FAR_SIGMA else 1.0
    k1, k2 = damp * p11 / spread, damp * p12 / spread
    sx, sy = sx + k1 * dx, sy + k1 * dy
    vx, vy = _clamped(vx + k2 * dx, vy + k2 * dy)
    p11, p12, p22 = (1 - k1) * p11, (1 - k1) * p12, p22 - k2 * p12
    speed = _size(vx, vy) * 3.6
    if speed > WILD_KMH or 2 * (p11 + p22) > WILD_TRACE:
        return None, measured
    return (sx, sy, vx, vy, p11, p12, p22, starts), speed


def _size(x: float, y: float) -> float:
    return math.sqrt(x * x + y * y)


def _clamped(vx: float, vy: float) -> tuple[float, float]:
    share = min(1.0, MAX_MS / max(_size(vx, vy), 1e-12))
    return vx * share, vy * share


def kalman_speed(rows: DataFrame) -> DataFrame:
    """(bus_id, tick_id, event_id, speed_kalman) of rows with dt_s from with_previous_tick; without a previous tick dt is 1.

    Rows without a position or a speed get null and leave the state alone.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bus, state = None, None
        for batch in batches:
            out = []
            for own, x, y, speed, dt in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6)), strict=True):
                if own != bus:
                    bus, state = own, None
                if x is None or y is None or speed is None:
                    out.append(None)
                    continue
                state, filtered = kalman_step(state, x, y, speed, 1.0 if dt is None else dt)
                out.append(filtered)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.float64())], ["bus_id", "tick_id", "event_id", "speed_kalman"])

    tracks = rows.select("bus_id", F.col("tick_id").cast("long").alias("tick_id"), F.col("event_id").cast("long").alias("event_id"), local_x(F.col("lon")).alias("x"), local_y(F.col("lat")).alias("y"), "speed", "dt_s")
    return tracks.repartition("bus_id").sortWithinPartitions("bus_id", "tick_id", "event_id").mapInArrow(scan, "bus_id string, tick_id long, event_id long, speed_kalman double")
