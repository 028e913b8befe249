"""Speed modes, classes and bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import round_half_up

#: Mode -> column.
MODES = {"raw": "speed", "corrected": "speed_corrected", "calc": "calculated_speed", "kalman": "speed_kalman", "trust": "weighted_speed"}
#: The anchor of a mode, its edges as offsets from that, and the speed above which a value is a spike.
PHYSICAL_ANCHOR = {"raw": 40.0, "corrected": 40.0, "kalman": 40.0, "trust": 40.0, "calc": 8.0}
OFFSETS = {
    "raw": (-40, -25, -15, -5, 15, 30, 50, 80),
    "corrected": (-40, -25, -15, -5, 15, 30, 50, 80),
    "kalman": (-40, -30, -22, -15, 5, 25, 50, 80),
    "trust": (-40, -30, -20, -10, 5, 20, 35, 60),
    "calc": (-2, -1.5, -1, -0.5, 1, 3, 6, 13),
}
SPIKE = {"raw": 120.0, "corrected": 120.0, "kalman": 120.0, "trust": 100.0, "calc": 80.0}
BIN_LABELS = ("very slow", "slow", "below normal", "normal", "above normal", "fast", "very fast")
STALE_S, MOVED_M = 90, 20.0


def raw_speed_kmh(metres_per_s: Column) -> Column:
    """One decimal; 0 where missing."""
    return F.coalesce(round_half_up(metres_per_s * 3.6, 1), F.lit(0.0))


def convert_speed(kmh: Column, unit: str) -> Column:
    return {"mph": kmh * 0.621371, "m/s": kmh / 3.6}.get(unit, kmh)


def effective_speed(mode: str) -> Column:
    return F.coalesce(F.col(MODES[mode]), F.col("speed"))


def age_s(now_s: Column, seen_s: Column) -> Column:
    """Seconds since a vehicle's own timestamp, 0 without one or in its future."""
    return F.coalesce(F.greatest(now_s - seen_s, F.lit(0)), F.lit(0))


def is_stale(age: Column) -> Column:
    return age > STALE_S


def is_moving(has_previous: Column, moved_m: Column, speed: Column) -> Column:
    """Without a previous tick, displaced by over 20 m, or faster than 1."""
    return ~has_previous | (F.coalesce(moved_m, F.lit(0.0)) > MOVED_M) | (F.coalesce(speed, F.lit(0.0)) > 1)


def speed_class(v: Column) -> Column:
    return F.when(v.isNull(), "none").when(v < 20, "slow").when(v < 40, "medium").otherwise("fast")


def segment_class(a: Column, b: Column) -> Column:
    """The class of the mean of both ends, of one end where the other is missing."""
    return speed_class((F.coalesce(a, b) + F.coalesce(b, a)) / 2)


def plausible(v: Column) -> Column:
    return v.between(0, 200)


def bin_edges(mode: str, anchor: Column | float | None = None) -> list[Column]:
    """The eight edges of a mode around an anchor: scaled, clipped to [0, spike], each above the last."""
    at = F.lit(PHYSICAL_ANCHOR[mode] if anchor is None else anchor).cast("double") if not isinstance(anchor, Column) else anchor
    edges: list[Column] = []
    for offset in OFFSETS[mode]:
        edge = F.greatest(F.lit(0.0), F.least(F.lit(SPIKE[mode]), at + F.lit(float(offset)) * at / PHYSICAL_ANCHOR[mode]))
        edges.append(F.when(edge <= edges[-1], edges[-1] + 1e-3).otherwise(edge) if edges else edge)
    return edges


def fixed_edges(mode: str, anchor: float | None = None) -> list[float]:
    """bin_edges of a known anchor, as numbers."""
    at = PHYSICAL_ANCHOR[mode] if anchor is None else anchor
    edges: list[float] = []
    for offset in OFFSETS[mode]:
        edge = max(0.0, min(SPIKE[mode], at + offset * (at / PHYSICAL_ANCHOR[mode])))
        edges.append(edges[-1] + 1e-3 if edges and edge <= edges[-1] else edge)
    return edges


def speed_bin(v: Column, edges: list, spike: float) -> Column:
    """stopped at 0, spike above it, a label within (low, high], otherwise null."""
    found = F.when(v == 0, "stopped").when(v > spike, "spike")
    for label, low, high in zip(BIN_LABELS, edges, edges[1:]):
        found = found.when((v > low) & (v <= high), label)
    return found


def mode_bin(mode: Column, v: Column) -> Column:
    """speed_bin at each mode's physical anchor, where the mode is a column."""
    found = F.lit(None).cast("string")
    for name in MODES:
        found = F.when(mode == name, speed_bin(v, fixed_edges(name), SPIKE[name])).otherwise(found)
    return found
