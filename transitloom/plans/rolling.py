"""Queries of models from stored day partials: all days but the newest enter first, then the newest alone (A3, A4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.timeparts import day_number
from ..operators.rolling import RollingDays
from ..runtime import shared_dir
from .base import ORACLES, query, r6
from .scalars import modes


def _rolled(spark, sf_dir, kind: str) -> RollingDays:
    held = RollingDays(spark, f"{shared_dir(spark)}/rolling-{uuid.uuid4().hex}", (kind,))
    rows = modes(spark, sf_dir).withColumn("_day", day_number(F.col("time_ms")))
    newest = rows.agg(F.max("_day")).first()[0] or 0
    held.enter(rows.filter(F.col("_day") < newest))
    held.enter(rows.filter(F.col("_day") == newest))
    return held


@query("a3_rolling_anchors", ORACLES["a3_pooled_anchors"])
def a3_rolling(spark, sf_dir):
    return _rolled(spark, sf_dir, "speeds").anchors().select("mode", r6("anchor"), "n")


@query("a4_rolling_model", ORACLES["a4_cross_day_model"])
def a4_rolling(spark, sf_dir):
    return _rolled(spark, sf_dir, "places").model().select("tier", "bus_id", "route", "slot", r6("lat"), r6("lon"), "n")
