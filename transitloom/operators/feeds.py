"""Feed health: counts, outages, and the choice of a source (K7, K8)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import if_small

LEAST_VEHICLES = 10
UNREACHABLE = -1


def feed_counts(sweeps: DataFrame) -> DataFrame:
    """(sweep_id, live, empty, unreachable, vehicles)."""
    v = F.col("vehicles")
    return sweeps.groupBy("sweep_id").agg(F.count_if(v > 0).alias("live"), F.count_if(v == 0).alias("empty"), F.count_if(v == UNREACHABLE).alias("unreachable"), F.sum(F.greatest(v, F.lit(0))).alias("vehicles"))


def feed_outage(sweeps: DataFrame, sources: DataFrame) -> DataFrame:
    """(sweep_id, source_idx, outage): a collectable feed is empty while more than half of the others are live."""
    told = sweeps.join(if_small(sources.select("source_idx", "collectable"), 16), "source_idx")
    others = told.filter("not collectable").groupBy("sweep_id").agg(F.count_if(F.col("vehicles") > 0).alias("live"), F.count("*").alias("n"))
    own = told.filter("collectable").join(others, "sweep_id", "left")
    return own.select("sweep_id", "source_idx", ((F.col("vehicles") == 0) & (F.coalesce("live", F.lit(0)) > F.coalesce("n", F.lit(0)) / 2)).alias("outage"))


def next_source(active: int, preferred: int, collectable: list[int], counts: dict[int, int]) -> int:
    """The source after a sweep: stay while there are vehicles, but go home when home is busy; else the first busy sibling."""
    if counts.get(active, UNREACHABLE) > 0:
        home = active != preferred and counts.get(preferred, UNREACHABLE) >= LEAST_VEHICLES
        return preferred if home else active
    return next((s for s in collectable if s != active and counts.get(s, UNREACHABLE) >= LEAST_VEHICLES), active)


def choose_source(sweeps: DataFrame, region: str = "region", *, preferred: int = 0, collectable: tuple[int, ...] = (0, 1), pinned: bool = False) -> DataFrame:
    """(region, sweep_id, active) after each sweep: a sorted scan, as each choice hangs on the last.

    Sweeps are first folded to one row of the collectable feeds' counts; regions scan apart.
    A pinned source never changes.
    """
    counts = F.map_from_entries(F.collect_list(F.struct(F.col("source_idx").cast("int"), F.col("vehicles").cast("int"))))
    folded = sweeps.filter(F.col("source_idx").isin(list(collectable))).groupBy(region, "sweep_id").agg(counts.alias("counts"))
    every = sweeps.select(region, "sweep_id").distinct().join(folded, [region, "sweep_id"], "left")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, active = None, preferred
        for batch in batches:
            out = []
            for own, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != where:
                    where, active = own, preferred
                if not pinned:
                    active = next_source(active, preferred, list(collectable), dict(counts or ()))
                out.append(active)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], [region, "sweep_id", "active"])

    kind = sweeps.schema[region].dataType.simpleString()
    ordered = every.select(region, F.col("sweep_id").cast("long").alias("sweep_id"), "counts").repartition(region).sortWithinPartitions(region, "sweep_id")
    return ordered.mapInArrow(scan, f"{region} {kind}, sweep_id long, active int")
