"""Exact medians and ranks without a sort of a whole key: counts by range tell where each range begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import if_small, written

#: Milliseconds of a range of times that is ranked as one.
RANGE_MS = 3_600_000


def exact_median(rows: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(keys, median, n) of rows (keys, value, n): the median of n copies of each value, exactly.

    Counts by range of ``width`` tell in which range a key's middle lies, and only the values
    of that range are ranked: a key with most of all rows is many ranges and never one sort.
    Nulls among the keys are keys of their own; rows without a value do not count.
    """
    counted = rows.filter(F.col("value").isNotNull() & (F.col("n") > 0)).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("part", F.floor(F.col("value") / width))
    own = Window.partitionBy(*keys)
    ranges = counted.groupBy(*keys, "part").agg(F.sum("n").alias("size"))
    ranges = ranges.withColumn("upto", F.sum("size").over(own.orderBy("part"))).withColumn("all", F.sum("size").over(own))
    first, second = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("size") <= rank)
    middle = ranges.filter(holds(first) | holds(second)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"), (F.col("upto") - F.col("size")).alias("before"), "all")
    same: Column = F.col("part") == F.col("_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    near = counted.join(middle, same).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("value")))
    at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("value")))
    found = near.groupBy(*keys).agg(at(first).alias("a"), at(second).alias("b"), F.max("all").alias("n"))
    return found.select(*keys, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(0.5 * F.col("a") + 0.5 * F.col("b")).alias("median"), "n")


def ranked(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("time_ms", "event_id"), width: int = RANGE_MS) -> DataFrame:
    """Rows with ``_i``, their place in their key from 0, and ``_len``, the key's rows.

    Counts by key and range of the first order column give each range its first place, and
    rows are numbered within their range: a key with most of all rows is ranked in pieces.
    """
    part = F.floor(F.col(order[0]) / width)
    own = Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_size"))
    upto = F.sum("_size").over(own.orderBy("_part"))
    starts = counts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"), (upto - F.col("_size")).alias("_before"), F.sum("_size").over(own).alias("_len"))
    starts = written(starts, "range-starts")
    same: Column = F.col("_part").eqNullSafe(F.col("_of_part"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    placed = rows.withColumn("_part", part).join(if_small(starts, 64), same)
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return placed.withColumn("_i", F.col("_before") + inside).drop("_part", "_of_part", "_before", *[f"_of_{k}" for k in keys])
