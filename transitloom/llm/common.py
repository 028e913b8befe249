"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, if_small, shared_dir, written  # noqa: F401

#: Rows of a key beyond which a join deals them over several tasks.
HOT = 512

#: Bytes of texts in one batch for a Python worker.
BATCH_BYTES = 8 << 20


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hot_keys(counted: DataFrame, key: str, size: str) -> DataFrame:
    """(key, pieces) of the keys of more than HOT rows: at most one for HOT rows."""
    return counted.filter(F.col(size) > HOT).select(key, F.ceil(F.col(size) / HOT).cast("int").alias("pieces"))


def join_pieces(rows: DataFrame, info: DataFrame, key: str, hot: DataFrame, salt_by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to a table of one row for each key, with the rows of hot keys dealt over their pieces.

    The piece is a hash of the columns salt_by, so a task that runs again deals alike; ``info``
    has a copy of a hot key's row for each piece. ``hot`` has to be a written table.
    """
    if hot.isEmpty():
        return rows.join(info, key, how)
    few = if_small(hot, 32)
    piece = F.pmod(F.xxhash64(*salt_by), F.coalesce("pieces", F.lit(1))).cast("int")
    dealt = rows.join(few, key, "left").withColumn("piece", piece).drop("pieces")
    copies = info.join(few, key, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    return dealt.join(copies, [key, "piece"], how).drop("piece")


def join_dealt(rows: DataFrame, info: DataFrame, key: str, size: str, row_bytes: int, salt_by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to a written table of one row for each key: broadcast if its counted rows fit the bound, else by pieces.

    ``size`` is the column of ``info`` that tells how many rows a key has.
    """
    if info.count() * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(info), key, how)
    return join_pieces(rows, info, key, hot_keys(info, key, size), salt_by, how)


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the batches of texts that go to Python workers small, whatever the texts' lengths."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = spark.conf.get(key, None)
    if set_to is None or not set_to.rstrip("b").isdigit() or not 0 < int(set_to.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Returns a worker's freed memory to the system at a task's end, since workers outlive a stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
