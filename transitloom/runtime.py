"""Session helpers shared by the queries, the bench and the tests."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench share."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("transitloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where the session was started outside its folder.

    Workers inherit PYTHONPATH from the context; on a cluster without a shared
    checkout the package goes along with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """A table without rows, which no Python worker is asked for."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


_BATCH_BYTES, _BATCH_ROWS = (f"spark.sql.execution.arrow.max{c}PerBatch" for c in ("Bytes", "Records"))
#: Rows of a batch up to which their number bounds it; and the bytes that Spark takes for no bound.
ROWS_ENOUGH, NO_BOUND = 10_000, 2**31 - 1


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """Batches for Python workers are bounded by their rows alone meanwhile, where the session has such a bound.

    For a bound in bytes Spark adds up the sizes of all columns at each row, which for rows of a
    dozen numbers and short strings costs more than to write them.
    """
    before = spark.conf.get(_BATCH_BYTES)
    few = 0 < int(spark.conf.get(_BATCH_ROWS)) <= ROWS_ENOUGH
    spark.conf.set(_BATCH_BYTES, str(NO_BOUND) if few else before)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


#: Bytes that a broadcast table may hold; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: that of spark.checkpoint.dir, else the context's checkpoint folder, else in local mode one in the warehouse.

    A cluster without either raises an error: its executors share no folder of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs the tasks of the stage that runs, not
    everything before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for a broadcast where its counted rows fit the bound; else left to a shuffle join.

    ``df`` should be a written table or cheap to compute, since this counts it.
    """
    return F.broadcast(df) if df.count() * row_bytes <= most else df
