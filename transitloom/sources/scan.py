"""Days of an archive from their best source that can be read: list, probe, pick, scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import written
from . import history
from .folders import Files

#: Names of day files. (Fixed values.)
_DAY = r"(\d{4}-\d{2}-\d{2})\.(parquet|jsonl)(?:/[^/]*)?$"
_PROBE = "bus_id string"

#: Bytes of a Parquet file without rows at most.
EMPTY_BYTES = 1 << 16


def _there(spark: SparkSession, folders: dict[str, str]) -> dict[str, str]:
    return {kind: folder for kind, folder in folders.items() if Files(spark, folder).exists(folder)}


def list_files(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(day, source, path, size_bytes, mtime_ms) of every day file below the folders; a day is a file or a folder of parts.

    ``folders`` has the archive's own ``data`` and may have ``history``, the one of another
    program. Spark lists them; contents are not read. A folder that is not there has no days.
    """
    made = spark.createDataFrame([], "name string, source string, path string, size_bytes long, mtime_ms long")
    for kind, folder in _there(spark, folders).items():
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        local = F.when(F.regexp_extract("path", _DAY, 2) == "jsonl", "jsonl").otherwise("local_parquet")
        source = local if kind == "data" else F.lit("history_parquet")
        rows = found.select(F.regexp_extract("path", _DAY, 1).alias("name"), source.alias("source"), "path", F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms"))
        if kind != "data":  # of the other program's files the Parquet days alone count
            rows = rows.filter(F.regexp_extract("path", _DAY, 2) == "parquet")
        home = re.escape(folder.rstrip("/").rsplit("/", 1)[-1])
        made = made.union(rows.filter(F.col("path").rlike(f"/{home}/{_DAY}")))  # days lie in the folder itself
    day = F.unix_date(F.expr("try_cast(name AS DATE)"))
    return made.withColumn("day", day).filter(F.col("day").isNotNull()).select("day", "source", "path", "size_bytes", "mtime_ms")


def _tail(path: Column) -> Column:
    """What tells a day's file whatever the scheme's spelling: its name and the part's."""
    return F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2}\.(?:parquet|jsonl)(?:/[^/]*)?)$", 1)


def probe(spark: SparkSession, files: DataFrame, folders: dict[str, str], deep: bool = True) -> DataFrame:
    """The files with ``rows`` that each holds and ``readable``, whatever state they are in.

    Parquet files are counted twice in one pass over their footers and, with ``deep``, the
    pages of one column: a torn file has no footer, and one that is damaged behind a sound
    footer gives fewer rows than that promises. This is the one place where Spark is told to
    go on past what it cannot read, since its task is to find that. JSON-lines files are
    readable by nature, their torn lines are told apart when they are scanned.
    """
    counts = spark.createDataFrame([], "own boolean, tail string, promised long, rows long")
    bare = spark.createDataFrame([], "own boolean, tail string, ended boolean")
    decoded = F.col("bus_id").isNull() | (F.length("bus_id") >= 0)  # the pages are read for this
    for kind, folder in _there(spark, folders).items():
        # the option is the reader's alone; a scan of the days never has it
        read = spark.read.schema(_PROBE).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
        told = read.select(F.col("_metadata.file_path").alias("file"), *([F.col("bus_id")] if deep else []))
        whole = told.groupBy("file").agg((F.count_if(decoded) if deep else F.count("*")).alias("rows"))
        footers = read.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("promised"))
        one = footers.join(whole, "file", "left").select(F.lit(kind == "data").alias("own"), _tail(F.col("file")).alias("tail"), "promised", F.coalesce("rows", F.lit(0)).alias("rows"))
        counts = counts.union(one)
        small = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).filter(F.col("length") <= EMPTY_BYTES)
        ended = F.expr("substring(content, 1, 4) = substring(content, -4, 4) AND CAST(substring(content, 1, 4) AS STRING) = 'PAR1' AND length > 8")
        bare = bare.union(small.select(F.lit(kind == "data").alias("own"), _tail(F.col("path")).alias("tail"), ended.alias("ended")))
    known = files.withColumn("own", F.col("source") != "history_parquet").withColumn("tail", _tail(F.col("path")))
    found = known.join(counts, ["own", "tail"], "left").join(bare, ["own", "tail"], "left")
    json = F.col("source") == "jsonl"
    sound = F.coalesce(F.col("rows") == F.col("promised"), F.col("ended"), F.lit(False))
    return found.select("day", "source", "path", "size_bytes", "mtime_ms", F.when(~json, F.coalesce("rows", F.lit(0))).alias("rows"), (json | sound).alias("readable"))


def probed_days(files: DataFrame) -> DataFrame:
    """(day, source, files, size_bytes, mtime_ms, rows, bad_files, readable): a day's source is readable if all its files are."""
    bad = F.count_if(~F.col("readable"))
    return files.groupBy("day", "source").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"), F.max("mtime_ms").alias("mtime_ms"), F.sum("rows").alias("rows"), bad.alias("bad_files"), (bad == 0).alias("readable"))


def archive_catalog(days: DataFrame) -> DataFrame:
    """(day, source, size_bytes, mtime_ms, files, rows, passed_over, bad_files): each day's best readable source, newest first.

    ``passed_over`` counts the better sources that could not be read and ``bad_files`` their
    damaged files. Days of which nothing can be read are kept with a null source.
    """
    best = history.day_catalog(days).withColumnRenamed("source", "best").select("day", "best")
    rank = history.source_rank(F.col("source"))
    at = F.col("source") == F.col("best")
    joined = days.join(best, "day", "left")
    own = lambda c: F.max(F.when(at, F.col(c))).alias(c)
    over = ~F.col("readable") & (F.col("best").isNull() | (rank < history.source_rank(F.col("best"))))
    made = joined.groupBy("day").agg(F.max("best").alias("source"), *[own(c) for c in ("size_bytes", "mtime_ms", "files", "rows")], F.count_if(over).alias("passed_over"), F.coalesce(F.sum(F.when(over, F.col("bad_files"))), F.lit(0)).alias("bad_files"))
    return made.orderBy(F.desc("day"))


class Archive:
    """An archive's catalogue, probed once, and scans of its days.

    ``folders`` is {"data": ..., "history": ...}, the latter as wanted. A day that changes
    after the probe may fail the scan, but no row of it is lost without an error.
    """

    def __init__(self, spark: SparkSession, folders: dict[str, str], deep: bool = True) -> None:
        self.spark = spark
        self._files = written(probe(spark, list_files(spark, folders), folders, deep), "archive-files")
        self.catalog = written(archive_catalog(probed_days(self._files)), "archive-catalog")

    def scan(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Rows of the days from first to last, all by default, each from its best source, with ``day`` and ``source``.

        Days are file paths, so a range reads no others; both kinds of file are one DataFrame
        of the columns of ``history.POSITION``. An archive without such days gives no rows.
        """
        wanted = self.catalog.filter(F.col("source").isNotNull())
        wanted = wanted.filter(F.col("day") >= first) if first is not None else wanted
        wanted = wanted.filter(F.col("day") <= last) if last is not None else wanted
        paths = self._files.join(wanted.select("day", "source"), ["day", "source"], "left_semi")
        # a day that is a folder is named once: as many names as the calendar has days
        top = F.regexp_extract("path", r"^(.*\d{4}-\d{2}-\d{2}\.(?:parquet|jsonl))", 1)
        by_source: dict[str, list[str]] = {}
        for r in paths.select("source", top.alias("top")).distinct().orderBy("top").collect():
            by_source.setdefault(r.source, []).append(r.top)
        made = history.empty_positions(self.spark).withColumns({"day": F.lit(0), "source": F.lit("")}).filter("false")
        for source, names in by_source.items():
            rows = history.read_ticks_json(self.spark, names, keep_path=True) if source == "jsonl" else history.read_history(self.spark, names, keep_path=True)
            rows = history.normalize(rows) if source == "jsonl" else rows
            day = F.unix_date(F.regexp_extract("path", _DAY, 1).cast("date"))
            made = made.unionByName(rows.withColumn("day", day).withColumn("source", F.lit(source)).drop("path"))
        return made
