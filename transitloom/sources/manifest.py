"""A table of days whose readers follow a log of commits: files stay where they were written, and a day counts once a commit names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import empty
from .folders import Files

_ENTRY = "day long, path string, rows long"


class Manifest:
    """The log of a folder: each commit is a numbered file of JSON lines (day, path, rows), published by one checked rename.

    Of a day that several commits name, the last one counts. Nothing that was committed is
    ever moved or rewritten, so a commit that fails leaves readers with what they had. Entries
    are as many as the calendar has days, and come to the driver as paths do.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, self.folder)

    def new_run(self) -> str:
        """A folder for the files of a commit to come."""
        return f"{self.folder}/data/run={uuid.uuid4().hex}"

    def _commits(self) -> list[str]:
        return [n for n in self.files.names(f"{self.folder}/log") if n.endswith(".json")]

    def entries(self) -> DataFrame:
        """(day, path, rows): the newest entry of each day."""
        commits = [f"{self.folder}/log/{n}" for n in self._commits()]
        if not commits:
            return empty(self.spark, StructType.fromDDL(_ENTRY))
        read = self.spark.read.schema(_ENTRY).json(commits).withColumn("commit", F.col("_metadata.file_name"))
        newest = F.max_by(F.struct("path", "rows"), "commit").alias("newest")
        return read.groupBy("day").agg(newest).select("day", "newest.*")

    def publish(self, entries: list[dict]) -> None:
        """One commit of these entries; fails as a whole where another writer took its number or the rename did not happen."""
        if not entries:
            return
        log = f"{self.folder}/log"
        self.files.make(log)
        staged = f"{log}/.{uuid.uuid4().hex}"
        self.files.write_new(staged, entries)
        last = max((int(n.split(".")[0]) for n in self._commits()), default=0)
        try:
            self.files.rename(staged, f"{log}/{last + 1:012d}.json")
        except Exception:
            self.files.remove(staged)
            raise

    def read(self, schema: str | StructType, days: list[int] | None = None) -> DataFrame:
        """Rows of the committed days, or of those of ``days``, with their ``day``; no rows where none is."""
        named = self.entries() if days is None else self.entries().filter(F.col("day").isin(days))
        paths = [f"{self.folder}/{r.path}" for r in named.orderBy("day").collect()]
        typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        whole = StructType([*[f for f in typed.fields if f.name not in ("day", "run")]]).add("run", "string").add("day", "long")
        if not paths:
            return empty(self.spark, whole).drop("run")
        return self.spark.read.schema(whole).option("basePath", f"{self.folder}/data").parquet(*paths).drop("run")
