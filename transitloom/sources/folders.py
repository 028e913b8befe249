"""Files of a folder through Spark's own file systems, with every change checked."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    """Hadoop's view of the file system that a folder is in; a change that did not happen raises an error."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        """The names in a folder, in order; none where it is not there."""
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(folder))) if self.exists(folder) else []

    def size(self, path: str) -> int:
        return self._files.getFileStatus(self._path(path)).getLen()

    def make(self, folder: str) -> None:
        if not self._files.mkdirs(self._path(folder)):
            raise OSError(f"{folder} could not be made")

    def rename(self, source: str, target: str) -> None:
        """One rename to a path that is free; file systems may answer false instead of raising."""
        if self.exists(target):
            raise FileExistsError(target)
        if not self._files.rename(self._path(source), self._path(target)) or not self.exists(target):
            raise OSError(f"{source} could not be renamed to {target}")

    def remove(self, path: str) -> None:
        if self.exists(path) and not self._files.delete(self._path(path), True):
            raise OSError(f"{path} could not be removed")

    def replace(self, staged: str, target: str) -> None:
        """Puts what was staged in the target's place; what stood there comes back if that fails, and goes only after it."""
        aside = f"{target}.before"
        self.remove(aside)
        if self.exists(target):
            self.rename(target, aside)
        try:
            self.rename(staged, target)
        except Exception:
            if self.exists(aside) and not self.exists(target):
                self.rename(aside, target)
            raise
        self.remove(aside)

    def read(self, path: str) -> bytes:
        """A whole file, which has to fit the driver."""
        stream = self._files.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write_new(self, path: str, lines: list[dict]) -> None:
        """A new file of JSON lines, written at once and measured; a path that is taken raises an error."""
        self.write(path, "".join(json.dumps(line) + "\n" for line in lines).encode())

    def write(self, path: str, body: bytes) -> None:
        """A new file, measured after it is closed."""
        out = self._files.create(self._path(path), False)
        try:
            out.write(bytearray(body))
        finally:
            out.close()
        if self.size(path) != len(body):
            raise OSError(f"{path} was written short")
