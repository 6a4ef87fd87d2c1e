"""Tables in versions: each in a folder of its own, and one pointer that is switched last."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class WriteConflict(RuntimeError):
    """Another writer switched the pointer since the version that was read."""


class SnapshotTable:
    """A Parquet table at ``path`` whose readers see one whole version, the old or the new one.

    ``pointers`` has a small file per version, named by its number, that holds the version's folder. A version counts
    from the moment its pointer is complete; what a lost job left behind has none and is never read. A pointer is made
    only if there is none of its number, so of two writers that began at the same version one is refused: this takes a
    file system that can do so, as HDFS and local disks can. Versions stay until ``forget`` is called.
    A writer lost in the middle of its pointer leaves one without end: it is never read, but blocks its number until ``release``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def versions(self) -> dict[int, str]:
        """Number and folder of each version, oldest first."""
        fs, pattern = self._fs("pointers/[0-9]*")
        if not fs.globStatus(pattern):
            return {}
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/pointers").selectExpr(
            "CAST(_metadata.file_name AS INT) AS number", "value").collect()
        # A pointer ends in a semicolon; one without it is still being written.
        return {r.number: r.value[:-1] for r in sorted(rows) if r.value and r.value.endswith(";")}

    def current(self) -> int:
        """Number of the latest version, 0 where there is none."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the latest."""
        known = self.versions()
        number = max(known, default=0) if version is None else version
        if number not in known:
            raise LookupError(f"{self.path} has no version {number}")
        return self.spark.read.parquet(f"{self.path}/{known[number]}")

    def replace(self, df: DataFrame, after: int | None = None) -> int:
        """Writes ``df`` as the version after ``after`` (by default the latest) and gives its number.

        ``df`` may read the table itself. Name the version that ``df`` was made from, so that a version written in the
        meantime is not lost.
        """
        number = (self.current() if after is None else after) + 1
        folder = f"version-{number}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        self._switch(number, folder)
        return number

    def _switch(self, number: int, folder: str) -> None:
        fs, pointer = self._fs(f"pointers/{number}")
        try:
            out = fs.create(pointer, False)
        except Py4JJavaError as error:
            if fs.exists(pointer):
                raise WriteConflict(f"version {number} of {self.path} was written by another job") from error
            raise
        out.write(bytearray(f"{folder};", "utf-8"))
        out.close()

    def change(self, step, tries: int = 3) -> int:
        """Replaces the table by ``step`` of its latest rows; begins anew when another writer was faster."""
        for left in reversed(range(tries)):
            number = self.current()
            try:
                return self.replace(step(self.read(number)), after=number)
            except WriteConflict:
                if not left:
                    raise
        raise ValueError("tries must be at least 1")

    def release(self) -> None:
        """Deletes pointers without end; to be called when no writer is at work."""
        fs, pattern = self._fs("pointers/[0-9]*")
        known = self.versions()
        for status in fs.globStatus(pattern) or []:
            if int(status.getPath().getName()) not in known:
                fs.delete(status.getPath(), False)

    def forget(self, keep: int = 2) -> None:
        """Deletes the rows of all but the latest ``keep`` versions; jobs that still read those fail."""
        if keep < 1:
            raise ValueError("the latest version stays")
        known = self.versions()
        for number in list(known)[:-keep]:
            for name in (f"pointers/{number}", known[number]):
                fs, place = self._fs(name)
                fs.delete(place, True)
