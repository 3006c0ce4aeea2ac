"""Tables that streams keep in the shared folder: parts with versions, and logs with snapshots.

Both are written by a batch under its own number and read up to the last committed number, so a batch that is repeated
replaces what its first attempt left, and a reader never sees half a batch. What no batch can need again is removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Folder:
    """Names and removal of what lies below a path, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, *below: str) -> list[str]:
        at = self._make("/".join([self.path, *below]))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def remove(self, *below: str) -> None:
        self._fs.delete(self._make("/".join([self.path, *below])), True)

    def mark(self, *below: str) -> None:
        self._fs.create(self._make("/".join([self.path, *below])), True).close()


def numbers(names: Iterable[str], label: str) -> list[int]:
    return sorted(int(m.group(1)) for n in names if (m := re.fullmatch(rf"{label}=(-?\d+)", n)))


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


class Commits:
    """Numbers of batches that are whole, as empty files; only the newest counts, older ones are removed."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def last(self) -> int | None:
        found = numbers(self.folder.names("_committed"), "batch")
        return found[-1] if found else None

    def add(self, batch: int) -> None:
        self.folder.mark("_committed", f"batch={batch}")
        for old in numbers(self.folder.names("_committed"), "batch"):
            if old < batch:
                self.folder.remove("_committed", f"batch={old}")


class VersionedParts:
    """A table in parts; a batch reads and writes only the parts that its rows fall into.

    `base/part=<p>/version=<n>` holds all rows of part p after batch n. A batch takes the newest version before its own number,
    so its cost follows the parts it touches, not the batches before it. A part keeps its two newest versions.
    """

    def __init__(self, spark: SparkSession, base: str, schema: StructType, part: Column):
        self.spark, self.base, self.schema, self.part = spark, base, schema, part
        self.folder = Folder(spark, base)
        self.commits = Commits(self.folder)

    def parts_of(self, df: DataFrame) -> list[str]:
        """The parts that rows fall into: at most as many as the table has, however many rows."""
        return [r.part for r in df.select(self.part.cast("string").alias("part")).distinct().collect()]

    def all_parts(self) -> list[str]:
        return [n.removeprefix("part=") for n in self.folder.names() if n.startswith("part=")]

    def read(self, parts: Iterable[str] | None = None, before: int | None = None) -> DataFrame:
        """The rows of the parts (all of them by default) before batch `before`, or after the last whole batch."""
        if before is None:
            last = self.commits.last()
            before = last + 1 if last is not None else 0
        paths = []
        for part in self.all_parts() if parts is None else parts:
            older = [v for v in numbers(self.folder.names(f"part={part}"), "version") if v < before]
            paths += [f"{self.base}/part={part}/version={older[-1]}"] if older else []
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else empty(self.spark, self.schema)

    def write(self, rows: DataFrame, batch: int) -> None:
        """`rows` as the new version of the parts they fall into."""
        named = rows.select(*self.schema.names).withColumns({"part": self.part.cast("string"), "version": F.lit(batch)})
        named.write.partitionBy("part", "version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.base)

    def commit(self, parts: Iterable[str], batch: int) -> None:
        """Batch `batch` is whole. Versions that neither a repeat of it nor a reader needs are removed."""
        self.commits.add(batch)
        for part in parts:
            for old in numbers(self.folder.names(f"part={part}"), "version")[:-2]:
                self.folder.remove(f"part={part}", f"version={old}")


class MergedLog:
    """A log of batches that is merged from time to time: `base/batch=<n>` and `base/snapshot=<n>` (all batches up to n).

    `merge` turns the rows of a snapshot and later batches into one snapshot; every `every` batches a batch that is whole does
    so. A reader takes the newest whole snapshot and the batches after it, at most `every` + 1 folders.
    """

    def __init__(self, spark: SparkSession, base: str, schema: StructType, merge, every: int = 10):
        self.spark, self.base, self.schema, self.merge, self.every = spark, base, schema, merge, every
        self.folder = Folder(spark, base)
        self.commits = Commits(self.folder)

    def snapshots(self) -> list[int]:
        """Whole ones: Spark's committer writes `_SUCCESS` last."""
        return [n for n in numbers(self.folder.names(), "snapshot") if "_SUCCESS" in self.folder.names(f"snapshot={n}")]

    def paths(self, upto: int) -> list[str]:
        whole = [n for n in self.snapshots() if n <= upto]
        start = whole[-1] if whole else -1
        later = [n for n in numbers(self.folder.names(), "batch") if start < n <= upto]
        return [*([f"{self.base}/snapshot={start}"] if whole else []), *(f"{self.base}/batch={n}" for n in later)]

    def read(self, upto: int | None = None) -> DataFrame:
        upto = self.commits.last() if upto is None else upto
        paths = self.paths(upto) if upto is not None else []
        return self.merge(self.spark.read.schema(self.schema).parquet(*paths) if paths else empty(self.spark, self.schema))

    def append(self, rows: DataFrame, batch: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.base}/batch={batch}")
        if len(self.paths(batch)) > self.every:
            self.read(batch).write.mode("overwrite").parquet(f"{self.base}/snapshot={batch}")
        self.commits.add(batch)
        whole = self.snapshots()
        # The snapshot before the newest, and what came after it, stay for readers that have begun.
        kept = whole[-2] if len(whole) > 1 else -1
        for n in numbers(self.folder.names(), "batch"):
            if n <= kept:
                self.folder.remove(f"batch={n}")
        for n in numbers(self.folder.names(), "snapshot"):
            if n < kept:
                self.folder.remove(f"snapshot={n}")
