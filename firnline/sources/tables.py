"""Parquet tables that are replaced as a whole, and never seen half replaced.

A version is a folder with a number; Spark marks it as done when all of it is there. The version in force is the highest
one that is done, so there is no pointer to go astray: a job that dies leaves the old version in force, and a job that
reads what it replaces can do so.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Versions that stay beside the one in force, for jobs that still read them.
KEPT = 1
_DONE = "_SUCCESS"


def _path(spark: SparkSession, path: str):
    out = spark._jvm.org.apache.hadoop.fs.Path(path)
    return out, out.getFileSystem(spark._jsc.hadoopConfiguration())


_own: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, from spark.checkpoint.dir; a local session gets its own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="firnline-"))
    return folder.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _path(spark, path)
    return system.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place, system = _path(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    place, system = _path(spark, old)
    system.rename(place, _path(spark, new)[0])


class Table:
    """A versioned table under a path, with a schema that an empty one has."""

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None):
        self.spark, self.path, self.schema = spark, path, schema

    def versions(self) -> list[str]:
        """The folders of versions that are done, oldest first."""
        place, system = _path(self.spark, self.path)
        if not system.exists(place):
            return []
        names = sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory() and s.getPath().getName().startswith("v"))
        return [n for n in names if exists(self.spark, f"{self.path}/{n}/{_DONE}")]

    def read(self) -> DataFrame:
        """The version in force; without one, no rows."""
        found = self.versions()
        if not found:
            if self.schema is None:
                raise FileNotFoundError(f"there is no table {self.path}")
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.path}/{found[-1]}")

    def replace(self, rows: DataFrame, **options: str) -> None:
        """Put rows in force once all of them are written; then older versions than the one before go."""
        found = self.versions()
        number = 1 + (int(found[-1][1:].split("-")[0]) if found else 0)
        rows.write.options(**options).parquet(f"{self.path}/v{number:012d}-{uuid.uuid4().hex[:8]}")
        for old in found[:-KEPT]:
            delete(self.spark, f"{self.path}/{old}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A table at a path, versioned or plain Parquet."""
    table = Table(spark, path)
    return table.read() if table.versions() else spark.read.parquet(path)
