"""Snapshots of a dataset's observations: what a commit changes is in force at once, for all of its dates or for none.

A commit writes the pixels of its dates to a folder of its own, then a manifest of all dates that names the folder of
each, and last a small log entry that names the manifest. The entry's number is one more than that of the snapshot it
builds on, and it gets its name by a rename that fails where the name is taken: of two commits that build on one snapshot
the first stays, the other looks again. That is a conflict if the first changed dates of the other, which else builds on
the new snapshot. A reader takes the entry of the highest number once and then reads what that one names, so it sees one
state whatever is committed meanwhile.

A job that dies leaves folders that no entry names: nothing reads them, and `vacuum` takes them away when they are old.
The rename is exclusive on HDFS; on a local disk it is for writers of one machine that don't meet in the same instant.
Datasets of plain `observations` and `manifest` folders are read as they are, and become snapshots by their first commit.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, IntegerType, StructField, StructType

from firnline.errors import ConflictError, SourceError
from firnline.functions.dates import DateQuery
from firnline.plans.tiles import pack
from firnline.sources.tables import KEPT, _path, delete, exists

MANIFEST = "source_hash string, variable string, format_version int, out_name string, date date"
#: The manifest as snapshots keep it: folder tells where a date's pixels are, null for plain tables.
_ROWS = f"{MANIFEST}, folder string"


def _log(path: str) -> str:
    return f"{path}/commits/log"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    place, system = _path(spark, _log(path))
    if not system.exists(place):
        return []
    return sorted(int(name) for s in system.listStatus(place) if (name := s.getPath().getName()).isdigit())


@dataclass(frozen=True)
class Snapshot:
    """One state of a dataset's dates: number 0 is that of plain tables, or of none."""

    spark: SparkSession
    path: str
    number: int
    folder: str | None = None
    schema: StructType | None = None

    @classmethod
    def current(cls, spark: SparkSession, path: str) -> Snapshot:
        found = _numbers(spark, path)
        return cls.at(spark, path, found[-1] if found else 0)

    @classmethod
    def at(cls, spark: SparkSession, path: str, number: int) -> Snapshot:
        if number == 0:
            return cls(spark, path, 0)
        entry = json.loads(spark.read.text(f"{_log(path)}/{number:012d}", wholetext=True).first()[0])
        return cls(spark, path, number, entry["manifest"], StructType.fromJson(entry["schema"]))

    def has_dates(self) -> bool:
        return self.number > 0 or self._plain()

    def _plain(self) -> bool:
        return exists(self.spark, f"{self.path}/manifest")

    def rows(self) -> DataFrame:
        """The manifest with the folder of each date's pixels."""
        reader = self.spark.read.schema(_ROWS)
        if self.number:
            place = f"{self.path}/commits/{self.folder}"
            if not exists(self.spark, place):
                raise ConflictError(f"snapshot {self.number} of {self.path} is gone: newer ones have taken its place")
            return reader.parquet(place)
        return reader.parquet(f"{self.path}/manifest") if self._plain() else self.spark.createDataFrame([], _ROWS)

    def held(self, days: Sequence[dt.date]) -> set[tuple]:
        """What the manifest says of some days, to tell whether another commit has changed them."""
        return {tuple(r) for r in self.rows().where(F.col("date").isin(*days)).select("date", "variable", "source_hash", "folder").collect()}

    def manifest(self) -> DataFrame:
        return self.rows().drop("folder")

    def pixel_schema(self) -> StructType | None:
        """tile_id, pixel_id, a column for each variable; None before the first commit."""
        if self.schema is not None or not exists(self.spark, f"{self.path}/observations"):
            return self.schema
        return StructType([f for f in self.spark.read.parquet(f"{self.path}/observations").schema if f.name != "date"])

    def observations(self, dates: DateQuery | Sequence[dt.date] | None = None) -> DataFrame:
        """The pixels of the dates in force; only the folders of chosen dates are listed. A row per day reaches the driver."""
        rows = self.rows()
        if isinstance(dates, (list, tuple)):
            rows = rows.where(F.col("date").isin(*dates))
        elif dates is not None:
            rows = rows.where(dates.predicate(F.col("date")))
        days = sorted((r.date, r.folder or "") for r in rows.select("date", "folder").distinct().collect())
        columns = self.pixel_schema()
        if columns is None:
            raise FileNotFoundError(f"there are no observations in {self.path}")
        schema = StructType([*columns, StructField("date", DateType())])
        of = lambda committed: [f"{f}/date={d}" if f else f"date={d}" for d, f in days if bool(f) == committed]
        parts = [r for r in (self._read(schema, f"{self.path}/observations", of(False)), self._read(schema, f"{self.path}/commits", of(True))) if r is not None]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def pack(self, position: Column, dates: DateQuery | None = None) -> None:
        """Write the dates that have none yet as tile arrays as well. Commits are not changed once written, so neither are these.

        Spark moves each date in as a whole: what a job that died has not moved is written by the next.
        """
        there = self._packed_places()
        todo = [(d, f) for d, f in self._places(dates) if f and (d, f) not in there]
        if not todo:
            return
        names = [f.name for f in self.pixel_schema() if f.name not in ("tile_id", "pixel_id")]
        folders = F.broadcast(self.spark.createDataFrame([(d, f.partition("=")[2]) for d, f in todo], "date date, commit string"))
        tiles = pack(self.observations([d for d, _ in todo]), position, names).join(folders, "date")
        out = tiles.repartition("commit", "date", "tile_id").sortWithinPartitions("commit", "date", "tile_id").write
        out.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").partitionBy("commit", "date").parquet(f"{self.path}/packed")

    def packed(self, dates: DateQuery | None = None) -> DataFrame | None:
        """Tile arrays of the chosen dates; None if one of them has none."""
        days = self._places(dates)
        if not days or not set(days) <= self._packed_places():
            return None
        arrays = [StructField(f.name, ArrayType(f.dataType)) for f in self.pixel_schema() if f.name not in ("tile_id", "pixel_id")]
        schema = StructType([StructField("tile_id", IntegerType()), *arrays, StructField("date", DateType())])
        return self._read(schema, f"{self.path}/packed", [f"{f}/date={d}" for d, f in days])

    def _places(self, dates: DateQuery | None) -> list[tuple[dt.date, str]]:
        rows = self.rows() if dates is None else self.rows().where(dates.predicate(F.col("date")))
        return sorted((r.date, r.folder or "") for r in rows.select("date", "folder").distinct().collect())

    def _packed_places(self) -> set[tuple[dt.date, str]]:
        place, system = _path(self.spark, f"{self.path}/packed/commit=*/date=*")
        return {(dt.date.fromisoformat(s.getPath().getName()[5:]), s.getPath().getParent().getName()) for s in system.globStatus(place) or []}

    def _read(self, schema: StructType, base: str, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in folders]).select(*schema.names)


def _claim(spark: SparkSession, path: str, number: int, text: str) -> bool:
    """Give a log entry its number; False if another commit has it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    made, system = _path(spark, f"{_log(path)}/.{uuid.uuid4().hex}")
    out = system.create(made)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(made, _path(spark, f"{_log(path)}/{number:012d}")[0], none)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        system.delete(made, False)
        return False
    return True


def write_pixels(pixels: DataFrame, path: str) -> str:
    """Write the pixels of a commit's dates; gives the name of their folder."""
    folder = f"commit={uuid.uuid4().hex}"
    dealt = pixels.repartition("date", "tile_id").sortWithinPartitions("date", "tile_id", "pixel_id")
    dealt.write.option("compression", "zstd").partitionBy("date").parquet(f"{path}/commits/{folder}")
    return folder


def publish(base: Snapshot, before: set[tuple], days: Sequence[dt.date], rows: DataFrame | None, schema: StructType | None, kept: int = KEPT) -> Snapshot:
    """Put rows of a manifest in force in place of those that days had in base; none takes the days away.

    before: what base held for the days, taken before anything was written, as base itself may be gone by now.
    Raises ConflictError where another commit has changed one of the days since.
    """
    spark, path = base.spark, base.path
    head = Snapshot.current(spark, path)
    while True:
        if head.number != base.number and head.held(days) != before:
            raise ConflictError(f"another commit has changed {', '.join(d.isoformat() for d in days[:3])} meanwhile")
        stay = head.rows().where(~F.col("date").isin(*days))
        merged = _merged(head.pixel_schema(), schema)
        folder = f"manifest-{uuid.uuid4().hex}"
        # a row per day and variable: some tens of thousands in decades of days
        (stay if rows is None else stay.unionByName(rows.select(*stay.columns))).coalesce(1).write.parquet(f"{path}/commits/{folder}")
        if _claim(spark, path, head.number + 1, json.dumps({"manifest": folder, "schema": merged.jsonValue()})):
            vacuum(spark, path, kept)
            return Snapshot(spark, path, head.number + 1, folder, merged)
        delete(spark, f"{path}/commits/{folder}")
        head = Snapshot.current(spark, path)


def _merged(old: StructType | None, new: StructType | None) -> StructType:
    """Columns of stored and of new pixels; one that changes its type is an error."""
    if old is None or new is None:
        return old or new or StructType()
    have = {f.name: f.dataType for f in old}
    if bad := [f.name for f in new if have.get(f.name, f.dataType) != f.dataType]:
        raise SourceError(f"the stored {', '.join(bad)} has another type")
    return StructType([*old, *[f for f in new if f.name not in have]])


def vacuum(spark: SparkSession, path: str, kept: int = KEPT, orphans_after: dt.timedelta | None = None) -> None:
    """Delete snapshots but the newest and `kept` before it, with all pixels that only they name.

    orphans_after: also delete folders that no entry names and that nothing was written to for so long, as jobs that
    died leave them. It must be longer than any commit takes.
    """
    numbers = _numbers(spark, path)
    stay = [Snapshot.at(spark, path, n) for n in numbers[-1 - kept :]]
    if not stay:
        return
    places = lambda s: s.rows().select("date", F.coalesce("folder", F.lit("")).alias("folder"))
    named = reduce(DataFrame.union, [places(s) for s in stay]).distinct()
    for n in numbers[: -1 - kept]:
        snapshot = Snapshot.at(spark, path, n)
        dropped = places(snapshot) if n > 1 else places(snapshot).union(places(Snapshot.at(spark, path, 0)))
        for r in dropped.distinct().join(named, ["date", "folder"], "left_anti").collect():  # the days that one commit replaced
            delete(spark, f"{path}/commits/{r.folder}/date={r.date}" if r.folder else f"{path}/observations/date={r.date}")
            if r.folder:
                delete(spark, f"{path}/packed/{r.folder}/date={r.date}")
        delete(spark, f"{path}/commits/{snapshot.folder}")
        delete(spark, f"{_log(path)}/{n:012d}")  # last, so that a vacuum that dies is done again
    if orphans_after is not None:
        place, system = _path(spark, f"{path}/commits")
        kept_names = {"log", *[s.folder for s in stay], *[r.folder for r in named.select("folder").distinct().collect()]}
        limit = (dt.datetime.now(dt.timezone.utc) - orphans_after).timestamp() * 1000
        for s in system.listStatus(place):
            name = s.getPath().getName()
            if name not in kept_names and s.getModificationTime() < limit:
                delete(spark, f"{path}/commits/{name}")
