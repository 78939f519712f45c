"""Taking source files into a dataset: what each kind of source holds, and the one driver that commits it.

An ingester plans: it says which dates its source has, with which variables and which hash of the files they come from,
and gives a plan of their pixels that reads only the dates that are to be written. All else is the driver's: what is
known already is skipped by hash, the rest is committed date by date. A new source is one more ingester.

Daily archives of big-endian rasters are decoded here. Formats that need a library of their own (NetCDF) come as Parquet
files with the original's name and `.parquet` after it: row, col and a column for each variable.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.errors import SourceError
from firnline.functions.names import require_sound, snodas_names, snodas_problems
from firnline.sources import ingest as I
from firnline.sources.catalog import Dataset
from firnline.sources.snapshots import Snapshot


@dataclass(frozen=True)
class Plan:
    """incoming: date, variables, source_hash. pixels: from the dates to write (a column date) to date, variable, tile_id, pixel_id, value."""

    incoming: DataFrame
    pixels: Callable[[DataFrame], DataFrame]


class Ingester(Protocol):
    def plan(self, spark: SparkSession, source: str, dataset: Dataset) -> Plan: ...


def _incoming(hashes: DataFrame, dataset: Dataset) -> DataFrame:
    return I.source_hash(hashes).withColumn("variables", F.array(*[F.lit(v) for v in sorted(dataset.variables)]))


@dataclass(frozen=True)
class SnodasArchives:
    """Daily tar archives, each with one gzipped raster for every variable."""

    glob: str = "*.tar"

    def plan(self, spark: SparkSession, source: str, dataset: Dataset) -> Plan:
        archives = I.files(spark, source, self.glob)
        names = snodas_names(I.archive_members(archives)).withColumnRenamed("path", "archive")
        require_sound(snodas_problems(names))
        dated = names.groupBy("archive").agg(F.max("date").alias("date"))
        twice = dated.groupBy("date").count().where("count > 1")
        if bad := twice.orderBy("date").limit(3).collect():
            raise SourceError(f"more than one archive of {', '.join(r.date.isoformat() for r in bad)}")
        hashes = I.file_hashes(archives).join(F.broadcast(dated), F.col("path") == F.col("archive")).select("date", "name", "sha256")  # a row per archive

        def pixels(days: DataFrame) -> DataFrame:
            chosen = dated.join(F.broadcast(days), "date", "left_semi").select("archive")
            rows = I.snodas_pixels(archives.join(F.broadcast(chosen), F.col("path") == F.col("archive"), "left_semi"), dataset.grid)
            return I.observations_of(rows, dataset.grid, {k: v.nodata for k, v in dataset.variables.items()})

        return Plan(_incoming(hashes, dataset), pixels)


def _converted(spark: SparkSession, source: str, dataset: Dataset) -> tuple[DataFrame, DataFrame]:
    """Files of converted tables with the name of the original, and their rows with that name."""
    glob = "*.nc.parquet"
    original = F.regexp_replace("name", r"\.parquet$", "")
    found = I.files(spark, source, glob).withColumn("name", original)
    columns = ", ".join(f"`{k}` {v.dtype}" for k, v in sorted(dataset.variables.items()))
    rows = spark.read.schema(f"row int, col int, {columns}").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(source)
    return found, rows.withColumn("name", F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", ""))


def _long(rows: DataFrame, dataset: Dataset, keys: list[str]) -> DataFrame:
    """keys, variable, value of rows with a column for each variable; values of no data are left out."""
    nodata = F.create_map(*[F.lit(x) for k, v in sorted(dataset.variables.items()) for x in (k, float(v.nodata))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("variable"), F.col(k).cast("double").alias("value")) for k in sorted(dataset.variables)])).alias("e")
    return rows.select(*keys, each).select(*keys, "e.variable", "e.value").where(F.col("value").isNotNull() & (F.col("value") != F.element_at(nodata, F.col("variable"))))


def _on_grid(rows: DataFrame, dataset: Dataset) -> DataFrame:
    """rows of date, variable, row, col, value as observations; pixels beside the grid are an error of the source."""
    g = dataset.grid
    inside = F.assert_true(F.col("row").between(0, g.rows - 1) & F.col("col").between(0, g.cols - 1), F.lit("a source has pixels beside the dataset's grid"))
    return rows.where(inside.isNull()).select("date", "variable", g.tile_id(F.col("row"), F.col("col")).alias("tile_id"), g.pixel_id(F.col("row"), F.col("col")).alias("pixel_id"), "value")


@dataclass(frozen=True)
class SwannTables:
    """One converted file a day, of the given stage; files of other stages are left alone."""

    stage: str = "early"

    def plan(self, spark: SparkSession, source: str, dataset: Dataset) -> Plan:
        found, rows = _converted(spark, source, dataset)
        daily = I.swann_files(found, self.stage)
        named = daily.select("name", "date")

        def pixels(days: DataFrame) -> DataFrame:
            chosen = F.broadcast(named.join(F.broadcast(days), "date", "left_semi"))  # a row per file
            return _on_grid(_long(rows.join(chosen, "name"), dataset, ["date", "row", "col"]), dataset)

        return Plan(_incoming(I.file_hashes(daily).join(F.broadcast(named), "name"), dataset), pixels)


@dataclass(frozen=True)
class InstarrTiles:
    """Converted tiles, which together are a day's mosaic: first is the grid's north-west tile, size the edge of one."""

    first: tuple[int, int] = (8, 4)
    size: int = 2400

    def plan(self, spark: SparkSession, source: str, dataset: Dataset) -> Plan:
        found, rows = _converted(spark, source, dataset)
        tiles = I.instarr_files(found)
        I.instarr_days(tiles)  # raises where a day's tiles are not one set
        named = tiles.select("name", "date", "h", "v")
        h, v = self.first
        offsets = tiles.select("h", "v").distinct().select("h", "v", ((F.col("v") - v) * self.size).alias("row_off"), ((F.col("h") - h) * self.size).alias("col_off"))

        def pixels(days: DataFrame) -> DataFrame:
            chosen = F.broadcast(named.join(F.broadcast(days), "date", "left_semi"))  # a row per file
            values = _long(rows.join(chosen, "name"), dataset, ["date", "h", "v", "row", "col"])
            return _on_grid(I.mosaic(values, offsets, float("nan"), also=("date", "variable")), dataset)

        return Plan(_incoming(I.file_hashes(tiles).join(F.broadcast(named), "name"), dataset), pixels)


INGESTERS: dict[str, Ingester] = {"snodas": SnodasArchives(), "swann": SwannTables(), "instarr": InstarrTiles()}


def run_ingest(spark: SparkSession, source: str, dataset: Dataset, ingester: Ingester | None = None, force: bool = False, dry_run: bool = False) -> DataFrame:
    """Take a source into a dataset; gives date, action (write or skip) of each of its dates.

    Dates whose files and variables the manifest knows are skipped and their pixels not read; force writes all.
    """
    if ingester is None:
        if dataset.ingester not in INGESTERS:
            raise SourceError(f"dataset {dataset.name} has no ingester; there are {', '.join(sorted(INGESTERS))}")
        ingester = INGESTERS[dataset.ingester]
    plan = ingester.plan(spark, source, dataset)
    base = Snapshot.current(spark, dataset.path)
    decided = I.decisions(plan.incoming, base.manifest(), force)
    if dry_run:
        return decided.select("date", "action")
    todo = decided.where("action = 'write'").select("date")
    pixels = plan.pixels(todo).withColumn("value", F.col("value").cast("double"))
    return I.commit(pixels, decided, sorted(dataset.variables), dataset.path, complete=True, types={k: v.dtype for k, v in dataset.variables.items()}, base=base)
