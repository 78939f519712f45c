"""Taking in dated pixels: source files, mosaics, and commits that converge.

A date is written when its content is new: the manifest keeps a hash of each date's source, and dates whose hash is
known are skipped without reading them. All dates of a commit come in force at once, as a snapshot, so a job that dies
leaves what was there and is repeated in full by the next.
"""

from __future__ import annotations

import datetime as dt
import gzip
import io
import tarfile
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from firnline.errors import ExistsError, IncompleteData, SourceError
from firnline.functions.grid import Grid
from firnline.functions.names import INSTARR, SWANN, output_name, snodas_names, versioned
from firnline.sources.snapshots import Snapshot, publish, write_pixels
from firnline.sources.tables import Table, delete, exists, move

FORMAT = 1


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, length, content of source files; content is read only where a plan asks for it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def file_hashes(found: DataFrame) -> DataFrame:
    return found.select("path", "name", F.sha2("content", 256).alias("sha256"))


def source_hash(hashes: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """One versioned digest for all files of a key, whatever order they come in."""
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit(":"), "sha256"))), "\n"), 256)
    return hashes.groupBy(*keys).agg(digest.alias("_d")).select(*keys, versioned(FORMAT, F.col("_d")).alias("source_hash"))


def swann_files(found: DataFrame, stage: str = "early") -> DataFrame:
    """found with date, of daily files in the given stage; others are left out."""
    parsed = found.where(F.col("name").rlike(SWANN)).withColumns({"date": F.to_date(F.regexp_extract("name", SWANN, 1), "yyyyMMdd"), "stage": F.regexp_extract("name", SWANN, 2)})
    return parsed.where(F.col("stage") == stage)


def instarr_files(found: DataFrame) -> DataFrame:
    """found with h, v, collection, date, version of tile files; others are left out."""
    part = lambda k: F.regexp_extract("name", INSTARR, k)
    return found.where(F.col("name").rlike(INSTARR)).withColumns({"h": part(1).cast("int"), "v": part(2).cast("int"), "collection": part(3), "date": F.to_date(part(4), "yyyyMMdd"), "version": part(5)})


def tiles_by_date(tiles: DataFrame, kind: Column, place: Column, name: Column) -> DataFrame:
    """date, kinds (each once, ascending), tiles (names, ascending), places (how many), n of each date's tiles."""
    return tiles.groupBy("date").agg(F.array_sort(F.collect_set(kind)).alias("kinds"), F.array_sort(F.collect_list(name)).alias("tiles"), F.count_distinct(place).alias("places"), F.count(F.lit(1)).alias("n"))


def instarr_days(tiles: DataFrame) -> DataFrame:
    """date, stem, tiles: a day's tiles are one mosaic, of one collection and version."""
    days = tiles_by_date(tiles, F.struct("collection", "version"), F.struct("h", "v"), F.col("name"))
    mixed = days.where((F.size("kinds") > 1) | (F.col("n") > F.col("places")))
    if bad := mixed.orderBy("date").limit(3).collect():
        raise SourceError("; ".join(f"{r.date}: its tiles are not one set" for r in bad))
    kind = F.get("kinds", F.lit(0))
    return days.select("date", F.format_string("SPIRES_NRT_%s_%s_%s", kind["collection"], F.date_format("date", "yyyyMMdd"), kind["version"]).alias("stem"), "tiles")


def mosaic(tiles: DataFrame, offsets: DataFrame, nodata: float, keys: Sequence[str] = ("h", "v"), also: Sequence[str] = ()) -> DataFrame:
    """Tile pixels (keys, row, col, value) at their offsets (keys, row_off, col_off): gaps and nodata are absent rows.

    also: columns that come along.
    """
    placed = tiles.join(F.broadcast(offsets), list(keys))  # one row for each tile of a fixed grid
    return placed.where(F.col("value") != nodata).select(*also, (F.col("row") + F.col("row_off")).cast("int").alias("row"), (F.col("col") + F.col("col_off")).cast("int").alias("col"), "value")


def archive_members(archives: DataFrame) -> DataFrame:
    """path, stem of the rasters in tar archives (path, content); only the headers are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    stems = [m.name.rpartition("/")[2].split(".")[0] for m in tar if ".dat" in m.name]
                yield pd.DataFrame({"path": path, "stem": stems})

    return archives.select("path", "content").mapInPandas(run, "path string, stem string")


def snodas_pixels(archives: DataFrame, grid: Grid) -> DataFrame:
    """name, row, values of the rasters in daily tar archives (path, content), a row of the grid at a time.

    An archive holds gzipped pairs of a header and big-endian 16-bit integers, north row first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        stem = member.name.rpartition("/")[2].split(".")[0]
                        if ".dat" not in member.name:
                            continue
                        raw = tar.extractfile(member).read()
                        values = np.frombuffer(gzip.decompress(raw) if member.name.endswith(".gz") else raw, ">i2")
                        if values.size != grid.rows * grid.cols:
                            raise SourceError(f"{member.name} has {values.size} values, the grid {grid.rows} x {grid.cols}")
                        rows = values.reshape(grid.rows, grid.cols).astype("int16")
                        for at in range(0, grid.rows, 64):
                            part = rows[at : at + 64]
                            yield pd.DataFrame({"stem": stem, "row": np.arange(at, at + len(part), dtype="int32"), "values": list(part)})

    raw = archives.select("content").mapInPandas(run, "stem string, row int, values array<smallint>")
    return snodas_names(raw).select("stem", "product", "date", "row", "values")


def observations_of(rows: DataFrame, grid: Grid, nodata: float | Mapping[str, float], variable: str = "product") -> DataFrame:
    """date, variable, tile_id, pixel_id, value from rows of values. nodata: of all variables, or of each."""
    missing = F.element_at(F.create_map(*[F.lit(x) for k, v in nodata.items() for x in (k, float(v))]), F.col("variable")) if isinstance(nodata, Mapping) else F.lit(nodata)
    each = rows.select("date", F.col(variable).alias("variable"), "row", F.posexplode("values").alias("col", "value")).where(~F.col("value").eqNullSafe(missing))
    return each.select("date", "variable", grid.tile_id(F.col("row"), F.col("col")).alias("tile_id"), grid.pixel_id(F.col("row"), F.col("col")).alias("pixel_id"), "value")


def wide(observations: DataFrame, variables: Sequence[str], types: Mapping[str, str] | None = None, order: str | None = None) -> DataFrame:
    """Long observations with a column for each variable, of its type if given, as the observations table keeps them.

    Of several values for a variable and pixel the last by `order` counts, the largest of those or without an order.
    """
    ranked = F.col("value") if order is None else F.struct(F.col(order).alias("order"), F.col("value").alias("value"))
    of = lambda v: F.max(F.when(F.col("variable") == v, ranked))
    value = lambda v: of(v) if order is None else of(v)["value"]
    return observations.groupBy("date", "tile_id", "pixel_id").agg(*[(value(v).cast(types[v]) if types else value(v)).alias(v) for v in variables])


def decisions(incoming: DataFrame, manifest: DataFrame | None, force: bool = False) -> DataFrame:
    """date, source_hash, action (write or skip) of incoming dates against a manifest (date, variable, source_hash).

    A date is skipped when the manifest has exactly the incoming variables, all with the incoming hash.
    """
    if manifest is None or force:
        return incoming.select("date", "source_hash", F.lit("write").alias("action"))
    have = manifest.groupBy("date").agg(F.array_sort(F.collect_set("variable")).alias("_names"), F.array_sort(F.collect_set("source_hash")).alias("_hashes"))
    same = F.coalesce((F.col("_names") == F.array_sort("variables")) & (F.col("_hashes") == F.array("source_hash")), F.lit(False))
    return incoming.join(have, "date", "left").select("date", "source_hash", F.when(same, "skip").otherwise("write").alias("action"))


def manifest_of(spark: SparkSession, path: str) -> DataFrame | None:
    """A dataset's manifest in force; None before its first commit."""
    snapshot = Snapshot.current(spark, path)
    return snapshot.manifest() if snapshot.has_dates() else None


def commit(observations: DataFrame, plan: DataFrame, variables: Sequence[str], path: str, complete: bool = False, merge: bool = False, types: Mapping[str, str] | None = None, order: str | None = None, base: Snapshot | None = None) -> DataFrame:
    """Put the planned dates' pixels and manifest rows in force, all at once; gives date, action of all planned dates.

    plan: date, source_hash, action, and variable where hashes are of single variables. Only written dates are
    replaced, and the manifest gets the variables that were found. A date that should be written but has no pixels is
    an error, as is one that lacks a variable, with `complete`; nothing has been written then. With `merge` a date's
    pixels join those that are stored: what comes now counts for its variable and pixel, all else stays. order: the
    column that tells which of several values is the last. base: the snapshot that the plan is of, else the current one;
    a commit that has changed one of the dates since is a conflict.
    """
    spark = observations.sparkSession
    base = base or Snapshot.current(spark, path)
    planned = plan.collect()  # a row per day, or per day and variable
    outcome = spark.createDataFrame(sorted({(r.date, r.action) for r in planned}), "date date, action string")
    by_variable = "variable" in plan.columns
    keys = ["date", "variable"] if by_variable else ["date"]
    todo = spark.createDataFrame([tuple(r[k] for k in keys) + (r.source_hash,) for r in planned if r.action == "write"], ("date date, variable string" if by_variable else "date date") + ", source_hash string")
    days = sorted({r.date for r in planned if r.action == "write"})
    if not days:
        return outcome
    chosen = observations.join(F.broadcast(todo.select("date").distinct()), "date", "left_semi")
    found = {(r.date, r.variable) for r in chosen.where(F.col("variable").isin(*variables)).select("date", "variable").distinct().collect()}
    if absent := [d.isoformat() for d in days if all(d != date for date, _ in found)]:
        raise SourceError(f"no pixels for {', '.join(absent[:3])}")
    if complete and (short := [f"{d.isoformat()} has no {v}" for d in days for v in variables if (d, v) not in found]):
        raise IncompleteData("; ".join(short[:3]))
    present = spark.createDataFrame(sorted(found), "date date, variable string")
    data = wide(chosen, variables, types, order)
    before = base.held(days)
    stored_rows = base.rows().where(F.col("date").isin(*days)) if merge else None
    if merge and not stored_rows.isEmpty():
        at, stored_pixels = ["date", "tile_id", "pixel_id"], base.observations(days)
        kept = [v for v in variables if v in stored_pixels.columns]
        data = data.alias("n").join(stored_pixels.alias("o"), at, "full").select(*at, *[(F.coalesce(f"n.{v}", f"o.{v}") if v in kept else F.col(f"n.{v}")).alias(v) for v in variables])
    columns = StructType([f for f in data.schema if f.name != "date"])
    folder = write_pixels(data, path)
    named = present.join(todo, keys).withColumn("format_version", F.lit(FORMAT)).withColumn("out_name", output_name(F.date_format("date", "yyyyMMdd"), F.col("variable")))
    if merge:
        named = named.unionByName(stored_rows.select(named.columns).join(F.broadcast(present), ["date", "variable"], "left_anti"))
    publish(base, before, days, named.withColumn("folder", F.lit(folder)), columns)
    return outcome


def remove_date(spark: SparkSession, path: str, date: str, dry_run: bool = False) -> list[str]:
    """Take one date out of a dataset; tells the tables that have it."""
    day, base = dt.date.fromisoformat(date), Snapshot.current(spark, path)
    tables = {"manifest": base.manifest().where(F.col("date") == F.lit(day)), "observations": base.observations([day])}
    have = [name for name, rows in tables.items() if not rows.isEmpty()]
    if have and not dry_run:
        publish(base, base.held([day]), [day], None, None)
    return have


LAYERS = "zone_pixels"


def require_absent_layers(spark: SparkSession, path: str, force: bool = False) -> None:
    """Raise if a dataset has zone layers already, unless they may be replaced."""
    if not force and exists(spark, f"{path}/{LAYERS}"):
        raise ExistsError(f"{path} has zone layers already: replace them with force")


def write_layers(layers: DataFrame, path: str, force: bool = False) -> None:
    """Put a dataset's zone pixels in force, once all of them are written; existing ones are replaced only with force."""
    spark = layers.sparkSession
    require_absent_layers(spark, path, force)
    table = Table(spark, f"{path}/{LAYERS}")
    if exists(spark, table.path) and not table.versions():  # plain files from elsewhere: they go when the new ones are there
        aside = Table(spark, f"{path}/{LAYERS}-new")
        aside.replace(layers.repartition("tile_id").sortWithinPartitions("pixel_id"), compression="zstd")
        delete(spark, table.path)
        move(spark, aside.path, table.path)
        return
    table.replace(layers.repartition("tile_id").sortWithinPartitions("pixel_id"), compression="zstd")


def provenance_tag(parts: Sequence[Column]) -> Column:
    """A versioned digest of a row's parts."""
    return versioned(FORMAT, F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256))
