"""Reports and health checks. A finding is a row check, dataset, target, issue."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.errors import QueryError
from firnline.functions.dates import DateQuery, DateRange
from firnline.functions.grid import Grid, close
from firnline.functions.names import format_version
from firnline.plans.zonal import Variable, completeness

FINDING = "check string, dataset string, target string, issue string"


def findings(rows: DataFrame, check: str, dataset: Column | str, target: Column, issue: Column) -> DataFrame:
    dataset = F.lit(dataset) if isinstance(dataset, str) else dataset
    return rows.select(F.lit(check).alias("check"), dataset.alias("dataset"), target.alias("target"), issue.alias("issue"))


def status(listing: DataFrame) -> DataFrame:
    """dataset, dates, first_date, last_date of a listing (dataset, date)."""
    return listing.groupBy("dataset").agg(F.count_distinct("date").alias("dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def missing_dates(available: DataFrame, start: dt.date | None = None, end: dt.date | None = None, today: dt.date | None = None) -> DataFrame:
    """The days without data, from the first available one (or start) to end, else today, else the last available one."""
    first = F.lit(start) if start else F.min("date")
    last = F.lit(end or today) if end or today else F.max("date")
    span = available.agg(first.alias("a"), last.alias("b")).where("a <= b")
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    return days.join(available.select("date").distinct(), "date", "left_anti")


def completeness_findings(listing: DataFrame, dataset: str, wanted: Sequence[str], dates: DateQuery | None = None) -> DataFrame:
    bad = completeness(listing, wanted, dates or DateRange())
    return findings(bad, "dates", dataset, F.col("date").cast("string"), F.concat(F.lit("missing "), F.array_join("missing", ", ")))


def latest_date(observations: DataFrame) -> DataFrame:
    """date: the last one that there is, null if there is none."""
    return observations.agg(F.max("date").alias("date"))


def value_ranges(observations: DataFrame, variables: Sequence[Variable], on: dt.date | None = None, pixels: int | None = None) -> DataFrame:
    """variable, unit, minimum, maximum, mean (all scaled), nodata_pct on one date, the latest if none is given.

    pixels: how many the raster has; pixels without data need not be rows. None: each has a row.
    """
    if on is None:
        on = latest_date(observations).first()[0]
        if on is None:
            raise QueryError("there are no ingested dates")
    day = observations.where(F.col("date") == F.lit(on))
    chosen = sorted(variables, key=lambda v: v.key)
    whole = F.count(F.lit(1)) if pixels is None else F.lit(pixels)
    each = []
    for v in chosen:
        x = F.when(v.source.isNotNull() & (v.source != F.lit(v.nodata)), v.source.cast("double"))
        each.append(F.struct(F.lit(v.key).alias("variable"), F.lit(v.unit).alias("unit"), (F.min(x) / v.scale).alias("minimum"), (F.max(x) / v.scale).alias("maximum"), (F.avg(x) / v.scale).alias("mean"), (F.lit(100.0) * (whole - F.count(x)) / F.nullif(whole, F.lit(0))).alias("nodata_pct")))
    told = day.agg(F.array(*each).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 0")
    return told.select(F.explode("r").alias("r")).select("r.*").where("nodata_pct is not null")


def band_statistics(pixels: DataFrame, value: str, nodata: float, keys: Sequence[str] = ()) -> DataFrame:
    """minimum, maximum, mean and population deviation of the values with data."""
    x = F.when(F.col(value) != nodata, F.col(value).cast("double"))
    return pixels.groupBy(*keys).agg(F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"))


def grid_findings(stored: DataFrame, dataset: str, origin_x: float, origin_y: float, pixel: float, cols: int, rows: int, crs: str) -> DataFrame:
    """Findings of stored pixel tables (target, origin_x, origin_y, pixel, cols, rows, crs) that are not on the grid."""
    shape = (F.col("cols") != cols) | (F.col("rows") != rows)
    place = ~(close(F.col("origin_x"), F.lit(origin_x)) & close(F.col("origin_y"), F.lit(origin_y)) & close(F.col("pixel"), F.lit(pixel)))
    issue = F.when(F.col("crs") != crs, F.concat(F.lit("crs is "), "crs")).when(shape, F.format_string("shape is %d x %d", "rows", "cols")).when(place, "not on the grid's lattice")
    return findings(stored.withColumn("_i", issue).where("_i is not null"), "grid", dataset, F.col("target"), F.col("_i"))


def lattice_findings(tables: Mapping[str, DataFrame], dataset: str, grid: Grid) -> DataFrame:
    """Findings of tables with pixel_id (and tile_id) whose pixels are not on the grid, or not in their tiles."""
    parts = []
    for target, rows in tables.items():
        row, col = grid.row_of(F.col("pixel_id")), grid.col_of(F.col("pixel_id"))
        off = (F.col("pixel_id") < 0) | (F.col("pixel_id") >= grid.rows * grid.cols)
        astray = ~off & (F.col("tile_id") != grid.tile_id(row, col)) if "tile_id" in rows.columns else F.lit(False)
        counted = rows.agg(F.count_if(off).alias("off"), F.count_if(astray).alias("astray"))
        issue = F.when(F.col("off") > 0, F.format_string("%d pixels are off the grid", "off")).when(F.col("astray") > 0, F.format_string("%d pixels are in another tile", "astray"))
        parts.append(findings(counted.withColumn("_i", issue).where("_i is not null"), "grid", dataset, F.lit(target), F.col("_i")))
    return reduce(DataFrame.unionByName, parts)


def artifact_findings(manifest: DataFrame, dataset: str, wanted: Mapping[str, int]) -> DataFrame:
    """Findings of layers that the manifest (artifact, tag) lacks or has in another format version."""
    spark = manifest.sparkSession
    expected = spark.createDataFrame(sorted(wanted.items()), "artifact string, current int")
    joined = expected.join(manifest.select("artifact", format_version(F.col("tag")).alias("stored"), F.lit(True).alias("there")), "artifact", "left")
    stale = ~F.col("stored").eqNullSafe(F.col("current"))
    issue = F.when(F.col("there").isNull(), "missing").when(stale, F.concat(F.lit("stale format (stored "), F.coalesce(F.col("stored").cast("string"), F.lit("none")), F.lit(", current "), F.col("current").cast("string"), F.lit(")")))
    return findings(joined.withColumn("_i", issue).where("_i is not null"), "files", dataset, F.col("artifact"), F.col("_i"))


def stale_findings(stored: DataFrame, dataset: str, current: int) -> DataFrame:
    """Findings of stored artifacts (artifact, tag) that are of another format version."""
    version = format_version(F.col("tag"))
    issue = F.format_string("stale format (stored %s, current %s)", F.coalesce(version.cast("string"), F.lit("none")), F.lit(str(current)))
    return findings(stored.where(~version.eqNullSafe(F.lit(current))), "files", dataset, F.col("artifact"), issue)


def without_pixels(records: DataFrame, burned: DataFrame) -> DataFrame:
    """triplet of records (triplet) whose basin has no burned pixels (basin)."""
    return records.select("triplet").join(burned.select(F.col("basin").alias("triplet")), "triplet", "left_anti")


def without_record(burned: DataFrame, records: DataFrame) -> DataFrame:
    """triplet of basins with burned pixels (basin) that have no record (triplet), each once."""
    return burned.select(F.col("basin").alias("triplet")).distinct().join(records.select("triplet"), "triplet", "left_anti")


def basin_findings(dataset: str, records: DataFrame, burned: DataFrame, coverage: DataFrame) -> DataFrame:
    """Findings of basins without pixels, pixels without basin, and incomplete coverage.

    records: triplet; burned: basin, area_m2 of each pixel; coverage: triplet, coverage.
    """
    have = burned.groupBy(F.col("basin").alias("triplet")).agg(F.sum("area_m2").alias("area"))
    checks = [
        (without_pixels(records, burned), "no raster"),
        (without_record(burned, records), "orphan raster"),
        (coverage.where("coverage = 'partial'"), "partial coverage"),
        (coverage.where("coverage = 'none'"), "no coverage"),
        (have.where("coalesce(area, 0) <= 0"), "empty basin: it does not meet the grid, or is all masked"),
    ]
    return reduce(DataFrame.unionByName, [findings(rows, "pourpoints", dataset, F.col("triplet"), F.lit(issue)) for rows, issue in checks])


#: The checks in the order in which their findings are told; one that is not among them comes after, by name.
CHECKS = ("grid", "dates", "files", "pourpoints")


def health(checks: Mapping[str, Callable[[], DataFrame]], chosen: Sequence[str] | None = None) -> DataFrame:
    """The findings of the chosen checks (each once, in the order of CHECKS), sorted within each.

    checks: functions that give findings, by name; a new check is one more entry.
    """
    known = [*CHECKS, *sorted(set(checks) - set(CHECKS))]
    names = list(dict.fromkeys(chosen or known))
    if unknown := [n for n in names if n not in known]:
        raise QueryError(f"unknown check {', '.join(unknown)}; there are {', '.join(known)}")
    if absent := [n for n in names if n not in checks and chosen]:
        raise QueryError(f"there is nothing to check for {', '.join(absent)}")
    parts = [checks[n]().withColumn("_k", F.lit(k)) for k, n in enumerate(known) if n in names and n in checks]
    return reduce(DataFrame.unionByName, parts).orderBy("_k", "dataset", "target", "issue").drop("_k")
