"""Zonal statistics: area-weighted reductions of dated pixels over crossed zones.

The whole query is one lazy plan. Geometry (a basin's pixels with their zones) is joined once to the observations of
all selected dates and variables, and one aggregation per (basin, date, cell) computes every variable. Map-side partial
sums make the shuffle as large as the result, not as the pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.errors import BasinNotBurned, IncompleteData, QueryError
from firnline.functions.dates import DateQuery
from firnline.functions.names import glob_pattern
from firnline.functions.zones import Axis, Zone

MAX_CELLS = 10_000


@dataclass(frozen=True)
class Variable:
    """A measured quantity: how it is stored, reduced and reported."""

    key: str
    unit: str
    scale: float = 1
    reducer: str = "mean"
    nodata: float = -9999
    dtype: str = "smallint"
    glob: str = ""
    column: str | None = None

    def __post_init__(self) -> None:
        if "__" in self.key:
            raise QueryError(f"variable {self.key!r} must not hold '__'")
        if self.nodata != self.nodata or self.nodata in (float("inf"), float("-inf")):
            raise QueryError(f"variable {self.key!r} needs a finite nodata value")
        if self.reducer not in REDUCERS:
            raise QueryError(f"variable {self.key!r} has unknown reducer {self.reducer!r}; there are {', '.join(sorted(REDUCERS))}")

    @property
    def stat(self) -> str:
        return f"{self.reducer}_{self.key}_{self.unit}"

    @property
    def source(self) -> Column:
        return F.col(self.column or self.key)


#: From the sums of value times area and of area over pixels with data to a statistic; another reducer is one more entry.
REDUCERS: dict[str, Callable[[Column, Column], Column]] = {
    "mean": lambda weighted, area: weighted / F.nullif(area, F.lit(0.0)),
    "total": lambda weighted, area: weighted,
}


def choose_variables(keys: Sequence[str], known: Mapping[str, Variable]) -> list[Variable]:
    """The variables asked for, each once, in order of key."""
    if not keys:
        raise QueryError("ask for at least one variable")
    if unknown := sorted(set(keys) - set(known)):
        raise QueryError(f"unknown variable {', '.join(unknown)}; there are {', '.join(sorted(known))}")
    return [known[k] for k in sorted(set(keys))]


def require_cell_count(axes: Sequence[Axis], most: int = MAX_CELLS) -> int:
    """The number of crossed cells; too many are an error before anything is read."""
    count = 1
    for axis in axes:
        count *= len(axis.scheme.zones())
    if count > most:
        raise QueryError(f"the zones cross to {count} cells; the limit is {most}")
    return count


def cell_zones(axes: Sequence[Axis]) -> list[tuple[Zone, ...]]:
    """The zones of each cell, the last axis fastest."""
    return list(product(*[axis.scheme.zones() for axis in axes]))


def cells_frame(spark: SparkSession, axes: Sequence[Axis]) -> DataFrame:
    """cell, and for each axis k its ordinal o{k} and label z{k}."""
    rows = [(i, *[x for z in zones for x in (z.ordinal, z.label)]) for i, zones in enumerate(cell_zones(axes))]
    return spark.createDataFrame(rows, "cell int" + "".join(f", o{k} int, z{k} string" for k in range(len(axes))))


def cell_id(ordinals: Sequence[Column], sizes: Sequence[int]) -> Column:
    """The cell's number, the first axis most significant."""
    out: Column = F.lit(0)
    for ordinal, size in zip(ordinals, sizes, strict=True):
        out = out * size + ordinal
    return out.cast("int")


def in_zone_geometry(aoi: DataFrame, zone_pixels: DataFrame, axes: Sequence[Axis], mask: DataFrame | None = None) -> DataFrame:
    """basin, pixel_id, area_m2, cell: a basin's pixels that are in a zone on every axis.

    aoi has basin, pixel_id, area_m2 (and tile_id if tiles are to be pruned); zone_pixels is read for the axes' columns
    only. mask: pixel_ids where the dataset has valid ground at all.
    """
    ground = aoi.where("area_m2 > 0")
    if mask is not None:
        ground = ground.join(mask.select("pixel_id"), "pixel_id", "left_semi")
    tiles = [F.col("tile_id")] if "tile_id" in aoi.columns else []
    if axes:
        columns = sorted({axis.layer.column for axis in axes})
        at = ["tile_id", "pixel_id"] if tiles and "tile_id" in zone_pixels.columns else ["pixel_id"]
        ground = ground.join(zone_pixels.select(*at, *columns), at)
    numbered = ground.select("basin", "pixel_id", "area_m2", *tiles, *[axis.ordinal.alias(f"o{k}") for k, axis in enumerate(axes)])
    for k in range(len(axes)):
        numbered = numbered.where(F.col(f"o{k}") >= 0)
    cell = cell_id([F.col(f"o{k}") for k in range(len(axes))], [len(axis.scheme.zones()) for axis in axes])
    return numbered.select("basin", "pixel_id", "area_m2", *tiles, cell.alias("cell"))


def cell_areas(geometry: DataFrame) -> DataFrame:
    """basin, cell, area_m2: also of pixels that have no data for a variable."""
    return geometry.groupBy("basin", "cell").agg(F.sum(F.col("area_m2").cast("double")).alias("area_m2"))


def weighted(value: Column, area: Column) -> Column:
    """Value times area as float32, summed as double: pixels are small integers or float32, and so are areas."""
    return (value.cast("float") * area.cast("float")).cast("double")


def reductions(observations: DataFrame, geometry: DataFrame, variables: Sequence[Variable]) -> DataFrame:
    """basin, date, cell and each variable's unscaled statistic, from wide observations (date, pixel_id, a column each).

    Spark chooses the join by the size of the geometry it finds: broadcast when small, shuffled when not. Where both
    sides know their tiles these are part of the join's key.
    """
    at = [c for c in ("tile_id", "pixel_id") if c == "pixel_id" or c in observations.columns and c in geometry.columns]
    columns = dict.fromkeys(v.column or v.key for v in variables)
    return reduced(observations.select("date", *at, *columns).join(geometry.select("basin", *at, "area_m2", "cell"), at), variables)


def reduced(pixels: DataFrame, variables: Sequence[Variable]) -> DataFrame:
    """basin, date, cell and each variable's unscaled statistic of pixels with basin, date, cell, area_m2 and values."""
    terms = []
    for v in variables:
        has_data = v.source.isNotNull() & (v.source != F.lit(v.nodata))
        terms.append(F.sum(F.when(has_data, weighted(v.source, F.col("area_m2")))).alias(f"w_{v.key}"))
        terms.append(F.sum(F.when(has_data, F.col("area_m2").cast("double"))).alias(f"a_{v.key}"))
    sums = pixels.groupBy("basin", "date", "cell").agg(*terms)
    return sums.select("basin", "date", "cell", *[REDUCERS[v.reducer](F.col(f"w_{v.key}"), F.col(f"a_{v.key}")).alias(v.stat) for v in variables])


@dataclass
class ZonalResult:
    """The rows of a result and what its writers need; nothing has run yet."""

    rows: DataFrame
    areas: DataFrame
    axes: list[Axis]
    variables: list[Variable]
    include_empty: bool = False
    layers: list[str] = field(default_factory=list)


def zonal_stats(
    observations: DataFrame,
    aoi: DataFrame,
    zone_pixels: DataFrame | None,
    dates: DateQuery,
    variables: Sequence[Variable],
    axes: Sequence[Axis] = (),
    mask: DataFrame | None = None,
    available: DataFrame | None = None,
    include_empty: bool = False,
    max_cells: int = MAX_CELLS,
    reduction: Callable[[DataFrame, DataFrame, Sequence[Variable]], DataFrame] = reductions,
) -> ZonalResult:
    """Statistics of each variable for every basin of aoi, selected date and crossed zone.

    rows: basin, date, cell, o{k} and z{k} of each axis, area_m2, a column for each variable's scaled statistic. Every
    available date that the query selects has a row for each cell, with null where a cell has no data on it. Cells
    without ground are left out unless include_empty; the one cell of a query without axes never is.
    available: one row per ingested date, else the dates of the observations.
    reduction: what gives each cell's statistics from observations, geometry and variables; tile arrays have their own.
    """
    if not variables:
        raise QueryError("ask for at least one variable")
    spark = observations.sparkSession
    require_cell_count(axes, max_cells)
    chosen = sorted(variables, key=lambda v: v.key)
    observed = observations.where(dates.predicate(F.col("date")))
    geometry = in_zone_geometry(aoi, zone_pixels if zone_pixels is not None else aoi, axes, mask)
    areas = cell_areas(geometry)
    cells = F.broadcast(cells_frame(spark, axes))  # at most max_cells rows
    if include_empty or not axes:
        basins = aoi.select("basin").distinct()
        spine_cells = basins.crossJoin(cells).join(areas, ["basin", "cell"], "left").withColumn("area_m2", F.coalesce("area_m2", F.lit(0.0)))
    else:  # only cells that have ground
        spine_cells = areas.where("area_m2 > 0").join(cells, "cell").select("basin", *cells.columns, "area_m2")
    days = (available if available is not None else observations).where(dates.predicate(F.col("date"))).select("date").distinct()
    values = reduction(observed, geometry, chosen)
    spine = spine_cells.crossJoin(days)
    labels = [c for k in range(len(axes)) for c in (f"o{k}", f"z{k}")]
    rows = spine.join(values, ["basin", "date", "cell"], "left").select("basin", "date", "cell", *labels, "area_m2", *[(F.col(v.stat) / F.lit(float(v.scale))).alias(v.stat) for v in chosen])
    return ZonalResult(rows, spine_cells, list(axes), chosen, include_empty, [axis.layer.key for axis in axes])


def ordered(result: ZonalResult) -> DataFrame:
    """Rows by basin, date, then cell."""
    return result.rows.orderBy("basin", "date", "cell")


def resolved(listing: DataFrame) -> DataFrame:
    """date, variable, files: how many files each variable of a date stands in, of a listing (date, variable)."""
    return listing.groupBy("date", "variable").agg(F.count(F.lit(1)).alias("files"))


def listing_of(files: DataFrame, variables: Sequence[Variable]) -> DataFrame:
    """date, variable of files (date, name): a file is a variable's if its name matches the variable's glob."""
    own = [F.when(F.col("name").rlike(glob_pattern(v.glob)), F.lit(v.key)) for v in variables if v.glob]
    named = files.select("date", F.explode(F.array_compact(F.array(*own))).alias("variable")) if own else files.select("date", F.lit(None).cast("string").alias("variable")).limit(0)
    return named


def first_present(listing: DataFrame) -> DataFrame:
    """The first entry of a listing (date, variable): of the earliest date, the first variable by name."""
    return listing.select("date", "variable").where("date is not null and variable is not null").orderBy("date", "variable").limit(1)


def completeness(listing: DataFrame, wanted: Sequence[str], dates: DateQuery | None = None) -> DataFrame:
    """date, missing: dates of a listing (date, variable) that lack a wanted variable or have it more than once."""
    found = resolved(listing if dates is None else listing.where(dates.predicate(F.col("date"))))
    once = found.groupBy("date").agg(*[F.sum(F.when(F.col("variable") == v, F.col("files"))).alias(f"n{i}") for i, v in enumerate(sorted(set(wanted)))])
    missing = F.filter(F.array(*[F.when(F.coalesce(f"n{i}", F.lit(0)) != 1, F.lit(v)) for i, v in enumerate(sorted(set(wanted)))]), lambda x: x.isNotNull())
    return once.select("date", missing.alias("missing")).where(F.size("missing") > 0)


def require_complete(listing: DataFrame, wanted: Sequence[str], dates: DateQuery) -> None:
    """Raise if a selected date has some of the wanted variables but not each exactly once."""
    some = listing.where(F.col("variable").isin(*sorted(set(wanted))))
    if bad := completeness(some, wanted, dates).orderBy("date").limit(5).collect():
        raise IncompleteData("; ".join(f"{r.date.isoformat()}: {', '.join(r.missing)}" for r in bad))


def require_burned(aoi: DataFrame, basin: str) -> None:
    if aoi.where(F.col("basin") == basin).isEmpty():
        raise BasinNotBurned(f"basin {basin} has no pixels on this dataset: rasterise it first")
