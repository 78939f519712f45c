"""The catalogue: a root configuration, its datasets, and their tables.

A dataset is a folder of Parquet tables: observations (partitioned by date), zone_pixels, aoi_pixels, manifest. Nothing
of it is inferred from data: grid, variables and zone settings come from the configuration.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.errors import ExistsError, QueryError, UnknownDataset
from firnline.functions.dates import DateQuery
from firnline.functions.grid import Grid
from firnline.functions.names import is_path
from firnline.functions.zones import STANDARD_LAYERS, Layer, parse_selection, resolve_axis
from firnline.operators.basins import BEND, Box, coverage, grid_edges, require_coverage
from firnline.operators.footprint import band_height, covered, outline, polygon_edges
from firnline.plans.tiles import tile_reductions
from firnline.plans.zonal import MAX_CELLS, Variable, ZonalResult, choose_variables, reductions, require_burned, require_cell_count, require_complete, zonal_stats
from firnline.sources.snapshots import Snapshot
from firnline.sources.tables import Table, stored


#: Rings of places in the grid's coordinates.
Polygon = Sequence[Sequence[Sequence[float]]]


@dataclass(frozen=True)
class Dataset:
    name: str
    grid: Grid
    variables: Mapping[str, Variable]
    zones: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    boxes: Sequence[Box] = ()
    holes: Sequence[Box] = ()
    footprint: Sequence[Polygon] = ()
    active: bool = True
    path: str = ""
    ingester: str = ""

    @property
    def domain(self) -> Sequence[Box]:
        """What the dataset serves without a footprint: its declared boxes, else its grid; in the grid's coordinates."""
        return self.boxes or (self.grid.extent,)

    def coverage(self, basins: DataFrame, key: str = "triplet") -> DataFrame:
        """key, coverage of basins in longitude and latitude by the footprint, if the dataset has one, else by its domain."""
        if not self.footprint:
            return coverage(basins, self.domain, self.holes, key, self.grid)
        spark, band, eps = basins.sparkSession, band_height(self.footprint), self.grid.pixel * 1e-6
        found = covered(grid_edges(basins, self.grid, key, BEND), outline(polygon_edges(spark, self.footprint), band, eps), band, eps, key)
        return basins.select(key).distinct().join(found, key, "left").select(key, F.coalesce("coverage", F.lit("none")).alias("coverage"))

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table of the dataset: manifest and observations of the snapshot in force, all else by its own version."""
        if name in ("manifest", "observations"):
            snapshot = self.snapshot(spark)
            return snapshot.manifest() if name == "manifest" else snapshot.observations()
        return stored(spark, f"{self.path}/{name}")

    def snapshot(self, spark: SparkSession) -> Snapshot:
        """The state of the dataset's dates that is in force, which does not change whatever is committed later."""
        return Snapshot.current(spark, self.path)

    def mask(self, spark: SparkSession) -> DataFrame | None:
        """pixel_id of the valid ground; None where all of it is."""
        table = Table(spark, f"{self.path}/mask", "pixel_id long")
        return table.read() if table.versions() else None

    def layers(self) -> dict[str, Layer]:
        """The zone layers that the dataset enables."""
        return {k: v for k, v in STANDARD_LAYERS.items() if k in self.zones}


def mask_digest(mask: DataFrame | None) -> str:
    """What tells masks apart: their number of pixels and a sum of hashes; nothing for no mask."""
    if mask is None:
        return ""
    return "{n} {s}".format(**mask.select("pixel_id").distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("pixel_id").cast("decimal(38,0)")).alias("s")).first().asDict())


_MM, _MM100, _KELVIN, _KG = ("mm", 1), ("mm", 100), ("k", 10), ("kg_per_m2", 10)
_ALL_ZONES: dict[str, dict[str, float]] = {k: {} for k in STANDARD_LAYERS}
_SINUSOIDAL = "+proj=sinu +R=6371007.181 +units=m"
_MODIS_TILE = 1111950.5197665233


def _snodas() -> Dataset:
    units = {"precip_solid": _KG, "precip_liquid": _KG, "swe": _MM, "depth": _MM, "average_temp": _KELVIN, "sublimation": _MM100, "sublimation_blowing": _MM100, "runoff": _MM100}
    pixel = 1 / 120
    return Dataset("snodas", Grid(-124.73333333333333, 52.875, pixel, 6935, 3351, 256), {k: Variable(k, u, s, nodata=-9999) for k, (u, s) in units.items()}, _ALL_ZONES, ingester="snodas")


def _swann() -> Dataset:
    return Dataset("swann-800m", Grid(-125.0208, 49.9375, 0.008333325, 7025, 3105, 256, "EPSG:4269"), {k: Variable(k, "mm", nodata=-999) for k in ("swe", "depth")}, _ALL_ZONES, ingester="swann")


def modis_tile(h: int, v: int) -> list[list[list[float]]]:
    """A tile of the sinusoidal tiling as a polygon, in metres."""
    west, south, size = (h - 18) * _MODIS_TILE, (8 - v) * _MODIS_TILE, _MODIS_TILE
    return [[[west, south], [west + size, south], [west + size, south + size], [west, south + size], [west, south]]]


def _instarr() -> Dataset:
    bytes_ = {k: "percent" for k in ("snow_fraction", "viewable_snow_fraction", "albedo_dirty_flat", "albedo_dirty_terrain_corrected", "deltavis")}
    words = {"grain_size": "um", "dust_concentration": "ppm", "snow_cover_duration": "day", "radiative_forcing": "w_per_m2"}
    variables = {k: Variable(k, u, nodata=255, dtype="smallint") for k, u in bytes_.items()} | {k: Variable(k, u, nodata=65535, dtype="int") for k, u in words.items()}
    west, north = (8 - 18) * _MODIS_TILE, (9 - 4) * _MODIS_TILE
    grid = Grid(west, north, _MODIS_TILE / 2400, 7200, 4800, 512, _SINUSOIDAL)
    return Dataset("instarr", grid, variables, _ALL_ZONES, footprint=[modis_tile(h, v) for h in (8, 9, 10) for v in (4, 5) if (h, v) != (10, 5)], ingester="instarr")


#: The three built-in datasets.
TEMPLATES = {d.name: d for d in (_snodas(), _swann(), _instarr())}


class Catalogue:
    """Datasets by name, kept as one JSON file; Spark reads and writes it, so it may lie in any store."""

    def __init__(self, spark: SparkSession, path: str, datasets: Mapping[str, Dataset] | None = None):
        self.spark, self.path, self.datasets = spark, path, dict(datasets or {})

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalogue:
        text = "\n".join(r[0] for r in spark.read.text(f"{path}/catalogue", wholetext=True).collect())
        return cls(spark, path, {k: dataset_of(v) for k, v in json.loads(text).items()})

    @classmethod
    def initialise(cls, spark: SparkSession, path: str) -> Catalogue:
        """Open the catalogue, or begin one where there is none."""
        try:
            return cls.open(spark, path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out = cls(spark, path)
            out.save()
            return out

    def save(self) -> None:
        text = json.dumps({k: asdict(v) for k, v in sorted(self.datasets.items())})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/catalogue")

    def register(self, dataset: Dataset, replace_it: bool = False) -> Dataset:
        if is_path(dataset.name):
            raise QueryError(f"{dataset.name!r} reads as a path: it can't be a dataset's name")
        if dataset.name in self.datasets and not replace_it:
            raise ExistsError(f"there is a dataset {dataset.name} already")
        placed = dataset if dataset.path else replace(dataset, path=f"{self.path}/data/{dataset.name}")
        self.datasets[dataset.name] = placed
        self.save()
        return placed

    def create(self, template: str, name: str | None = None, mask: DataFrame | None = None) -> Dataset:
        """A new active dataset, with the pixel_ids of its valid ground where a mask is given."""
        return self._new(template, name, True, mask)

    def stage(self, template: str, name: str | None = None, mask: DataFrame | None = None) -> Dataset:
        """A new dataset that is not active yet, with the pixel_ids of its valid ground where a mask is given."""
        return self._new(template, name, False, mask)

    def _new(self, template: str, name: str | None, active: bool, mask: DataFrame | None) -> Dataset:
        if template not in TEMPLATES:
            raise UnknownDataset(f"there is no template {template}; there are {', '.join(sorted(TEMPLATES))}")
        dataset = self.register(replace(TEMPLATES[template], name=name or template, active=active))
        if mask is not None:
            Table(self.spark, f"{dataset.path}/mask", "pixel_id long").replace(mask.select(F.col("pixel_id").cast("long")).distinct())
        return dataset

    def mask(self, name: str) -> DataFrame | None:
        """pixel_id of a dataset's valid ground; None where all of it is."""
        return self.registered(name).mask(self.spark)

    def set_active(self, name: str, active: bool) -> None:
        self.datasets[name] = replace(self.registered(name), active=active)
        self.save()

    def registered(self, name: str) -> Dataset:
        if name not in self.datasets:
            raise UnknownDataset(f"there is no dataset {name}; there are {', '.join(sorted(self.datasets)) or 'none'}")
        return self.datasets[name]

    def resolve(self, token: str) -> Dataset:
        """The dataset of a name, or of the JSON file that a path names."""
        if not is_path(token):
            return self.registered(token)
        return dataset_of(json.loads("\n".join(r[0] for r in self.spark.read.text(token, wholetext=True).collect())))

    def __getitem__(self, name: str) -> Dataset:
        found = self.registered(name)
        if not found.active:
            raise UnknownDataset(f"dataset {name} is not active")
        return found

    def active(self) -> list[str]:
        return sorted(k for k, v in self.datasets.items() if v.active)

    def views(self, name: str) -> list[str]:
        """Temporary views of a dataset's tables, for SQL."""
        dataset, made = self[name], []
        for table in ("observations", "zone_pixels", "aoi_pixels"):
            view = f"{name.replace('-', '_')}_{table}"
            dataset.table(self.spark, table).createOrReplaceTempView(view)
            made.append(view)
        return made

    def pack(self, name: str, dates: DateQuery | None = None) -> None:
        """Keep a dataset's dates as tile arrays too: zonal queries of packed dates read those."""
        dataset = self.registered(name)
        dataset.snapshot(self.spark).pack(dataset.grid.position(F.col("pixel_id")), dates)

    def zonal_stats(self, name: str, basin: str, dates: DateQuery, variables: Sequence[str], zones: Sequence[str] = (), index: DataFrame | None = None, allow_partial: bool = False, include_empty: bool = False, max_cells: int = MAX_CELLS) -> ZonalResult:
        """The query of one basin. Errors come in this order: dataset, coverage, zones, variables, pixels, dates, cells."""
        dataset = self[name]
        if index is not None:
            entry = index.where(F.col("triplet") == basin).select(F.col("coverage")[name].alias("c")).first()
            require_coverage(entry["c"] if entry else None, basin, name, allow_partial)
        layers = dataset.layers()
        selections = [parse_selection(z, layers) for z in zones]
        chosen = choose_variables(variables, dataset.variables)
        aoi = dataset.table(self.spark, "aoi_pixels").where(F.col("basin") == basin)
        require_burned(aoi, basin)
        snapshot = dataset.snapshot(self.spark)  # dates and pixels of one state
        listing = snapshot.manifest().select("date", "variable")
        require_complete(listing, [v.key for v in chosen], dates)
        axes = [resolve_axis(s, dataset.zones, layers) for s in selections]
        require_cell_count(axes, max_cells)
        packed = snapshot.packed(dates)
        observations = snapshot.observations(dates) if packed is None else packed
        reduction = reductions if packed is None else partial(tile_reductions, position=dataset.grid.position(F.col("pixel_id")))
        tiles = aoi.select("tile_id").distinct()  # no more than the grid has tiles
        listed = sorted(r[0] for r in tiles.limit(1001).collect())
        if len(listed) <= 1000:  # few enough for a list that the scan can prune row groups by
            observations = observations.where(F.col("tile_id").isin(*listed))
        else:
            observations = observations.join(F.broadcast(tiles), "tile_id", "left_semi")
        zone_pixels = dataset.table(self.spark, "zone_pixels") if axes else None
        available = listing.where(F.col("variable").isin(*[v.key for v in chosen])).select("date").distinct()
        return zonal_stats(observations, aoi, zone_pixels, dates, chosen, axes, available=available, include_empty=include_empty, max_cells=max_cells, reduction=reduction)


def dataset_of(values: Mapping[str, Any]) -> Dataset:
    """A dataset from its JSON form."""
    variables = {k: Variable(**v) for k, v in values["variables"].items()}
    unknown = sorted(set(values["zones"]) - set(STANDARD_LAYERS))
    if unknown:
        raise QueryError(f"dataset {values['name']} has unknown zone layers: {', '.join(unknown)}")
    boxes = lambda key: [tuple(b) for b in values[key]]
    return Dataset(values["name"], Grid(**values["grid"]), variables, values["zones"], boxes("boxes"), boxes("holes"), values.get("footprint", ()), values["active"], values["path"], values.get("ingester", ""))
