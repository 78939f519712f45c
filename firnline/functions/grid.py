"""Grids: pixels, tiles, places and areas as Column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.errors import QueryError, SourceError

#: WGS84 ellipsoid and the sphere of the MODIS sinusoidal projection.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
MODIS_RADIUS = 6371007.181


@dataclass(frozen=True)
class Grid:
    """A north-up grid: its north-west corner, pixel size, extent in pixels, and tiles."""

    origin_x: float
    origin_y: float
    pixel: float
    cols: int
    rows: int
    tile: int = 256
    crs: str = "EPSG:4326"
    unit_metres: float = 1.0

    @property
    def tile_cols(self) -> int:
        return -(-self.cols // self.tile)

    @property
    def tile_rows(self) -> int:
        return -(-self.rows // self.tile)

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """west, south, east, north"""
        return (self.origin_x, self.origin_y - self.rows * self.pixel, self.origin_x + self.cols * self.pixel, self.origin_y)

    @property
    def is_geographic(self) -> bool:
        return self.crs in ("EPSG:4326", "EPSG:4269")

    @property
    def has_projection(self) -> bool:
        """Whether places of the grid can be computed from longitude and latitude."""
        return self.crs in GEOGRAPHIC or self.crs == ALBERS_CRS or self.crs.startswith(SINUSOIDAL_CRS)

    def bounds_in_degrees(self, spark: SparkSession, steps: int = 64) -> tuple[float, float, float, float]:
        """west, south, east, north of the grid's sides in longitude and latitude; sides are bent there, so many places of each count."""
        if self.crs in GEOGRAPHIC:
            return self.extent
        w, s, e, n = self.extent
        at = F.col("id") / steps
        x, y = F.lit(w) + at * (e - w), F.lit(s) + at * (n - s)
        sides = [(x, F.lit(s)), (x, F.lit(n)), (F.lit(w), y), (F.lit(e), y)]
        each = spark.range(steps + 1).select(F.explode(F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in sides])).alias("p"))
        lon, lat = reprojected(F.col("p.x"), F.col("p.y"), self.crs, GEOGRAPHIC[0])
        return tuple(each.select(lon.alias("lon"), lat.alias("lat")).agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first())

    def pixel_id(self, row: Column, col: Column) -> Column:
        return (row.cast("long") * self.cols + col).cast("long")

    def row_of(self, pixel_id: Column) -> Column:
        return F.floor(pixel_id / self.cols).cast("int")

    def col_of(self, pixel_id: Column) -> Column:
        return F.pmod(pixel_id, F.lit(self.cols)).cast("int")

    def tile_id(self, row: Column, col: Column) -> Column:
        return (F.floor(row / self.tile) * self.tile_cols + F.floor(col / self.tile)).cast("int")

    def position(self, pixel_id: Column) -> Column:
        """A pixel's place in its tile, row by row."""
        row, col = self.row_of(pixel_id), self.col_of(pixel_id)
        return (F.pmod(row, F.lit(self.tile)) * self.tile + F.pmod(col, F.lit(self.tile))).cast("int")

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        """x and y of a pixel's centre."""
        return F.lit(self.origin_x) + (col + 0.5) * self.pixel, F.lit(self.origin_y) - (row + 0.5) * self.pixel

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column of the pixel that holds a place; null outside the grid."""
        col, row = F.floor((x - self.origin_x) / self.pixel), F.floor((F.lit(self.origin_y) - y) / self.pixel)
        inside = (col >= 0) & (col < self.cols) & (row >= 0) & (row < self.rows)
        return F.when(inside, row).cast("int"), F.when(inside, col).cast("int")

    def bounding_tiles(self, west: Column, south: Column, east: Column, north: Column) -> Column:
        """The tiles that bounds touch, as struct(ul_row, ul_col, br_row, br_col), clamped to the grid; null if they touch none.

        An edge that lies on a tile's border does not take in the tile beyond.
        """
        size = self.tile * self.pixel
        left, top = F.floor((west - self.origin_x) / size), F.floor((F.lit(self.origin_y) - north) / size)
        right, bottom = F.ceil((east - self.origin_x) / size) - 1, F.ceil((F.lit(self.origin_y) - south) / size) - 1
        w, s, e, n = self.extent
        touches = (west < e) & (east > w) & (south < n) & (north > s)
        clamp = lambda x, most: F.least(F.greatest(x, F.lit(0)), F.lit(most)).cast("int")
        return F.when(touches, F.struct(clamp(top, self.tile_rows - 1).alias("ul_row"), clamp(left, self.tile_cols - 1).alias("ul_col"), clamp(bottom, self.tile_rows - 1).alias("br_row"), clamp(right, self.tile_cols - 1).alias("br_col")))

    def tiles_in(self, window: Column) -> Column:
        """Tile ids of a tile window, as an array in row-major order."""
        rows, cols = F.sequence(window["ul_row"], window["br_row"]), F.sequence(window["ul_col"], window["br_col"])
        return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: (r * self.tile_cols + c).cast("int"))))

    def cell_area(self, row: Column) -> Column:
        """Square metres of a pixel in this row: on the ellipsoid for geographic grids, the same everywhere for others."""
        if not self.is_geographic:
            return F.lit((self.pixel * self.unit_metres) ** 2)
        north = F.radians(F.lit(self.origin_y) - row * self.pixel)
        south = F.radians(F.lit(self.origin_y) - (row + 1) * self.pixel)
        return F.abs(ellipsoid_strip(north) - ellipsoid_strip(south)) * math.radians(self.pixel)

    def frame(self, spark: SparkSession) -> DataFrame:
        """Every pixel of the grid: row, col, pixel_id, tile_id."""
        both = spark.range(self.rows * self.cols).withColumnRenamed("id", "pixel_id").select(self.row_of(F.col("pixel_id")).alias("row"), self.col_of(F.col("pixel_id")).alias("col"), "pixel_id")
        return both.withColumn("tile_id", self.tile_id(F.col("row"), F.col("col")))


def ellipsoid_strip(lat: Column, a: float = WGS84_A, f: float = WGS84_F) -> Column:
    """Area on the ellipsoid between the equator and latitude `lat` (radians), per radian of longitude."""
    b, e = a * (1 - f), math.sqrt(f * (2 - f))
    s = F.sin(lat)
    return F.lit(b * b / 2) * (s / (1 - e * e * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e))


def window_tag(window: Column) -> Column:
    """A tile window as text: four integers."""
    return F.concat_ws(" ", *[window[k].cast("string") for k in ("ul_row", "ul_col", "br_row", "br_col")])


def window_of_tag(tag: Column) -> Column:
    """The tile window of a text; null where it is not four integers."""
    part = F.split(F.trim(tag), r"\s+")
    good = tag.rlike(r"^\s*\d+(\s+\d+){3}\s*$")
    return F.when(good, F.struct(*[F.get(part, F.lit(i)).cast("int").alias(k) for i, k in enumerate(("ul_row", "ul_col", "br_row", "br_col"))]))


def place_offset(window: Column, row: Column, col: Column, tile: int) -> tuple[Column, Column]:
    """Row and column within a tile window's array."""
    return row - window["ul_row"] * tile, col - window["ul_col"] * tile


#: The functions that projections need, for arrays in place of columns.
ARRAYS = SimpleNamespace(sin=np.sin, cos=np.cos, sqrt=np.sqrt, log=np.log, asin=np.arcsin, atan2=np.arctan2, radians=np.radians, degrees=np.degrees, lit=lambda x: x)


def sinusoidal(lon: Column, lat: Column, radius: float = MODIS_RADIUS, m: Any = F) -> tuple[Column, Column]:
    """x, y of degrees in the MODIS sinusoidal projection."""
    phi = m.radians(lat)
    return m.lit(radius) * m.radians(lon) * m.cos(phi), m.lit(radius) * phi


def sinusoidal_inverse(x: Column, y: Column, radius: float = MODIS_RADIUS, m: Any = F) -> tuple[Column, Column]:
    phi = y / radius
    return m.degrees(x / (m.lit(radius) * m.cos(phi))), m.degrees(phi)


@dataclass(frozen=True)
class Albers:
    """Albers equal-area conic on an ellipsoid; the defaults are those of EPSG:5070."""

    parallel_1: float = 29.5
    parallel_2: float = 45.5
    lat_0: float = 23.0
    lon_0: float = -96.0
    a: float = GRS80_A
    f: float = GRS80_F

    @property
    def _e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    def _q(self, phi: float) -> float:
        e, s = self._e, math.sin(phi)
        return (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def _m(self, phi: float) -> float:
        s = math.sin(phi)
        return math.cos(phi) / math.sqrt(1 - (self._e * s) ** 2)

    def _constants(self) -> tuple[float, float, float]:
        p1, p2, p0 = (math.radians(x) for x in (self.parallel_1, self.parallel_2, self.lat_0))
        n = (self._m(p1) ** 2 - self._m(p2) ** 2) / (self._q(p2) - self._q(p1))
        c = self._m(p1) ** 2 + n * self._q(p1)
        return n, c, self.a * math.sqrt(c - n * self._q(p0)) / n

    def forward(self, lon: Column, lat: Column, m: Any = F) -> tuple[Column, Column]:
        n, c, rho_0 = self._constants()
        e, s = self._e, m.sin(m.radians(lat))
        q = m.lit(1 - e * e) * (s / (1 - e * e * s * s) - m.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho, theta = m.sqrt(m.lit(c) - n * q) * (self.a / n), m.radians(lon - self.lon_0) * n
        return rho * m.sin(theta), m.lit(rho_0) - rho * m.cos(theta)

    def inverse(self, x: Column, y: Column, m: Any = F) -> tuple[Column, Column]:
        n, c, rho_0 = self._constants()
        e, dy = self._e, m.lit(rho_0) - y
        q = (m.lit(c) - (x * x + dy * dy) * (n * n / (self.a * self.a))) / n
        phi = m.asin(q / 2)

        def closer(phi: Column) -> Column:
            s = m.sin(phi)
            d = 1 - e * e * s * s
            return phi + d * d / (2 * m.cos(phi)) * (q / (1 - e * e) - s / d + m.log((1 - e * s) / (1 + e * s)) / (2 * e))

        # of a column each step would repeat all before it
        once = (lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))) if m is F else (lambda value, use: use(value))
        phi = reduce(lambda p, _: once(p, closer), range(3), phi)
        return m.degrees(m.atan2(x, dy) / n) + self.lon_0, m.degrees(phi)


SINUSOIDAL_CRS, ALBERS_CRS, GEOGRAPHIC = "+proj=sinu", "EPSG:5070", ("EPSG:4326", "EPSG:4269")


def reprojected(x: Column, y: Column, source: str, target: str, m: Any = F) -> tuple[Column, Column]:
    """A place of one projection in another, over longitude and latitude; the two geographic datums count as one. m: ARRAYS for arrays."""
    if source == target or source in GEOGRAPHIC and target in GEOGRAPHIC:
        return x, y
    lonlat = {ALBERS_CRS: lambda: Albers().inverse(x, y, m), SINUSOIDAL_CRS: lambda: sinusoidal_inverse(x, y, m=m)}
    placed = {ALBERS_CRS: lambda lon, lat: Albers().forward(lon, lat, m), SINUSOIDAL_CRS: lambda lon, lat: sinusoidal(lon, lat, m=m)}
    kind = lambda crs: SINUSOIDAL_CRS if crs.startswith(SINUSOIDAL_CRS) else crs
    for crs in (source, target):
        if crs not in GEOGRAPHIC and kind(crs) not in placed:
            raise QueryError(f"{crs} is none of the projections that can be computed here")
    lon, lat = (x, y) if source in GEOGRAPHIC else lonlat[kind(source)]()
    return (lon, lat) if target in GEOGRAPHIC else placed[kind(target)](lon, lat)


def combined_extent(grids: DataFrame) -> DataFrame:
    """The bounds of all grids of rows origin_x, origin_y, pixel, cols, rows."""
    east, south = F.col("origin_x") + F.col("cols") * F.col("pixel"), F.col("origin_y") - F.col("rows") * F.col("pixel")
    return grids.agg(F.min("origin_x").alias("west"), F.min(south).alias("south"), F.max(east).alias("east"), F.max("origin_y").alias("north"))


def clipped(grid: Grid, west: float, south: float, east: float, north: float) -> Grid:
    """The part of a grid on the same lattice that covers the bounds."""
    left, top = max(0, math.floor((west - grid.origin_x) / grid.pixel)), max(0, math.floor((grid.origin_y - north) / grid.pixel))
    right, bottom = min(grid.cols, math.ceil((east - grid.origin_x) / grid.pixel)), min(grid.rows, math.ceil((grid.origin_y - south) / grid.pixel))
    if right <= left or bottom <= top:
        raise QueryError("the bounds lie outside the grid")
    return Grid(grid.origin_x + left * grid.pixel, grid.origin_y - top * grid.pixel, grid.pixel, right - left, bottom - top, grid.tile, grid.crs, grid.unit_metres)


def require_aligned(pixels: DataFrame, grid: Grid) -> None:
    """Raise unless pixels (row, col) are exactly those of the grid."""
    found = pixels.agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    if tuple(found) != (grid.rows * grid.cols, 0, grid.rows - 1, 0, grid.cols - 1):
        raise SourceError(f"pixels don't fill the grid of {grid.rows} x {grid.cols}: {found.n} of rows {found.r0} to {found.r1}, columns {found.c0} to {found.c1}")


def close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * relative, F.lit(absolute))
