"""Generating zone layers: from one elevation and one land cover source to the layers of any number of datasets.

What is worked out on the source's own pixels, slope and aspect, is worked out once and kept for all targets; each target
then adds one aggregation over its own cells. Engines are functions from kept source pixels to cells, so another one can
be given in place of the standard two.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.errors import QueryError, SourceError
from firnline.functions.grid import ARRAYS, Grid, clipped, reprojected, require_aligned
from firnline.functions.names import tiles_covering
from firnline.operators import terrain as T
from firnline.sources.catalog import Dataset
from firnline.sources.ingest import require_absent_layers, write_layers
from firnline.sources.tables import exists

CELL = ("cell_row", "cell_col")
#: Engines by the source that they need: fine pixels of a target's cells to a row of layers for each cell.
Engine = Callable[[DataFrame], DataFrame]


def terrain_layers(cells: DataFrame) -> DataFrame:
    found = T.terrain_cells(cells, CELL)
    return found.select(*CELL, "elevation", "aspect", "northness", "eastness", "aspect_entropy")


def forest_layers(cells: DataFrame) -> DataFrame:
    return T.forest_cells(cells, CELL).select(*CELL, "forest_cover")


ENGINES: dict[str, Engine] = {"terrain": terrain_layers, "landcover": forest_layers}
#: Each engine's layers, with their type and what a cell without any source pixel has.
LAYERS: dict[str, dict[str, tuple[str, float]]] = {
    "terrain": {"elevation": ("double", T.ELEVATION_NODATA), "aspect": ("int", T.ASPECT_NODATA), "northness": ("double", T.COMPONENT_NODATA), "eastness": ("double", T.COMPONENT_NODATA), "aspect_entropy": ("double", T.ENTROPY_NODATA)},
    "landcover": {"forest_cover": ("int", T.FOREST_NODATA)},
}


def source_pixels(kind: str, fine: DataFrame, grid: Grid) -> DataFrame:
    """row, col, x, y of a source's pixels with what its engine needs: z, aspect, aspect_class, or nlcd."""
    x, y = grid.centre(F.col("row"), F.col("col"))
    if kind == "terrain":
        if grid.is_geographic:
            raise QueryError("slopes need an elevation source on a projected grid: warp it first")
        metres = grid.pixel * grid.unit_metres
        rows = T.slope_aspect(fine, metres, metres)
        return rows.select("row", "col", x.alias("x"), y.alias("y"), "z", "aspect", T.aspect_class(F.col("slope"), F.col("aspect")).alias("aspect_class"))
    return fine.select("row", "col", x.alias("x"), y.alias("y"), "nlcd")


def cells_of(pixels: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Source pixels with the target's cell that holds the centre of each."""
    x, y = reprojected(F.col("x"), F.col("y"), source.crs, target.crs)
    return T.to_cells(pixels.withColumns({"tx": x, "ty": y}), target, "tx", "ty")


def layers_on(target: Grid, parts: Mapping[str, DataFrame]) -> DataFrame:
    """row, col, pixel_id, tile_id of every pixel of the target, with the layers of each part and nodata where it has none."""
    out = target.frame(next(iter(parts.values())).sparkSession)
    for kind, cells in parts.items():
        renamed = cells.withColumnsRenamed({"cell_row": "row", "cell_col": "col"})
        out = out.join(renamed, ["row", "col"], "left")
        for name, (dtype, nodata) in LAYERS[kind].items():
            out = out.withColumn(name, F.coalesce(F.col(name).cast(dtype), F.lit(nodata).cast(dtype)))
    return out


def generate(sources: Mapping[str, tuple[DataFrame, Grid]], targets: Sequence[Dataset], force: bool = False, engines: Mapping[str, Engine] = ENGINES) -> None:
    """Write the zone layers of all targets from sources by kind (terrain: row, col, z; landcover: row, col, nlcd).

    Nothing is read when a target has layers and force is not given. Each source is read, and its slopes worked out, once.
    """
    if unknown := sorted(set(sources) - set(engines)) or not sources:
        raise QueryError(f"sources must be of {', '.join(sorted(engines))}" + (f", not {unknown}" if isinstance(unknown, list) else ""))
    spark = next(iter(sources.values()))[0].sparkSession
    for target in targets:
        require_absent_layers(spark, target.path, force)
    near = {kind: (_near(fine, grid, targets), grid) for kind, (fine, grid) in sources.items()}
    kept = {kind: source_pixels(kind, fine, grid).persist(StorageLevel.DISK_ONLY) for kind, (fine, grid) in near.items()}
    try:
        for target in targets:
            parts = {kind: engines[kind](cells_of(pixels, sources[kind][1], target.grid)) for kind, pixels in kept.items()}
            write_layers(layers_on(target.grid, parts), target.path, force)
    finally:
        for pixels in kept.values():
            pixels.unpersist()


def _near(fine: DataFrame, grid: Grid, targets: Sequence[Dataset]) -> DataFrame:
    """The source's pixels in the bounds of the targets, and one more on each side; all of them where projections differ."""
    if any(t.grid.crs != grid.crs for t in targets):
        return fine
    west, south, east, north = (pick(t.grid.extent[k] for t in targets) for k, pick in enumerate((min, min, max, max)))
    part = clipped(grid, west - grid.pixel, south - grid.pixel, east + grid.pixel, north + grid.pixel)
    row, col = round((grid.origin_y - part.origin_y) / grid.pixel), round((part.origin_x - grid.origin_x) / grid.pixel)
    return fine.where(F.col("row").between(row, row + part.rows - 1) & F.col("col").between(col, col + part.cols - 1))


def import_layers(layers: DataFrame, target: Dataset, force: bool = False) -> None:
    """Put zone layers that were made elsewhere (row, col and the layers) in force; they must fill the dataset's grid."""
    require_aligned(layers, target.grid)
    row, col = F.col("row"), F.col("col")
    write_layers(layers.withColumns({"pixel_id": target.grid.pixel_id(row, col), "tile_id": target.grid.tile_id(row, col)}), target.path, force)


def local_pixels(spark: SparkSession, path: str, value: str, dtype: str) -> DataFrame:
    """A source from a local Parquet table of row, col and a value."""
    if not exists(spark, path):
        raise SourceError(f"there is no source {path}")
    return spark.read.schema(f"row int, col int, `{value}` {dtype}").parquet(path)


def elevation_tiles(spark: SparkSession, folder: str, bounds: tuple[float, float, float, float], per_degree: int) -> tuple[DataFrame, Grid]:
    """A mosaic of those one-degree tiles of the bounds that are there, and its grid.

    Tiles are Parquet tables <tile>.parquet of row, col, z, from the north-west corner that the name gives. Tiles that
    are absent (sea, other countries) leave gaps; without any tile it is an error.
    """
    west, south, east, north = bounds
    wanted = [r.tile for r in tiles_covering(spark, west, south, east, north).collect()]  # one short row for each square degree
    there = [t for t in wanted if exists(spark, f"{folder}/{t}.parquet")]
    if not there:
        raise SourceError(f"there are no elevation tiles of {bounds} in {folder}")
    corner = {t: (int(t[1:3]), -int(t[4:])) for t in there}
    top, left = max(lat for lat, _ in corner.values()), min(lon for _, lon in corner.values())
    bottom, right = min(lat for lat, _ in corner.values()) - 1, max(lon for _, lon in corner.values()) + 1
    parts = [
        local_pixels(spark, f"{folder}/{t}.parquet", "z", "double").select((F.col("row") + (top - lat) * per_degree).alias("row"), (F.col("col") + (lon - left) * per_degree).alias("col"), "z")
        for t, (lat, lon) in corner.items()
    ]
    grid = Grid(float(left), float(top), 1.0 / per_degree, (right - left) * per_degree, (top - bottom) * per_degree)
    return reduce(DataFrame.unionByName, parts), grid


#: Source pixels along the edge of what a block of a warp reads, about, and places of a block that are projected along each side.
WARP, SAMPLES = 1024, 9


def _in_source(row: np.ndarray, col: np.ndarray, work: Grid, source: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Where the centres of a work grid's pixels stand among a source's pixel centres: row and column, with fractions."""
    x, y = reprojected(work.origin_x + (col + 0.5) * work.pixel, work.origin_y - (row + 0.5) * work.pixel, work.crs, source.crs, ARRAYS)
    return (source.origin_y - y) / source.pixel - 0.5, (x - source.origin_x) / source.pixel - 0.5


def block_edge(source: Grid, work: Grid, wanted: int = WARP) -> int:
    """How many work pixels along a block's edge read about so many source pixels, by the middle of the work grid."""
    row, col = np.array([work.rows / 2, work.rows / 2 + 1, work.rows / 2]), np.array([work.cols / 2, work.cols / 2, work.cols / 2 + 1])
    r, c = _in_source(row, col, work, source)
    ratio = max(np.hypot(r[1] - r[0], c[1] - c[0]), np.hypot(r[2] - r[0], c[2] - c[0]))
    return int(min(max(wanted / ratio, 16), 2 * wanted))


def _windows(source: Grid, work: Grid, edge: int):
    """work block, source block: those source blocks (of `edge` pixels) that a work block's interpolation reads from."""
    across = -(-work.cols // edge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, need = [], []
            for block in batch.column("block").to_pylist():
                top, left = block // across * edge, block % across * edge
                rows, cols = np.linspace(top, min(top + edge, work.rows) - 1, SAMPLES), np.linspace(left, min(left + edge, work.cols) - 1, SAMPLES)
                spans = []
                for place, most in zip(_in_source(*np.meshgrid(rows, cols, indexing="ij"), work, source), (source.rows, source.cols), strict=True):
                    bend = max(np.abs(np.diff(place, 2, axis=k)).max() for k in (0, 1))  # between the samples it is a quarter of that
                    low, high = max(math.floor(place.min() - bend) - 1, 0), min(math.ceil(place.max() + bend) + 1, most - 1)
                    spans.append(range(low // WARP, high // WARP + 1) if low <= high else range(0))
                pairs = [(block, r << 32 | c) for r in spans[0] for c in spans[1]]
                own += [p[0] for p in pairs]
                need += [p[1] for p in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(need, pa.int64())], ["block", "source"])

    return run


def warped(fine: DataFrame, source: Grid, work: Grid, value: str = "z", edge: int | None = None) -> DataFrame:
    """row, col, value on the pixels of a work grid, interpolated from the four source pixels about each; null without any.

    The work grid is cut into blocks. Each block's corners and sides, taken back to the source, tell which source blocks
    it reads; source pixels are sent once to each work block that reads theirs, and a task interpolates one block as
    arrays. Null and NaN count as missing; their weights go to the other neighbours.
    """
    edge = edge or block_edge(source, work)
    spark, across, down = fine.sparkSession, -(-work.cols // edge), -(-work.rows // edge)
    blocks = spark.range(across * down).select(F.col("id").alias("block"))
    reads = blocks.mapInArrow(_windows(source, work, edge), "block long, source long")
    own = fine.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value)")
    own = own.withColumn("source", F.shiftleft(F.floor(F.col("row") / WARP).cast("long"), 32).bitwiseOR(F.floor(F.col("col") / WARP).cast("long")))
    sent = own.join(reads, "source").select("block", "row", "col", "value")

    def run(key: tuple, block: pa.Table, pixels: pa.Table) -> pa.Table:
        number = key[0].as_py()
        top, left = number // across * edge, number % across * edge
        row, col = (x.ravel() for x in np.mgrid[top : min(top + edge, work.rows), left : min(left + edge, work.cols)])
        out = np.full(len(row), np.nan)
        if len(pixels):
            r, c, v = (pixels.column(k).to_numpy() for k in ("row", "col", "value"))
            r0, c0 = int(r.min()), int(c.min())
            area = np.full((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), np.nan)
            area[r - r0, c - c0] = v
            y, x = _in_source(row.astype(float), col.astype(float), work, source)
            i, j = np.floor(y), np.floor(x)
            v, u = y - i, x - j
            total, weight = np.zeros(len(row)), np.zeros(len(row))
            for di in (0, 1):
                for dj in (0, 1):
                    a, b = (i + di - r0).astype(np.int64), (j + dj - c0).astype(np.int64)
                    there = (a >= 0) & (a < area.shape[0]) & (b >= 0) & (b < area.shape[1])
                    found = np.where(there, area[np.where(there, a, 0), np.where(there, b, 0)], np.nan)
                    w = np.where(np.isnan(found), 0.0, (v if di else 1 - v) * (u if dj else 1 - u))
                    total += np.where(w > 0, w * np.nan_to_num(found), 0.0)
                    weight += w
            np.divide(total, weight, out=out, where=weight > 0)
        return pa.table({"row": row.astype(np.int32), "col": col.astype(np.int32), value: pa.array(out, pa.float64(), from_pandas=True)})

    return blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, f"row int, col int, `{value}` double")
