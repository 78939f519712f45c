"""Terrain and land cover: from fine pixels to zone layers on a dataset's grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.grid import Grid

#: Nodata codes of the layers, classes of forest in the land cover source.
ELEVATION_NODATA, COMPONENT_NODATA, ENTROPY_NODATA, ASPECT_NODATA, FOREST_NODATA = -9999.0, -9999.0, -1.0, 255, 255
FOREST_CLASSES = (41, 42, 43)
FLAT_DEGREES = 2.0
NORTH, EAST, SOUTH, WEST, FLAT = range(5)


#: Pixels along the edge of a block of the stencil.
BLOCK = 1024


def haloed_blocks(fine: DataFrame, block: int = BLOCK) -> DataFrame:
    """fine with _br, _bc: the block that each row is for. Pixels at a block's edge go to the blocks beside it as well.

    All others go to their own block only, so hardly more rows are moved than there are pixels.
    """
    steps = lambda c: F.when(F.pmod(F.col(c), F.lit(block)) == 0, F.array(F.lit(-1), F.lit(0))).when(F.pmod(F.col(c), F.lit(block)) == block - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    if block == 1:
        steps = lambda c: F.array(F.lit(-1), F.lit(0), F.lit(1))
    own = fine.withColumns({"_r": F.floor(F.col("row") / block).cast("int"), "_c": F.floor(F.col("col") / block).cast("int")})
    edge = lambda c: (F.pmod(F.col(c), F.lit(block)) == 0) | (F.pmod(F.col(c), F.lit(block)) == block - 1)
    at_edge = edge("row") | edge("col")
    inner = own.where(~at_edge).withColumns({"_br": F.col("_r"), "_bc": F.col("_c")})
    outer = own.where(at_edge).withColumn("_dr", F.explode(steps("row"))).withColumn("_dc", F.explode(steps("col")))
    outer = outer.withColumns({"_br": F.col("_r") + F.col("_dr"), "_bc": F.col("_c") + F.col("_dc")}).drop("_dr", "_dc")
    return inner.unionByName(outer).drop("_r", "_c")


def slope_aspect(fine: DataFrame, pixel_x: float, pixel_y: float, value: str = "z", by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """row, col, z, slope and aspect in degrees, by Horn's weights; null where one of the nine values is missing.

    Aspect is the direction that the ground falls to, clockwise from north. Pixels meet in square blocks with a rim of
    one pixel around them, and the stencil runs over a block as an array.
    """
    good = F.when(~F.isnan(value) & (F.abs(F.col(value)) != float("inf")), F.col(value).cast("double"))
    rows = fine.select(*by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), good.alias("z"))
    keys = {c: t for c, t in fine.dtypes if c in by}
    schema = "".join(f"`{c}` {keys[c]}, " for c in by) + "row int, col int, z double, slope double, aspect double"

    def run(group: pa.Table) -> pa.Table:
        row, col = (group.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        top, left = group.column("_br")[0].as_py() * block, group.column("_bc")[0].as_py() * block
        area = np.full((block + 2, block + 2), np.nan)
        area[row - top + 1, col - left + 1] = group.column("z").to_numpy(zero_copy_only=False)
        n = {(i, j): area[i : i + block, j : j + block] for i in range(3) for j in range(3)}
        dx = ((n[0, 2] + 2 * n[1, 2] + n[2, 2]) - (n[0, 0] + 2 * n[1, 0] + n[2, 0])) / (8 * pixel_x)
        dy = ((n[2, 0] + 2 * n[2, 1] + n[2, 2]) - (n[0, 0] + 2 * n[0, 1] + n[0, 2])) / (8 * pixel_y)
        dx[np.isnan(n[1, 1])] = np.nan
        own = np.flatnonzero((row >= top) & (row < top + block) & (col >= left) & (col < left + block))
        i, j = row[own] - top, col[own] - left
        dx, dy = dx[i, j], dy[i, j]
        slope, aspect = np.degrees(np.arctan(np.hypot(dx, dy))), np.degrees(np.arctan2(-dx, dy)) % 360.0  # the gradient's north part is -dy
        aspect[aspect == 360.0] = 0.0  # a negative turn too small to tell from none
        found = group.take(pa.array(own))
        out = [found.column(c) for c in (*by, "row", "col", "z")] + [pa.array(x, from_pandas=True) for x in (slope, aspect)]
        return pa.Table.from_arrays(out, names=[*by, "row", "col", "z", "slope", "aspect"])

    return haloed_blocks(rows, block).groupBy(*by, "_br", "_bc").applyInArrow(run, schema)


def aspect_class(slope: Column, aspect: Column, flat: float = FLAT_DEGREES) -> Column:
    """0 north, 1 east, 2 south, 3 west, 4 flat, -1 without a slope."""
    quarter = F.pmod(F.floor((aspect + 45) / 90), F.lit(4))
    return F.when(slope.isNull() | aspect.isNull(), -1).when(slope < flat, FLAT).otherwise(quarter).cast("int")


def to_cells(fine: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """fine with cell_row, cell_col of the grid's cell that holds each pixel's centre; those outside are left out."""
    row, col = grid.cell(F.col(x), F.col(y))
    return fine.withColumns({"cell_row": row, "cell_col": col}).where(F.col("cell_row").isNotNull() & F.col("cell_col").isNotNull())


def terrain_cells(fine: DataFrame, keys: Sequence[str] = ("cell_row", "cell_col")) -> DataFrame:
    """Per cell: counts n0 to n4 by class, total, elevation, majority, northness, eastness, entropy.

    fine has z, aspect (degrees) and aspect_class; pixels of class -1 count for nothing.
    """
    cls = F.col("aspect_class")
    sloped = (cls >= 0) & (cls != FLAT)
    counted = fine.groupBy(*keys).agg(
        *[F.count_if(cls == k).alias(f"n{k}") for k in range(5)], F.sum(F.when(cls >= 0, F.col("z"))).alias("sum_z"),
        F.sum(F.when(sloped, F.cos(F.radians("aspect")))).alias("sum_cos"), F.sum(F.when(sloped, F.sin(F.radians("aspect")))).alias("sum_sin"),
    )
    return finished_terrain(counted, keys)


def finished_terrain(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The layers of counted cells, with the nodata codes where a cell has nothing."""
    counts = F.array(*[F.col(f"n{k}") for k in range(5)])
    total = F.expr(" + ".join(f"n{k}" for k in range(5)))
    rising = total - F.col("n4")
    mean = lambda s, n, nodata: F.when(n > 0, F.col(s) / n).otherwise(F.lit(nodata))
    return counted.select(
        *keys, *[f"n{k}" for k in range(5)], total.alias("total"), mean("sum_z", total, ELEVATION_NODATA).alias("elevation"), F.when(total > 0, majority(counts)).otherwise(ASPECT_NODATA).cast("int").alias("aspect"),
        mean("sum_cos", rising, COMPONENT_NODATA).alias("northness"), mean("sum_sin", rising, COMPONENT_NODATA).alias("eastness"), F.when(total > 0, entropy(counts)).otherwise(F.lit(ENTROPY_NODATA)).alias("aspect_entropy"),
    )


def majority(counts: Column) -> Column:
    """The place of the largest count, the first of equals."""
    return (F.array_position(counts, F.array_max(counts)) - 1).cast("int")


def entropy(counts: Column, classes: int = 5) -> Column:
    """Shannon entropy of the counts as a share of the largest possible."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + n)
    return F.aggregate(counts, F.lit(0.0), lambda s, n: s + F.when(n > 0, -(n / total) * F.log(n / total)).otherwise(0.0)) / math.log(classes)


def forest_cells(fine: DataFrame, keys: Sequence[str] = ("cell_row", "cell_col"), source_nodata: int = 0, value: str = "nlcd") -> DataFrame:
    """Per cell: forest, valid and forest_cover, the percentage rounded half to even, 255 where nothing is valid."""
    v = F.col(value)
    valid = v.isNotNull() & ~v.isin(0, source_nodata)
    counted = fine.groupBy(*keys).agg(F.count_if(valid & v.isin(*FOREST_CLASSES)).alias("forest"), F.count_if(valid).alias("valid"))
    return counted.select(*keys, "forest", "valid", percent_forest(F.col("forest"), F.col("valid")).alias("forest_cover"))


def percent_forest(forest: Column, valid: Column) -> Column:
    return F.when(valid > 0, F.rint(forest * 100.0 / F.nullif(valid, F.lit(0)))).otherwise(F.lit(float(FOREST_NODATA))).cast("int")


def resampled(fine: DataFrame, grid: Grid, target: DataFrame, value: str = "z") -> DataFrame:
    """target (row, col, x, y) with value interpolated from the four fine pixels about each place.

    Weights of missing neighbours go to the others; a place with none of them has null. fine: row, col, value on grid.
    """
    fx, fy = (F.col("x") - grid.origin_x) / grid.pixel - 0.5, (F.lit(grid.origin_y) - F.col("y")) / grid.pixel - 0.5
    placed = target.withColumns({"_c": F.floor(fx), "_r": F.floor(fy), "_u": fx - F.floor(fx), "_v": fy - F.floor(fy)})
    corners = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (0, 1) for dc in (0, 1)])
    each = placed.withColumn("_k", F.explode(corners))
    weight = F.when(F.col("_k.dr") == 1, F.col("_v")).otherwise(1 - F.col("_v")) * F.when(F.col("_k.dc") == 1, F.col("_u")).otherwise(1 - F.col("_u"))
    each = each.select("row", "col", "x", "y", (F.col("_r") + F.col("_k.dr")).alias("_row"), (F.col("_c") + F.col("_k.dc")).alias("_col"), weight.alias("_w"))
    source = fine.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias("_value"))
    summed = each.join(source, ["_row", "_col"], "left").groupBy("row", "col", "x", "y").agg(F.sum(F.when(F.col("_value").isNotNull(), F.col("_w") * F.col("_value"))).alias("_s"), F.sum(F.when(F.col("_value").isNotNull(), F.col("_w"))).alias("_n"))
    return summed.select("row", "col", "x", "y", (F.col("_s") / F.nullif(F.col("_n"), F.lit(0.0))).alias(value))
