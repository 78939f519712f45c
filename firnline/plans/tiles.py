"""Observations as tile arrays: one row for a date and tile, with an array by position in the tile for each variable.

The zonal query of such rows joins them with a basin's pixels of the tile, also one row, and looks each pixel up in the
arrays by its position. What is joined, and shuffled where the geometry is too large to be broadcast, is a row for each
tile and date; pixels come out of the arrays only within a task, where the sums of cells take them in at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.plans.zonal import Variable, reduced


def pack(observations: DataFrame, position: Column, variables: Sequence[str]) -> DataFrame:
    """date, tile_id and an array for each variable from wide observations: null where the tile has no value.

    position: of a pixel in its tile, from 0; two rows of one pixel are an error. A tile has a bounded number of pixels,
    so its arrays are built in one place. An array ends with the tile's last pixel that has a row.
    """
    types = dict(observations.dtypes)
    held = observations.select("date", "tile_id", F.struct(position.cast("int").alias("_at"), *variables).alias("_e"))
    tiles = held.groupBy("date", "tile_id").agg(F.array_sort(F.collect_list("_e")).alias("_es"))

    def dense(v: str) -> Column:
        def part(e: Column, i: Column) -> Column:
            gap = e["_at"] - F.coalesce(F.get(F.col("_es"), i - 1)["_at"], F.lit(-1)) - 1
            checked = F.when(gap < 0, F.raise_error(F.lit("a pixel has two rows on a date")).cast("int")).otherwise(gap)
            return F.concat(F.array_repeat(F.lit(None).cast(types[v]), checked), F.array(e[v]))

        return F.flatten(F.transform("_es", part)).alias(v)

    return tiles.select("date", "tile_id", *[dense(v) for v in variables])


def unpack(tiles: DataFrame, variables: Sequence[str]) -> DataFrame:
    """date, tile_id, position, variables of tile arrays: a row for each pixel that has a value."""
    each = tiles.select("date", "tile_id", F.posexplode(F.arrays_zip(*variables)).alias("position", "_e"))
    return each.select("date", "tile_id", "position", *[F.col("_e")[v].alias(v) for v in variables]).where(F.coalesce(*variables).isNotNull())


def tile_reductions(tiles: DataFrame, geometry: DataFrame, variables: Sequence[Variable], position: Column) -> DataFrame:
    """What `reductions` gives, from tile arrays. geometry has basin, tile_id, pixel_id, area_m2, cell."""
    columns = list(dict.fromkeys(v.column or v.key for v in variables))
    pixel = F.struct(position.cast("int").alias("at"), "cell", "area_m2")
    ground = geometry.groupBy("basin", "tile_id").agg(F.collect_list(pixel).alias("_ps"))  # no more than a tile has
    joined = tiles.select("date", "tile_id", *columns).join(ground, "tile_id")
    looked_up = F.transform("_ps", lambda p: F.struct(p["cell"].alias("cell"), p["area_m2"].alias("area_m2"), *[F.get(F.col(c), p["at"]).alias(c) for c in columns]))
    return reduced(joined.select("basin", "date", F.inline(looked_up)), variables)
