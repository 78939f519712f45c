"""Observations as tile arrays: equal to rows, kept beside the commits that they are of, and joined without a shuffle of pixels."""

import datetime as dt
from dataclasses import replace
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.functions.dates import DateRange
from firnline.functions.grid import Grid
from firnline.plans import tiles as A
from firnline.plans import zonal as Z
from firnline.sources import ingest as I
from firnline.sources.catalog import TEMPLATES, Catalogue
from firnline.sources.snapshots import Snapshot, vacuum

GRID = Grid(-120.0, 45.0, 0.01, 11, 7, 4)  # tiles at the edges are cut
DAYS = [dt.date(2020, 1, d) for d in (1, 2, 3)]
VARIABLES = [Z.Variable("swe", "mm", 1, "mean", -9999), Z.Variable("depth", "mm", 100, "total", -9999)]
LONG = "date date, variable string, tile_id int, pixel_id long, value double"


@pytest.fixture(scope="module")
def values(spark):
    """Wide observations with pixels, values and a whole tile that are not there."""
    rng = np.random.default_rng(3)
    tile = lambda p: (p // 11 // 4) * 3 + p % 11 // 4
    rows = [(d, tile(p), p, *[int(rng.integers(-5, 99)) if rng.random() < 0.7 else [None, -9999][int(rng.integers(2))] for _ in "ab"]) for d in DAYS for p in range(77) if rng.random() < 0.6 and not (tile(p) == 2 and d == DAYS[0])]
    return spark.createDataFrame(rows, "date date, tile_id int, pixel_id long, swe int, depth int").cache()


def at():
    return GRID.position(F.col("pixel_id"))


def rounded(frame):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in frame.collect())


def test_arrays_and_back(spark, values):
    tiles = A.pack(values, at(), ["swe", "depth"])
    assert tiles.count() == values.select("date", "tile_id").distinct().count()
    expected = values.where("swe is not null or depth is not null").select("date", "tile_id", at().alias("position"), "swe", "depth")
    key = lambda frame: sorted(map(str, frame.collect()))
    assert key(A.unpack(tiles, ["swe", "depth"])) == key(expected) and dict(tiles.dtypes)["swe"] == "array<int>"
    assert all(len(r.swe) == len(r.depth) <= 16 for r in tiles.collect())
    assert A.pack(values.limit(0), at(), ["swe"]).count() == 0
    with pytest.raises(Exception, match="two rows on a date"):
        A.pack(values.limit(1).unionByName(values.limit(1)), at(), ["swe"]).collect()


def test_reductions_are_those_of_rows(spark, values):
    geometry = GRID.frame(spark).where("pixel_id % 5 <> 0").select(F.when(F.col("row") < 4, "a").otherwise("b").alias("basin"), "pixel_id", "tile_id", (F.col("row") + 1.0).cast("float").alias("area_m2"), (F.col("col") % 3).cast("int").alias("cell"))
    geometry = geometry.unionByName(geometry.where("basin = 'a'").withColumn("basin", F.lit("c")))  # basins that overlap
    tiles = A.pack(values, at(), ["swe", "depth"])
    assert rounded(A.tile_reductions(tiles, geometry, VARIABLES, at())) == rounded(Z.reductions(values, geometry, VARIABLES))
    axes = {"aoi": geometry.drop("cell"), "zone_pixels": None, "dates": DateRange(DAYS[1]), "variables": VARIABLES}
    assert rounded(Z.zonal_stats(tiles, reduction=partial(A.tile_reductions, position=at()), **axes).rows) == rounded(Z.zonal_stats(values, **axes).rows)


def test_a_large_geometry_shuffles_tiles_not_pixels(spark, values, tmp_path):
    A.pack(values, at(), ["swe", "depth"]).write.parquet(str(tmp_path / "tiles"))
    geometry = GRID.frame(spark).select(F.lit("a").alias("basin"), "pixel_id", "tile_id", F.lit(1.0).cast("float").alias("area_m2"), F.lit(0).alias("cell"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.tile_reductions(spark.read.parquet(str(tmp_path / "tiles")), geometry, VARIABLES, at())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    depth = lambda word: next(i for i, line in enumerate(lines) if word in line)
    assert depth("Generate inline") < depth("SortMergeJoin") and "Python" not in plan  # pixels come out above the join
    between = lines[depth("Generate inline") : depth("SortMergeJoin")]
    assert not any("Exchange" in line for line in between) and "partial_sum" in "".join(lines[: depth("Generate inline")])


def test_a_catalogue_reads_packed_dates(spark, tmp_path, values):
    catalogue = Catalogue.initialise(spark, str(tmp_path))
    base = TEMPLATES["snodas"]
    demo = catalogue.register(replace(base, name="demo", grid=GRID, variables={k: base.variables[k] for k in ("swe", "depth")}))
    long = A.unpack(A.pack(values, at(), ["swe", "depth"]), ["swe", "depth"])
    pixel = (F.floor(F.col("tile_id") / 3) * 4 + F.floor(F.col("position") / 4)) * 11 + F.col("tile_id") % 3 * 4 + F.col("position") % 4
    each = [long.select("date", F.lit(v).alias("variable"), "tile_id", pixel.cast("long").alias("pixel_id"), F.col(v).cast("double").alias("value")) for v in ("swe", "depth")]
    rows = each[0].unionByName(each[1]).where("value is not null").cache()

    def take(days, tag):
        plan = spark.createDataFrame([(d, f"v1:{tag}", "write") for d in days], "date date, source_hash string, action string")
        I.commit(rows.where(F.col("date").isin(*days)).withColumn("value", F.col("value") + len(tag)), plan, ["depth", "swe"], demo.path, types={"depth": "smallint", "swe": "smallint"})

    GRID.frame(spark).where("row between 1 and 5").select(F.lit("1:MT:USGS").alias("basin"), "pixel_id", "tile_id", F.lit(3.0).cast("float").alias("area_m2"), F.lit("v1:x").alias("burn_hash")).write.parquet(f"{demo.path}/aoi_pixels")
    GRID.frame(spark).select("pixel_id", "tile_id", F.lit(300.0).alias("elevation"), F.when(F.col("col") < 5, 80).otherwise(10).alias("forest_cover")).write.parquet(f"{demo.path}/zone_pixels")
    ask = lambda dates=DateRange(): catalogue.zonal_stats("demo", "1:MT:USGS", dates, ["swe", "depth"], ["landcover.forest_cover"]).rows
    reads_arrays = lambda frame: any("/packed/commit=" in f for f in frame.inputFiles())

    take(DAYS[:2], "a")
    plain = rounded(ask())
    catalogue.pack("demo", DateRange(DAYS[1]))
    assert not reads_arrays(ask()) and reads_arrays(ask(DateRange(DAYS[1])))  # one of the dates has no arrays yet
    catalogue.pack("demo")
    assert reads_arrays(ask()) and rounded(ask()) == plain and rounded(ask(DateRange(DAYS[1]))) == [r for r in plain if r[1] == DAYS[1]]
    take(DAYS[1:], "abc")  # a date is replaced: its arrays are of another commit
    assert not reads_arrays(ask())
    fresh = rounded(ask())
    catalogue.pack("demo")
    assert reads_arrays(ask()) and rounded(ask()) == fresh and fresh != plain
    vacuum(spark, demo.path, kept=0)
    assert len(list((tmp_path / "data/demo/packed").glob("commit=*/date=*"))) == 3 and rounded(ask()) == fresh
    assert Snapshot.current(spark, demo.path).packed(DateRange(dt.date(2030, 1, 1))) is None
