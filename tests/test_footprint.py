"""Basins on projected grids, footprints as unions of polygons, masks: against ray casting and sampling, and end to end."""

import datetime as dt
import json
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.functions import grid as G
from firnline.functions.dates import DateRange
from firnline.operators import basins as B
from firnline.operators import footprint as P
from firnline.sources.basins import BasinStore
from firnline.sources.catalog import TEMPLATES, Catalogue, modis_tile

SQUARE = lambda x, y, s: [[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]]


def basin(spark, *named):
    return spark.createDataFrame([(name, [[[float(x), float(y)] for x, y in ring] for ring in rings]) for name, rings in named], "triplet string, rings array<array<array<double>>>")


def outline(spark, polygons, eps=1e-9):
    return P.outline(P.polygon_edges(spark, polygons), P.band_height(polygons), eps)


def length(edges):
    return sum(math.hypot(e.x2 - e.x1, e.y2 - e.y1) for e in edges.collect())


def test_outlines_of_unions(spark):
    assert length(outline(spark, [SQUARE(0, 0, 2), SQUARE(2, 0, 2)])) == pytest.approx(12)  # beside each other
    assert length(outline(spark, [SQUARE(0, 0, 2), SQUARE(1, 1, 2)])) == pytest.approx(12)  # one over the other
    assert length(outline(spark, [SQUARE(0, 0, 4), SQUARE(1, 1, 1)])) == pytest.approx(16)  # within
    assert length(outline(spark, [SQUARE(0, 0, 2), SQUARE(0, 0, 2)])) == pytest.approx(8)  # the same twice
    ring = [SQUARE(i, j, 1) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    assert length(outline(spark, ring)) == pytest.approx(16)
    assert length(outline(spark, [SQUARE(0, 0, 2), SQUARE(2 + 1e-10, 0.5, 1)])) == pytest.approx(10, abs=1e-6)  # a gap of rounding
    assert length(outline(spark, [[SQUARE(0, 0, 4)[0], SQUARE(1, 1, 2)[0]]])) == pytest.approx(24)  # a hole of its own


def states(spark, polygons, *named):
    band = P.band_height(polygons)
    return {r.triplet: r.coverage for r in P.covered(B.edges(basin(spark, *named)), outline(spark, polygons), band, 1e-9).collect()}


def test_coverage_by_a_union_with_a_gap(spark):
    ring = [SQUARE(i, j, 1) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    cases = {
        "whole": (SQUARE(0, 0, 3), "partial"), "corner": (SQUARE(0, 0, 1), "full"), "over tiles": (SQUARE(0.5, 0.1, 0.8), "full"), "in the gap": (SQUARE(1.2, 1.2, 0.5), "none"), "fills the gap": (SQUARE(1, 1, 1), "partial"),
        "out": (SQUARE(5, 5, 1), "none"), "touches": (SQUARE(3, 1, 1), "partial"), "larger": (SQUARE(-1, -1, 9), "partial"), "around the gap": ([SQUARE(0.2, 0.2, 2.6)[0], SQUARE(0.9, 0.9, 1.2)[0]], "full"), "over the side": (SQUARE(2.5, 0.5, 1), "partial"),
    }
    assert states(spark, ring, *((name, rings) for name, (rings, _) in cases.items())) == {name: state for name, (_, state) in cases.items()}


def test_coverage_agrees_with_sampling(spark):
    rng = random.Random(11)
    at = lambda r: [rng.uniform(-r, r), rng.uniform(-r, r)]
    ring = lambda: (lambda p: [[*p, p[0]]])([at(3) for _ in range(3)])
    polygons = [ring() for _ in range(5)]
    named = [(str(k), (lambda c, s: [[[c[0], c[1]], [c[0] + s, c[1] + 0.2 * s], [c[0] + 0.3 * s, c[1] + s], [c[0], c[1]]]])(at(3), rng.choice([0.2, 0.6, 2.0]))) for k in range(60)]

    def inside(rings, x, y):
        hit = np.zeros(x.shape, bool)
        for r in rings:
            for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False):
                if y1 != y2:
                    hit ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        return hit

    got = states(spark, polygons, *named)
    for name, rings in named:
        xs, ys = zip(*rings[0], strict=True)
        x, y = np.meshgrid(np.linspace(min(xs), max(xs), 300), np.linspace(min(ys), max(ys), 300))
        own = inside(rings, x, y)
        served = np.logical_or.reduce([inside(p, x, y) for p in polygons])[own]
        want = "full" if served.all() else "partial" if served.any() else "none"
        share = served.mean()
        assert got[name] == want or got[name] == "partial" and (share > 0.999 or share < 0.001)
    assert set(got.values()) == {"full", "partial", "none"}


@pytest.mark.parametrize("crs,bound", [(G.ALBERS_CRS, 5.0), ("+proj=sinu +R=6371007.181 +units=m", 20.0)])
def test_projected_edges_stay_near_the_bent_line(spark, crs, bound):
    rows = B.placed_edges(basin(spark, ("a", [[[-124, 40], [-108, 41], [-110, 47], [-124, 40]]])), crs, bound)
    lon, lat = G.reprojected((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, crs, "EPSG:4326")
    # the middle of each chord lies on one of the three straight lines in degrees, to within the bound
    off = []
    for r in rows.select(lon.alias("x"), lat.alias("y")).collect():
        lines = [((-124, 40), (-108, 41)), ((-108, 41), (-110, 47)), ((-110, 47), (-124, 40))]
        k = math.cos(math.radians(r.y))
        off.append(min(k * abs((bx - ax) * (r.y - ay) - (by - ay) * (r.x - ax)) / math.hypot(k * (bx - ax), by - ay) for (ax, ay), (bx, by) in lines))
    assert max(off) * 111_200 <= 1.02 * bound and len(off) > 30
    assert B.placed_edges(basin(spark, ("a", SQUARE(-110, 40, 1))), crs, None).count() == 4


def record(triplet, rings):
    return json.dumps({"type": "GeometryCollection", "id": triplet, "properties": {"name": triplet}, "geometries": [{"type": "Point", "coordinates": rings[0][0]}, {"type": "Polygon", "coordinates": rings}]})


def test_a_dataset_on_sinusoidal_tiles_end_to_end(spark, tmp_path):
    """Coverage, burning, a mask that makes pixels stale, and statistics on the built-in grid of 463 m pixels."""
    catalogue = Catalogue.initialise(spark, str(tmp_path))
    tiles = catalogue.create("instarr")
    assert tiles.footprint == TEMPLATES["instarr"].footprint == [modis_tile(h, v) for h in (8, 9, 10) for v in (4, 5) if (h, v) != (10, 5)]
    store, dataset = BasinStore(spark, f"{tmp_path}/pourpoints"), Catalogue.open(spark, str(tmp_path))["instarr"]
    texts = [("1:CO:USGS", SQUARE(-106.5, 39.0, 0.1)), ("2:TX:USGS", SQUARE(-90.0, 32.0, 0.1)), ("3:ME:USGS", SQUARE(-68.0, 45.0, 0.1)), ("4:NM:USGS", SQUARE(-104.5, 38.5, 3.0))]
    store.import_(spark.createDataFrame([(f"{k}.geojson", record(*t)) for k, t in enumerate(texts)], "path string, json string"), [dataset])
    assert {r.triplet[0]: r.coverage["instarr"] for r in store.index.read().collect()} == {"1": "full", "2": "none", "3": "none", "4": "partial"}
    outcome = lambda: {r.triplet[0]: r.action for r in store.rasterise(dataset).collect()}
    assert outcome() == {"1": "burn", "2": "outside", "3": "outside", "4": "burn"}
    burned = store.pixels(dataset).read().where("basin = '1:CO:USGS'")
    x, y = dataset.grid.centre(F.col("row"), F.col("col"))
    lon, lat = G.sinusoidal_inverse(x, y)
    box = burned.select(lon.alias("lon"), lat.alias("lat")).agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat"), F.count("lon")).first()
    pixel = 463.3127 / 111_195
    assert -106.5 < box[0] < box[1] < -106.4 and 39.0 < box[2] < box[3] < 39.1
    assert box[4] * 463.3127**2 == pytest.approx((0.1 * 111_195) ** 2 * math.cos(math.radians(39.05)), rel=0.01) and box[3] - box[2] > 0.1 - 2 * pixel
    area = burned.agg(F.sum("area_m2")).first()[0]

    spark.createDataFrame([("snow_fraction", "v1:a", dt.date(2020, 4, 1))], "variable string, source_hash string, date date").write.partitionBy("date").parquet(f"{dataset.path}/manifest")
    burned.select(F.lit(dt.date(2020, 4, 1)).alias("date"), "tile_id", "pixel_id", F.when(F.col("row") % 2 == 0, 40).otherwise(60).cast("short").alias("snow_fraction")).write.partitionBy("date").parquet(f"{dataset.path}/observations")
    rows = catalogue.zonal_stats("instarr", "1:CO:USGS", DateRange(), ["snow_fraction"], index=store.index.read()).rows.collect()
    assert rows[0].area_m2 == pytest.approx(area) and 45 < rows[0].mean_snow_fraction_percent < 55

    from firnline.sources.tables import Table

    assert outcome()["1"] == "current"
    Table(spark, f"{dataset.path}/mask", "pixel_id long").replace(burned.where("row % 2 = 0").select("pixel_id"))
    assert outcome()["1"] == "burn" and outcome()["1"] == "current"
    rows = catalogue.zonal_stats("instarr", "1:CO:USGS", DateRange(), ["snow_fraction"], index=store.index.read()).rows.collect()
    assert rows[0].mean_snow_fraction_percent == pytest.approx(40) and rows[0].area_m2 < 0.6 * area


def test_bounds_of_a_projected_grid_in_degrees(spark):
    west, south, east, north = TEMPLATES["instarr"].grid.bounds_in_degrees(spark)
    assert north == pytest.approx(50) and south == pytest.approx(30) and west == pytest.approx(-100 / math.cos(math.radians(50)), rel=1e-6) and east == pytest.approx(-70 / math.cos(math.radians(30)), rel=1e-6)
    assert replace(TEMPLATES["snodas"].grid).bounds_in_degrees(spark) == TEMPLATES["snodas"].grid.extent


def cast(ring, lon, lat):
    """Ray casting in longitude and latitude."""
    hit = np.zeros(lon.shape, bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if y1 != y2:
            hit ^= ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
    return hit


@pytest.mark.parametrize("grid", [G.Grid(-2.25e6, 3.0e6, 10_000.0, 190, 160, 32, G.ALBERS_CRS), G.Grid(-10.6e6, 5.15e6, 10_000.0, 250, 140, 32, G.SINUSOIDAL_CRS)])
def test_edges_close_by_centres_part_them_as_in_degrees(spark, grid):
    """Sides pass centres at a few millionths of a pixel, far nearer than chords of a thousandth would keep apart."""
    rng = random.Random(3)
    row, col = np.divmod(np.arange(grid.rows * grid.cols), grid.cols)
    x, y = grid.origin_x + (col + 0.5) * grid.pixel, grid.origin_y - (row + 0.5) * grid.pixel
    lon, lat = G.reprojected(x, y, grid.crs, "EPSG:4326", G.ARRAYS)
    named = []
    for k in range(40):
        p = rng.randrange(len(lon))
        angle, at, size, off = rng.uniform(0, 2 * math.pi), rng.uniform(0.05, 0.95), rng.choice([0.5, 2.0, 8.0]), rng.choice([-3e-7, 3e-7])
        dx, dy = math.cos(angle), math.sin(angle)
        px, py = lon[p] - dy * off, lat[p] + dx * off
        a, b = (px - at * size * dx, py - at * size * dy), (px + (1 - at) * size * dx, py + (1 - at) * size * dy)
        named.append((str(k), [[a, b, (px - dy * size, py + dx * size), a]]))
    named.append(("long", [[(-124, 40), (-108, 41), (-110, 47), (-124, 40)]]))
    named.append(("hole", [SQUARE(-112, 36, 6)[0], SQUARE(-110, 38, 2)[0]]))
    got = {name: set() for name, _ in named}
    for r in B.burned(basin(spark, *named), grid, bend=1e-6).select("basin", "pixel_id").collect():
        got[r.basin].add(r.pixel_id)
    for name, rings in named:
        assert got[name] == set(np.flatnonzero(np.logical_xor.reduce([cast(r, lon, lat) for r in rings])).tolist())
    assert sum(map(len, got.values())) > 5_000


def test_a_small_bend_costs_few_pieces(spark):
    """Rows that burning makes on its way: edges are cut finely only where a centre is close by."""

    def generated(node):
        below = [node.children().apply(k) for k in range(node.children().size())]
        return sum(map(generated, below)) + (node.metrics().apply("numOutputRows").value() if node.nodeName() == "Generate" else 0)

    named = [(str(k), [[(x - 1.0, y - 0.8), (x + 1.2, y - 0.5), (x + 0.1, y + 0.9), (x - 1.0, y - 0.8)]]) for k in range(50) for x, y in [(-120 + k / 10, 40 + k / 20)]]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = B.burned(basin(spark, *named), G.Grid(-2.25e6, 3.0e6, 10_000.0, 100, 120, 32, G.ALBERS_CRS), bend=1e-6).select("basin", "pixel_id")
        made = len(rows.collect())
        assert generated(rows._jdf.queryExecution().executedPlan()) - made < 50 * 300
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
