"""Terrain, basins, names, grids, diagnostics, catalogue and ingest."""

import datetime as dt
import gzip
import io
import hashlib
import json
import struct
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.errors import QueryError, CoverageError, ExistsError, SourceError, UnknownDataset
from firnline.functions import names as N
from firnline.functions.dates import DateRange
from firnline.functions.grid import Albers, Grid, sinusoidal, sinusoidal_inverse
from firnline.operators import basins as B
from firnline.operators import diagnostics as D
from firnline.operators import generate as L
from firnline.operators import terrain as T
from firnline.sources import ingest as I
from firnline.sources.catalog import TEMPLATES, Catalogue

GRID = Grid(-120.0, 45.0, 0.01, 64, 64, 16)


def surface(spark, z):
    return spark.createDataFrame([(r, c, float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])], "row int, col int, z double")


def test_a_ramp_that_rises_eastward_faces_west(spark):
    z = np.tile(np.arange(12) * 10.0, (10, 1))
    out = T.slope_aspect(surface(spark, z), 10, 10).collect()
    inner = [r for r in out if 0 < r.row < 9 and 0 < r.col < 11]
    assert len(inner) == 80 and all(abs(r.slope - 45) < 1e-9 and abs(r.aspect - 270) < 1e-9 for r in inner)
    assert all(r.slope is None for r in out if r.row in (0, 9) or r.col in (0, 11))


def test_the_stencil_agrees_with_numpy_over_any_blocks(spark):
    z = np.random.default_rng(3).normal(size=(9, 11)) * 30
    a, b, c, d, f, g, h, i = (z[1 + dr : 8 + dr, 1 + dc : 10 + dc] for dr, dc in ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)))
    dx, dy = ((c + 2 * f + i) - (a + 2 * d + g)) / 80, ((g + 2 * h + i) - (a + 2 * b + c)) / 80
    slope = np.degrees(np.arctan(np.hypot(dx, dy)))
    for block in (1, 2, 4, 1024):
        rows = T.slope_aspect(surface(spark, z), 10, 10, block=block).collect()
        got = {(r.row, r.col): r.slope for r in rows if r.slope is not None}
        assert len(rows) == 99 and len({(r.row, r.col) for r in rows}) == 99
        assert len(got) == 63 and all(abs(got[r + 1, c + 1] - slope[r, c]) < 1e-9 for r in range(7) for c in range(9))


def test_aspect_classes(spark):
    rows = spark.createDataFrame([(10.0, 314.9), (10.0, 315.0), (10.0, 44.9), (10.0, 45.0), (10.0, 180.0), (1.0, 90.0), (None, None)], "slope double, aspect double")
    assert [r[0] for r in rows.select(T.aspect_class(F.col("slope"), F.col("aspect"))).collect()] == [3, 0, 0, 1, 2, 4, -1]


def test_cells_of_terrain_and_forest(spark):
    fine = spark.createDataFrame([(0, 100.0, 0.0, 0), (0, 200.0, 90.0, 1), (1, 50.0, 0.0, 4), (2, 9.0, 0.0, -1)], "cell int, z double, aspect double, aspect_class int")
    out = {r.cell: r for r in T.terrain_cells(fine, ["cell"]).collect()}
    assert out[0].aspect == 0 and out[0].elevation == 150.0 and abs(out[0].aspect_entropy - math.log(2) / math.log(5)) < 1e-12
    assert out[1].northness == -9999 and out[1].aspect_entropy == 0.0
    assert (out[2].aspect, out[2].elevation, out[2].aspect_entropy) == (255, -9999.0, -1.0)
    land = spark.createDataFrame([(0, 42), (0, 81), (0, 81), (0, 81), (0, 81), (0, 81), (0, 81), (0, 81), (1, 0)], "cell int, nlcd int")
    assert {r.cell: r.forest_cover for r in T.forest_cells(land, ["cell"]).collect()} == {0: 12, 1: 255}  # 12.5 to even


def test_bilinear_of_a_plane_is_the_plane(spark):
    grid = Grid(0.0, 8.0, 1.0, 8, 8)
    z = np.add.outer(np.arange(8) * 2.0, np.arange(8) * 3.0)
    target = spark.createDataFrame([(0, 0, 2.25, 5.5), (0, 1, 4.0, 3.1)], "row int, col int, x double, y double")
    got = {r.col: r.z for r in T.resampled(surface(spark, z), grid, target).collect()}
    assert abs(got[0] - (2 * 2.0 + 3 * 1.75)) < 1e-9 and abs(got[1] - (2 * 4.4 + 3 * 3.5)) < 1e-9


@pytest.mark.parametrize("crs,origin,pixel", [("EPSG:5070", (-1_120_000.0, 2_050_000.0), 3000.0), ("+proj=sinu +R=6371007.181 +units=m", (-9_260_000.0, 4_560_000.0), 2500.0), ("EPSG:4326", (-108.99, 40.93), 0.031)])
@pytest.mark.parametrize("edge", [None, 7])
def test_a_warp_by_blocks_is_the_plain_one(spark, monkeypatch, crs, origin, pixel, edge):
    """Equal to interpolating each place by joins, with gaps in the source and a work grid that reaches beyond it."""
    from firnline.functions.grid import reprojected

    monkeypatch.setattr(L, "WARP", 13)
    rng = np.random.default_rng(2)
    source, work = Grid(-109.0, 41.0, 0.02, 60, 50), Grid(*origin, pixel, 40, 37, 8, crs)
    z = rng.normal(size=(50, 60))
    fine = surface(spark, np.where(rng.random(z.shape) < 0.1, np.nan, z)).where("not isnan(z)")
    x, y = reprojected(*work.centre(F.col("row"), F.col("col")), work.crs, source.crs)
    plain = {(r.row, r.col): r.z for r in T.resampled(fine, source, work.frame(spark).select("row", "col", x.alias("x"), y.alias("y"))).collect()}
    got = {(r.row, r.col): r.z for r in L.warped(fine, source, work, edge=edge).collect()}
    assert got.keys() == plain.keys() and sum(v is None for v in got.values()) > 0 and sum(v is not None for v in got.values()) > 200
    assert all((a is None) == (got[k] is None) and (a is None or abs(a - got[k]) < 1e-9) for k, a in plain.items())


def basin(spark, *rings, triplet="12345:MT:USGS"):
    return spark.createDataFrame([(triplet, [[list(map(float, p)) for p in ring] for ring in rings])], "triplet string, rings array<array<array<double>>>")


def test_burning_a_rectangle_with_a_hole(spark):
    box = [(-119.9, 44.9), (-119.8, 44.9), (-119.8, 44.8), (-119.9, 44.8), (-119.9, 44.9)]
    hole = [(-119.87, 44.87), (-119.83, 44.87), (-119.83, 44.83), (-119.87, 44.83), (-119.87, 44.87)]
    pixels = B.burned(basin(spark, box, hole), GRID).collect()
    assert {(r.row, r.col) for r in pixels} == {(r, c) for r in range(10, 20) for c in range(10, 20)} - {(r, c) for r in range(13, 17) for c in range(13, 17)}
    assert all(abs(r.area_m2 - 0.01**2 * 111_132 * 78_847) / r.area_m2 < 0.01 for r in pixels)


def test_burning_agrees_with_ray_casting(spark):
    rng = np.random.default_rng(5)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 17))
    ring = [(-119.7 + 0.2 * (0.4 + 0.6 * rng.random()) * math.cos(a), 44.7 + 0.2 * (0.4 + 0.6 * rng.random()) * math.sin(a)) for a in angle]
    ring.append(ring[0])

    def inside(x, y):
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False)) % 2 == 1

    expected = {(r, c) for r in range(64) for c in range(64) if inside(-120 + (c + 0.5) * 0.01, 45 - (r + 0.5) * 0.01)}
    assert {(r.row, r.col) for r in B.burned(basin(spark, ring), GRID).collect()} == expected


def test_coverage_by_a_box_and_by_an_l_shape(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    state = lambda ring, boxes, holes=(): B.coverage(basin(spark, ring), boxes, holes).first().coverage
    one = [(0.0, 0.0, 10.0, 10.0)]
    assert [state(square(*s), one) for s in ((0, 0, 10), (1, 1, 2), (9, 9, 2), (20, 20, 1), (-5, -5, 30))] == ["full", "full", "partial", "none", "partial"]
    ell = [(0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 20.0, 10.0), (0.0, 10.0, 10.0, 20.0)]
    assert state(square(8, 2, 4), ell, [(10.0, 10.0, 20.0, 20.0)]) == "full"
    assert state(square(8, 8, 4), ell, [(10.0, 10.0, 20.0, 20.0)]) == "partial"
    B.require_coverage("partial", "b", "d", True)
    for bad in ("partial", "none", None):
        with pytest.raises(CoverageError):
            B.require_coverage(bad, "b", "d")


def test_geodesic_area_of_a_degree_cell(spark):
    area = B.geodesic_area(basin(spark, [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])).first().area_meters
    grid = Grid(0.0, 1.0, 1.0, 1, 1)
    cell = spark.range(1).select(grid.cell_area(F.lit(0)).alias("a")).first().a
    assert abs(area - cell) / cell < 1e-6 and abs(area - 12308778361.469) / area < 1e-4


def test_areas_of_all_rows_add_up_to_the_ellipsoid(spark):
    grid = Grid(-180.0, 90.0, 1.0, 360, 180)
    total = spark.range(180).select(F.sum(grid.cell_area(F.col("id")) * 360)).first()[0]
    assert abs(total - 5.10065621724089e14) / total < 1e-9


def test_projections_come_back(spark):
    rows = spark.createDataFrame([(-105.0, 40.0), (-120.5, 48.25), (-96.0, 23.0)], "lon double, lat double")
    for forward, inverse in ((Albers().forward, Albers().inverse), (sinusoidal, sinusoidal_inverse)):
        x, y = forward(F.col("lon"), F.col("lat"))
        lon, lat = inverse(F.col("x"), F.col("y"))
        for r in rows.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", "x", "y", lon.alias("lon2"), lat.alias("lat2")).collect():
            assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9
    corners = spark.createDataFrame([(k, -105.0 + dx, 40.0 + dy) for k, (dx, dy) in enumerate(((0, 0), (0.01, 0), (0.01, 0.01), (0, 0.01)))], "k int, lon double, lat double")
    x, y = Albers().forward(F.col("lon"), F.col("lat"))
    p = [(r.x, r.y) for r in corners.select("k", x.alias("x"), y.alias("y")).orderBy("k").collect()]
    area = abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True))) / 2
    cell = spark.range(1).select(Grid(-105.0, 40.01, 0.01, 1, 1).cell_area(F.lit(0)).alias("a")).first().a
    assert abs(area - cell) / cell < 1e-5  # the projection keeps areas


def test_records_index_and_pages(spark):
    point, polygon = {"type": "Point", "coordinates": [-119.45, 44.45]}, {"type": "Polygon", "coordinates": [[[-119.9, 44.0], [-119.0, 44.0], [-119.0, 44.9], [-119.9, 44.9], [-119.9, 44.0]]]}
    good = {"type": "GeometryCollection", "id": "12345:MT:USGS", "properties": {"name": "A"}, "geometries": [point, polygon]}
    texts = [good, {"type": "Feature", "id": "2:MT:USGS", "properties": {"nwccname": "B"}, "geometry": point}, {**good, "id": "bad"}, {**good, "properties": {}}, {**good, "geometries": [point]}, "junk", None]
    rows = spark.createDataFrame([(str(i), t if t is None or isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "path string, json string")
    parsed = B.parse_records(rows)
    assert [r.status for r in parsed.orderBy("path").collect()] == ["import", "skipped", "invalid", "invalid", "invalid", "invalid", "invalid"]
    covered = B.coverage(parsed.where("status = 'import'"), [GRID.extent])
    index = B.build_index(parsed, {"demo": covered})
    entry = index.first()
    assert entry.coverage == {"demo": "partial"} and entry.area_meters > 7e9 and len(entry.geometry_hash) == 64
    again = B.build_index(parsed, {"demo": covered}, index)
    assert again.collect() == index.collect()
    page, total = B.page(index, 0, 10, (-120, 44, -119, 45))
    assert total == 1 and page.count() == 1
    assert B.folded_coverage(index, "other", covered.limit(0)).first().coverage == {"demo": "partial", "other": "none"}
    assert json.loads(B.feature_json(index).first().feature)["geometry"]["coordinates"] == [-119.45, 44.45]


def test_file_names(spark):
    stems = ["us_ssmv11034SlL00T0001TTNATS2018042705HP001", "us_ssmv01025SlL01T0024TTNATS2018042705DP001", "us_ssmv19999SlL00T0001TTNATS2018042705HP001", "us_ssmv11034SlL00T0001TTNATS2018133705HP001", "junk"]
    got = N.snodas_names(spark.createDataFrame([(i, s) for i, s in enumerate(stems)], "i int, stem string")).orderBy("i").collect()
    assert [r["product"] for r in got] == ["swe", "precip_solid", None, "swe", None] and got[0].date == dt.date(2018, 4, 27) and got[3].date is None
    problems = N.snodas_problems(N.snodas_names(spark.createDataFrame([("a", stems[0])], "archive string, stem string")))
    with pytest.raises(SourceError):
        N.require_sound(problems)
    assert [r[0] for r in N.tiles_covering(spark, -106.5, 39.2, -105.0, 40.0).collect()] == ["n40w106", "n40w107"]
    import re

    assert re.match(N.glob_pattern("*__swe.t[!x]f"), "a__swe.tif") and not re.match(N.glob_pattern("*__swe.tif"), "a__viewable_swe_tif")


def test_health_and_missing_dates(spark):
    days = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 2, 5)], "date date")
    assert [r.date.day for r in D.missing_dates(days, end=dt.date(2020, 1, 7)).orderBy("date").collect()] == [3, 4, 6, 7]
    manifest = spark.createDataFrame([("terrain", "v1:x"), ("landcover", "old")], "artifact string, tag string")
    found = D.health({"files": lambda: D.artifact_findings(manifest, "demo", {"terrain": 2, "landcover": 1, "aoi": 1})})
    assert [(r.target, r.issue) for r in found.collect()] == [("aoi", "missing"), ("landcover", "stale format (stored none, current 1)"), ("terrain", "stale format (stored 1, current 2)")]
    stored = spark.createDataFrame([("ok", -120.0, 45.0, 0.01, 64, 64, "EPSG:4326"), ("off", -120.1, 45.0, 0.01, 64, 64, "EPSG:4326")], "target string, origin_x double, origin_y double, pixel double, cols int, rows int, crs string")
    assert [r.target for r in D.grid_findings(stored, "demo", -120.0, 45.0, 0.01, 64, 64, "EPSG:4326").collect()] == ["off"]


def archive(values):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for stem, v in values.items():
            body = gzip.compress(v.astype(">i2").tobytes())
            info = tarfile.TarInfo(f"{stem}.dat.gz")
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_ingest_converges_and_the_catalogue_answers(spark, tmp_path):
    grid = Grid(-120.0, 45.0, 0.01, 8, 6, 4)
    v = np.arange(48, dtype="int16").reshape(6, 8)
    v[0, 0] = -9999
    archives = spark.createDataFrame([(archive({"us_ssmv11034SlL00T0001TTNATS2018042705HP001": v, "us_ssmv11036SlL00T0001TTNATS2018042705HP001": np.where(v == -9999, v, v * 2)}),)], "content binary")
    observations = I.observations_of(I.snodas_pixels(archives, grid), grid, -9999)
    assert observations.count() == 94
    catalogue = Catalogue.initialise(spark, str(tmp_path))
    from dataclasses import replace

    base = TEMPLATES["snodas"]
    dataset = catalogue.register(replace(base, name="demo", grid=grid, variables={k: base.variables[k] for k in ("swe", "depth")}))
    with pytest.raises(ExistsError):
        catalogue.register(dataset)
    incoming = spark.createDataFrame([(dt.date(2018, 4, 27), ["swe", "depth"], "v1:a")], "date date, variables array<string>, source_hash string")
    assert I.commit(observations, I.decisions(incoming, None), ["depth", "swe"], dataset.path).first().action == "write"
    manifest = dataset.table(spark, "manifest")
    assert I.decisions(incoming, manifest).first().action == "skip"
    assert I.decisions(incoming.withColumn("source_hash", F.lit("v1:b")), manifest).first().action == "write"
    ring = [(-120.0, 45.0), (-119.92, 45.0), (-119.92, 44.94), (-120.0, 44.94), (-120.0, 45.0)]
    B.burned(basin(spark, ring), grid).withColumn("area_m2", F.lit(2.0).cast("float")).write.parquet(f"{dataset.path}/aoi_pixels")
    grid.frame(spark).select("pixel_id", "tile_id", F.lit(300.0).alias("elevation"), F.when(F.col("col") < 4, 80).otherwise(10).alias("forest_cover")).write.parquet(f"{dataset.path}/zone_pixels")
    again = Catalogue.open(spark, str(tmp_path))
    result = again.zonal_stats("demo", "12345:MT:USGS", DateRange(), ["swe", "depth"], ["landcover.forest_cover"])
    rows = {r.cell: r for r in result.rows.collect()}
    west = [int(v[r, c]) for r in range(6) for c in range(4) if (r, c) != (0, 0)]
    assert rows[1].area_m2 == 48.0 and rows[1].mean_swe_mm == pytest.approx(np.mean(west)) and rows[1].mean_depth_mm == pytest.approx(2 * np.mean(west))
    with pytest.raises(UnknownDataset):
        again.zonal_stats("nope", "x", DateRange(), ["swe"])
    again.set_active("demo", False)
    with pytest.raises(UnknownDataset):
        again["demo"]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from firnline.sources.snapshots import Snapshot
    from firnline.streaming.ingest import start_ingest

    rows = [(dt.date(2020, 1, d), "swe", 0, p, p + d) for d in (1, 2) for p in range(5)]
    schema = "date date, variable string, tile_id int, pixel_id long, value int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        start_ingest(stream, ["swe"], str(tmp_path / "out"), str(tmp_path / f"check{k}")).awaitTermination()
        snapshot = Snapshot.current(spark, str(tmp_path / "out"))
        assert snapshot.observations().count() == 10 and snapshot.manifest().count() == 2


def test_mosaic_leaves_gaps_absent(spark):
    tiles = spark.createDataFrame([(0, 0, 0, 0, 7), (0, 0, 0, 1, 255), (1, 0, 0, 0, 9)], "h int, v int, row int, col int, value int")
    offsets = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 2)], "h int, v int, row_off int, col_off int")
    assert {(r.row, r.col): r.value for r in I.mosaic(tiles, offsets, 255).collect()} == {(0, 0): 7, (0, 2): 9}


def test_a_multipolygon_is_not_the_polygon_of_its_rings(spark):
    ring = lambda x: [[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 0.0]]
    geometries = [{"type": "Polygon", "coordinates": [ring(0), ring(5)]}, {"type": "MultiPolygon", "coordinates": [[ring(0)], [ring(5)]]}, {"type": "MultiPolygon", "coordinates": [[ring(0), ring(5)]]}]
    texts = [json.dumps({"type": "GeometryCollection", "id": "1:MT:USGS", "properties": {"name": "A"}, "geometries": [{"type": "Point", "coordinates": [0, 0]}, g]}) for g in geometries]
    rows = B.parse_records(spark.createDataFrame(list(enumerate(texts)), "path int, json string"))
    hashes = {r.path: r.h for r in rows.select("path", B.wkb_hash(F.col("rings"), F.col("polygons")).alias("h")).collect()}
    assert len(set(hashes.values())) == 3
    one = struct.pack("<BII", 1, 3, 2) + b"".join(struct.pack("<I", 4) + b"".join(struct.pack("<dd", *p) for p in ring(x)) for x in (0, 5))
    assert hashes[0] == hashlib.sha256(one).hexdigest() and hashes[2] == hashlib.sha256(struct.pack("<BII", 1, 6, 1) + one).hexdigest()


def test_path_words(spark, tmp_path):
    from firnline.functions.names import is_path

    assert [is_path(t) for t in ("snodas", "a/b", "a\\b", "x.json", "json")] == [False, True, True, True, False]
    catalogue = Catalogue.initialise(spark, str(tmp_path))
    from dataclasses import asdict, replace

    with pytest.raises(QueryError):
        catalogue.register(replace(TEMPLATES["snodas"], name="a/b"))
    (tmp_path / "one.json").write_text(json.dumps(asdict(replace(TEMPLATES["snodas"], name="one"))))
    assert catalogue.resolve(str(tmp_path / "one.json")).name == "one"


def test_a_new_check_is_one_more_entry(spark):
    rows = spark.createDataFrame([("x",)], "target string")
    extra = {"own": lambda: D.findings(rows, "own", "demo", F.col("target"), F.lit("odd"))}
    assert [tuple(r) for r in D.health(extra).collect()] == [("own", "demo", "x", "odd")]
    with pytest.raises(QueryError):
        D.health(extra, ["other"])
