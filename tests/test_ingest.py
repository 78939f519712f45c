"""Taking in sources, streams and zone layers: what stays, what is replaced, and what a failure leaves behind."""

import datetime as dt
import gzip
import io
import tarfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.__main__ import parser, run
from firnline.errors import ExistsError, IncompleteData, QueryError, SourceError
from firnline.functions.grid import Albers, Grid, reprojected
from firnline.functions.names import SNODAS_PRODUCTS
from firnline.operators import generate as G
from firnline.operators import terrain as T
from firnline.sources import ingest as I
from firnline.sources.catalog import TEMPLATES, Catalogue
from firnline.sources.ingesters import run_ingest
from firnline.sources.snapshots import Snapshot
from firnline.sources.tables import Table
from firnline.streaming.ingest import start_ingest

DAY = dt.date(2020, 1, 1)
LONG = "date date, variable string, tile_id int, pixel_id long, value double"
GRID = Grid(-120.0, 45.0, 0.01, 8, 6, 4)


def values(spark, path):
    rows = Snapshot.current(spark, path).observations().collect()
    return {(r.date.day, v, r.pixel_id): r[v] for r in rows for v in ("swe", "depth") if r[v] is not None}


def test_a_date_in_two_batches_a_release_and_a_batch_again(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def batch(k, *rows):
        spark.createDataFrame([(DAY.replace(day=d), v, 0, p, float(x)) for d, v, p, x in rows], LONG).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(LONG).parquet(src)
        start_ingest(stream, ["depth", "swe"], out, str(tmp_path / "check")).awaitTermination()

    batch(0, (1, "swe", 0, 5), (1, "swe", 1, 6), (2, "swe", 0, 7))
    assert {(r.date.day, r.variable) for r in I.manifest_of(spark, out).collect()} == {(1, "swe"), (2, "swe")}
    batch(1, (1, "depth", 0, 50))
    expected = {(1, "swe", 0): 5, (1, "swe", 1): 6, (2, "swe", 0): 7, (1, "depth", 0): 50}
    assert values(spark, out) == expected
    assert {(r.date.day, r.variable) for r in I.manifest_of(spark, out).collect()} == {(1, "swe"), (2, "swe"), (1, "depth")}
    batch(2, (1, "swe", 1, 66))  # a value is released again
    expected[1, "swe", 1] = 66
    assert values(spark, out) == expected
    stream = spark.readStream.schema(LONG).parquet(src)
    start_ingest(stream, ["depth", "swe"], out, str(tmp_path / "check-2")).awaitTermination()  # all of it again, in one batch
    assert {k: v for k, v in values(spark, out).items() if k != (1, "swe", 1)} == {k: v for k, v in expected.items() if k != (1, "swe", 1)}


def test_a_batch_that_is_known_is_skipped(spark, tmp_path):
    from firnline.streaming.ingest import batch_plan

    rows = spark.createDataFrame([(DAY, "swe", 0, 0, 5.0)], LONG)
    plan = batch_plan(rows, None)
    assert [r.action for r in I.commit(rows, plan, ["depth", "swe"], str(tmp_path), merge=True).collect()] == ["write"]
    assert [r.action for r in batch_plan(rows, I.manifest_of(spark, str(tmp_path))).collect()] == ["skip"]
    other = spark.createDataFrame([(DAY, "swe", 0, 0, 6.0)], LONG)
    assert [r.action for r in batch_plan(other, I.manifest_of(spark, str(tmp_path))).collect()] == ["write"]


def test_a_changed_date_is_written_again(spark, tmp_path):
    """The plan reads the manifest that the commit replaces."""
    path = str(tmp_path)
    for tag, value in (("v1:a", 1.0), ("v1:b", 2.0), ("v1:b", 3.0)):
        rows = spark.createDataFrame([(DAY, "swe", 0, 0, value), (DAY, "depth", 0, 0, value)], LONG)
        incoming = spark.createDataFrame([(DAY, ["swe", "depth"], tag)], "date date, variables array<string>, source_hash string")
        done = I.commit(rows, I.decisions(incoming, I.manifest_of(spark, path)), ["depth", "swe"], path)
        assert done.first().action == ("skip" if value == 3.0 else "write")
    assert values(spark, path) == {(1, "swe", 0): 2.0, (1, "depth", 0): 2.0}


def test_an_incomplete_date_writes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(DAY, "swe", 0, 0, 1.0)], LONG)
    plan = spark.createDataFrame([(DAY, "v1:a", "write")], "date date, source_hash string, action string")
    with pytest.raises(IncompleteData):
        I.commit(rows, plan, ["depth", "swe"], str(tmp_path), complete=True)
    with pytest.raises(SourceError):
        I.commit(rows.limit(0), plan, ["depth", "swe"], str(tmp_path))
    assert I.manifest_of(spark, str(tmp_path)) is None and not (tmp_path / "observations").exists()


def test_a_table_keeps_its_old_version_until_the_new_one_is_done(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), "a int")
    assert table.read().count() == 0
    for k in range(4):
        table.replace(table.read().unionByName(spark.createDataFrame([(k,)], "a int")))
    assert sorted(r.a for r in table.read().collect()) == [0, 1, 2, 3] and len(table.versions()) == 2
    torn = tmp_path / "t" / "v999999999999-torn"  # a job died here
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"half a file")
    assert sorted(r.a for r in table.read().collect()) == [0, 1, 2, 3]


def archive(path, day, value, products=SNODAS_PRODUCTS):
    with tarfile.open(path, "w") as tar:
        for code, vcode, _ in products:
            stem = f"us_ssmv1{code:04d}S{vcode or 'lL00'}T0001TTNATS{day:%Y%m%d}05HP001"
            body = gzip.compress(np.full(48, value, ">i2").tobytes())
            for name, content in ((f"{stem}.dat.gz", body), (f"{stem}.txt.gz", b"")):
                info = tarfile.TarInfo(name)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))


def test_archives_are_taken_in_once(spark, tmp_path, capsys):
    root, source = str(tmp_path / "root"), tmp_path / "source"
    source.mkdir()
    catalogue = Catalogue.initialise(spark, root)
    demo = catalogue.register(replace(TEMPLATES["snodas"], name="demo", grid=GRID))
    days = [DAY, DAY.replace(day=2)]
    for k, day in enumerate(days):
        archive(source / f"{k}.tar", day, k + 1)
    told = lambda **how: {r.date.day: r.action for r in run_ingest(spark, str(source), demo, **how).collect()}
    assert told(dry_run=True) == {1: "write", 2: "write"} and I.manifest_of(spark, demo.path) is None
    assert told() == {1: "write", 2: "write"} and told() == {1: "skip", 2: "skip"} and told(force=True) == {1: "write", 2: "write"}
    rows = demo.table(spark, "observations")
    assert dict(rows.dtypes)["swe"] == "smallint" and {r.date.day: (r["count(1)"], r["max(swe)"]) for r in rows.groupBy("date").agg(F.count(F.lit(1)), F.max("swe")).collect()} == {1: (48, 1), 2: (48, 2)}
    archive(source / "1.tar", days[1], 9)  # the same name, other content
    assert told() == {1: "skip", 2: "write"} and demo.table(spark, "observations").where("swe = 9").count() == 48
    assert run(spark, parser().parse_args([root, "ingest", "demo", str(source)])) == 0 and '"skip"' in capsys.readouterr().out
    archive(source / "2.tar", DAY.replace(day=3), 1, SNODAS_PRODUCTS[1:])
    with pytest.raises(SourceError):
        told()
    assert I.manifest_of(spark, demo.path).select("date").distinct().count() == 2


def converted(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).toPandas().to_parquet(folder / f"{name}.parquet")


def test_daily_tables_of_one_stage(spark, tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    demo = replace(TEMPLATES["swann-800m"], name="demo", grid=GRID, path=str(tmp_path / "demo"))
    schema = "row int, col int, swe smallint, depth smallint"
    pixels = [(r, c, r + c, -999 if r == 0 else 7) for r in range(6) for c in range(8)]
    converted(spark, source, "UA_SWE_Depth_800m_v1_20200101_early.nc", pixels, schema)
    converted(spark, source, "UA_SWE_Depth_800m_v1_20200102_stable.nc", pixels, schema)
    assert {r.date: r.action for r in run_ingest(spark, str(source), demo).collect()} == {DAY: "write"}
    rows = demo.table(spark, "observations").collect()
    assert len(rows) == 48 and sum(r.depth is None for r in rows) == 8 and sum(r.swe for r in rows) == sum(r + c for r, c, *_ in pixels)
    converted(spark, source, "UA_SWE_Depth_800m_v1_20200103_early.nc", [(6, 0, 1, 1)], schema)
    with pytest.raises(Exception, match="beside the dataset's grid"):
        run_ingest(spark, str(source), demo)


def test_tiles_of_a_day_are_one_mosaic(spark, tmp_path):
    from firnline.sources.ingesters import InstarrTiles

    source = tmp_path / "source"
    source.mkdir()
    base = TEMPLATES["instarr"]
    demo = replace(base, name="demo", grid=Grid(0.0, 0.0, 1.0, 8, 4, 4, base.grid.crs), path=str(tmp_path / "demo"))
    names = sorted(base.variables)
    schema = "row int, col int, " + ", ".join(f"{k} {base.variables[k].dtype}" for k in names)
    tile = lambda x: [(r, c, *[x] * len(names)) for r in range(4) for c in range(4) if (r, c) != (0, 0)]
    converted(spark, source, "SPIRES_NRT_h08v04_MOD09GA061_20200101_V1.0.nc", tile(1), schema)
    converted(spark, source, "SPIRES_NRT_h09v04_MOD09GA061_20200101_V1.0.nc", tile(2), schema)
    assert [r.action for r in run_ingest(spark, str(source), demo, InstarrTiles(size=4)).collect()] == ["write"]
    rows = {r.pixel_id: r.grain_size for r in demo.table(spark, "observations").collect()}
    assert rows == {r * 8 + c: 1 + c // 4 for r in range(4) for c in range(8) if (r, c % 4) != (0, 0)}
    converted(spark, source, "SPIRES_NRT_h10v04_MOD09GA061_20200101_V2.0.nc", tile(3), schema)
    with pytest.raises(SourceError):
        run_ingest(spark, str(source), demo, InstarrTiles(size=4))


def test_layers_of_several_targets_from_one_source(spark, tmp_path):
    """A slope that rises eastward under a half of forest, on two targets at once, in two phases."""
    fine = Grid(-500_000.0, 2_000_000.0, 10.0, 64, 64, 64, "EPSG:5070")
    frame = fine.frame(spark)
    dem = frame.select("row", "col", (F.col("col") * 2.0).alias("z"))
    cover = frame.select("row", "col", F.when(F.col("col") < 32, 42).otherwise(81).cast("smallint").alias("nlcd"))
    target = lambda name, edge: replace(TEMPLATES["snodas"], name=name, grid=Grid(-500_000.0, 2_000_000.0, float(edge), 640 // edge + 2, 640 // edge, 8, "EPSG:5070"), path=str(tmp_path / name))
    targets = [target("a", 40), target("b", 80)]
    G.generate({"terrain": (dem, fine), "landcover": (cover, fine)}, targets)
    for t, edge in zip(targets, (40, 80), strict=True):
        n = 640 // edge
        rows = {(r.pixel_id // (n + 2), r.pixel_id % (n + 2)): r for r in t.table(spark, "zone_pixels").collect()}
        assert len(rows) == n * (n + 2)
        inner = [rows[i, j] for i in range(1, n - 1) for j in range(1, n - 1)]
        assert all(r.aspect == T.WEST and abs(r.northness) < 1e-9 and r.eastness < -0.999 and r.aspect_entropy < 1e-9 for r in inner)
        assert all(rows[1, j].elevation < rows[1, j + 1].elevation for j in range(1, n - 2))
        assert all(r.forest_cover == (100 if j < n // 2 else 0) for (_, j), r in rows.items() if j < n)
        assert all((r.elevation, r.aspect, r.northness, r.aspect_entropy, r.forest_cover) == (-9999.0, 255, -9999.0, -1.0, 255) for (_, j), r in rows.items() if j >= n)
    with pytest.raises(ExistsError):
        G.generate({"landcover": (cover, fine)}, [target("c", 40), targets[0]])
    assert not (tmp_path / "c").exists()
    G.generate({"landcover": (cover.withColumn("nlcd", F.lit(41).cast("smallint")), fine)}, [targets[0]], force=True)
    assert {r.forest_cover for r in targets[0].table(spark, "zone_pixels").collect()} == {100, 255}
    with pytest.raises(QueryError):
        G.generate({}, targets)


def test_layers_from_tiles_and_from_elsewhere_by_command(spark, tmp_path, capsys):
    root, grid = str(tmp_path / "root"), Grid(-105.9, 39.9, 0.05, 4, 4, 4)
    catalogue = Catalogue.initialise(spark, root)
    demo = catalogue.register(replace(TEMPLATES["snodas"], name="demo", grid=grid))
    spark.createDataFrame([(r, c, 100.0) for r in range(50) for c in range(50)], "row int, col int, z double").write.parquet(str(tmp_path / "tiles/n40w106.parquet"))
    x, y = (spark.range(1).select(*[c.alias(k) for c, k in zip(Albers().forward(F.lit(-105.95), F.lit(39.98)), "xy", strict=True)]).first())
    args = [root, "generate", "demo", "--tiles", str(tmp_path / "tiles"), "--per-degree", "50", f"--grid={x},{y},2000,25,25"]
    assert run(spark, parser().parse_args(args)) == 0 and '"demo"' in capsys.readouterr().out
    rows = demo.table(spark, "zone_pixels").collect()
    assert len(rows) == 16 and all(abs(r.elevation - 100.0) < 1e-6 and r.aspect == T.FLAT and r.eastness == -9999.0 for r in rows)
    made = [(r, c, 7.0) for r in range(4) for c in range(4)]
    spark.createDataFrame(made, "row int, col int, elevation double").write.parquet(str(tmp_path / "made"))
    with pytest.raises(ExistsError):
        run(spark, parser().parse_args([root, "layers-import", "demo", str(tmp_path / "made")]))
    assert run(spark, parser().parse_args([root, "layers-import", "demo", str(tmp_path / "made"), "--force"])) == 0
    assert {r.elevation for r in demo.table(spark, "zone_pixels").collect()} == {7.0}
    spark.createDataFrame(made[1:], "row int, col int, elevation double").write.parquet(str(tmp_path / "short"))
    with pytest.raises(SourceError):
        run(spark, parser().parse_args([root, "layers-import", "demo", str(tmp_path / "short"), "--force"]))


def test_elevation_tiles_that_are_there(spark, tmp_path):
    for name, z in (("n40w106", 1.0), ("n39w105", 2.0)):
        spark.createDataFrame([(r, c, z) for r in range(4) for c in range(4)], "row int, col int, z double").write.parquet(str(tmp_path / f"{name}.parquet"))
    pixels, grid = G.elevation_tiles(spark, str(tmp_path), (-106.0, 38.0, -104.0, 40.0), 4)
    assert (grid.origin_x, grid.origin_y, grid.cols, grid.rows) == (-106.0, 40.0, 8, 8)
    got = {(r.row, r.col): r.z for r in pixels.collect()}
    assert got == {(r, c): 1.0 for r in range(4) for c in range(4)} | {(r, c): 2.0 for r in range(4, 8) for c in range(4, 8)}
    work = Grid(-105.9, 39.9, 0.1, 3, 3, 4)
    assert {r.z for r in G.warped(pixels, grid, work).collect()} == {1.0}
    with pytest.raises(SourceError):
        G.elevation_tiles(spark, str(tmp_path), (-120.0, 30.0, -119.0, 31.0), 4)
    with pytest.raises(SourceError):
        G.local_pixels(spark, str(tmp_path / "none"), "nlcd", "smallint")


def test_places_in_other_projections(spark):
    x, y = Albers().forward(F.lit(-105.0), F.lit(40.0))
    there = reprojected(x, y, "EPSG:5070", "EPSG:4326")
    back = reprojected(*reprojected(F.lit(-105.0), F.lit(40.0), "EPSG:4326", "+proj=sinu +R=6371007.181 +units=m"), "+proj=sinu +R=6371007.181 +units=m", "EPSG:5070")
    row = spark.range(1).select(*[c.alias(n) for c, n in zip((*there, x, y, *back), "abcdef", strict=True)]).first()
    assert (row.a, row.b) == (pytest.approx(-105.0), pytest.approx(40.0)) and (row.e, row.f) == (pytest.approx(row.c), pytest.approx(row.d))
    with pytest.raises(QueryError):
        reprojected(F.lit(0), F.lit(0), "EPSG:9", "EPSG:4326")


def test_a_staged_dataset_has_its_mask_and_is_not_active(spark, tmp_path):
    catalogue = Catalogue.initialise(spark, str(tmp_path))
    catalogue.stage("snodas", "new", spark.createDataFrame([(1,), (2,), (2,)], "pixel_id long"))
    assert catalogue.active() == [] and sorted(r.pixel_id for r in catalogue.mask("new").collect()) == [1, 2]
    catalogue.create("snodas")
    assert catalogue.mask("snodas") is None and Catalogue.open(spark, str(tmp_path)).registered("new").ingester == "snodas"
