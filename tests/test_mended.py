"""Cases that once gave wrong answers: pixels beyond a fixed grid, shares of nodata, order in a stream, checks of the doctor."""

import datetime as dt
import json
from dataclasses import asdict, replace

import duckdb
import pytest
from pyspark.sql import functions as F

from firnline import queries as Q
from firnline.__main__ import parser, run
from firnline.api import Service
from firnline.errors import NoBasin, QueryError, UnknownBasin, UnknownProblem
from firnline.functions.grid import Grid
from firnline.operators import basins as B
from firnline.operators import diagnostics as D
from firnline.plans.output import csv_columns
from firnline.plans.zonal import Variable, ZonalResult
from firnline.sources import ingest as I
from firnline.sources.basins import BasinStore
from firnline.sources.catalog import TEMPLATES, Catalogue
from firnline.sources.snapshots import Snapshot
from firnline.streaming.ingest import arrived, start_ingest

DAY = dt.date(2020, 1, 1)
LONG = "date date, variable string, tile_id int, pixel_id long, value double"


def test_layers_of_parts_with_large_keys(spark, tmp_path):
    """The grids are as large as the table asks for."""
    keys = [*range(1, 30), 2_500_049, 2_500_050, 2_500_051]
    rows = [(k, f"Brand#{k % 3}", k % 50 + 1, 900.0 + k % 100) for k in keys]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    forest = {r.pixel_id: r.forest_cover for r in Q.QUERIES["m6_forest_layers"](spark, str(tmp_path)).where("forest_cover <> 255").collect()}
    cell = lambda k: (k // 50 // 4) * 13 + k % 50 // 4
    assert cell(2_500_050) in forest and set(forest) <= {cell(k) for k in keys}
    assert Q.QUERIES["m5_terrain_layers"](spark, str(tmp_path)).agg(F.max("pixel_id")).first()[0] >= cell(2_500_051)


def test_forest_layers_cover_the_whole_grid(spark, tmp_path):
    """Pixels beyond the last part are told as nodata: the grid has 10,000 rows of 13 at least, and more where parts ask for them."""
    for k, last, rows in ((0, 2000, 130_000), (1, 2_500_049, 13 * (2_500_049 // 50 // 4 + 1))):
        spark.createDataFrame([(1, "b", 4, 900.0), (last, "b", 7, 900.0)], "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/{k}/part.parquet")
        got = {r.pixel_id: (r.tile_id, r.forest_cover) for r in Q.QUERIES["m6_forest_layers"](spark, f"{tmp_path}/{k}").collect()}
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/{k}/part.parquet/*.parquet'")
        assert len(got) == rows and got == {p: (t, f) for p, t, f in con.sql(Q.ORACLES["m6_forest_layers"]).fetchall()}


def test_nodata_share_is_that_of_the_raster(spark):
    """One of four pixels has a value, and only that one has a row."""
    rows = spark.createDataFrame([(DAY, 0, 5.0)], "date date, pixel_id long, swe double")
    told = D.value_ranges(rows, [Variable("swe", "mm")], DAY, 4).first()
    assert told.nodata_pct == 75.0 and told.maximum == 5.0
    assert D.value_ranges(rows, [Variable("swe", "mm")], DAY).first().nodata_pct == 0.0


def test_the_last_value_of_a_batch_counts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def file(*rows):
        spark.createDataFrame([(DAY, v, 0, p, float(x)) for v, p, x in rows], LONG).coalesce(1).write.mode("append").parquet(src)

    def take():
        stream = arrived(spark.readStream.schema(LONG).parquet(src))
        start_ingest(stream, ["swe"], out, str(tmp_path / "check"), order="arrived").awaitTermination()
        return {r.pixel_id: r.swe for r in Snapshot.current(spark, out).observations().collect()}

    file(("swe", 0, 9), ("swe", 0, 3), ("swe", 1, 1), ("swe", 1, 2))
    assert take() == {0: 3.0, 1: 2.0}  # within a file
    file(("swe", 0, 7))
    file(("swe", 0, 4), ("rain", 0, 50))
    assert take() == {0: 4.0, 1: 2.0}  # over files of one batch, and over batches; rain is no variable
    manifest = {r.variable for r in I.manifest_of(spark, out).collect()}
    file(("rain", 3, 1))
    assert take() == {0: 4.0, 1: 2.0} and manifest == {"swe"}  # a batch of unknown variables only


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("doctor"))
    catalogue = Catalogue.initialise(spark, path)
    grid = Grid(-120.0, 45.0, 0.01, 8, 8, 4)
    base = TEMPLATES["snodas"]
    d = catalogue.register(replace(base, name="demo", grid=grid, variables={"swe": base.variables["swe"]}, zones={"terrain.elevation": {}, "landcover.forest_cover": {}}))
    frame = grid.frame(spark)
    frame.select("pixel_id", "tile_id", F.lit(300.0).alias("elevation")).write.parquet(f"{d.path}/zone_pixels")
    frame.where("row < 2").select(F.lit(DAY).alias("date"), F.when(F.col("col") == 0, 9).otherwise(F.col("tile_id")).cast("int").alias("tile_id"), "pixel_id", F.col("row").cast("short").alias("swe")).write.partitionBy("date").parquet(f"{d.path}/observations")
    spark.createDataFrame([("swe", "v0:a", DAY)], "variable string, source_hash string, date date").write.partitionBy("date").parquet(f"{d.path}/manifest")
    return Service(catalogue, BasinStore(spark, f"{path}/pourpoints")), path


def test_every_check_of_the_doctor_answers(spark, service, capsys):
    told, path = service
    issues = lambda *checks: {(f["check"], f["target"], f["issue"]) for f in told.doctor("demo", checks or None)}
    assert issues("grid") == {("grid", "observations", "2 pixels are in another tile")}
    assert issues("files") == {("files", "landcover.forest_cover", "missing"), ("files", "2020-01-01 swe", "stale format (stored 0, current 1)")}
    assert issues("dates") == set() and issues() == issues("grid") | issues("files")
    with pytest.raises(QueryError, match="pourpoints"):
        told.doctor("demo", ["pourpoints"])  # nothing is burned yet
    assert run(spark, parser().parse_args([path, "doctor", "demo", "--check", "grid"])) == 1 and "another tile" in capsys.readouterr().out
    assert told.values("demo")[0]["nodata_pct"] == 75.0
    off = D.lattice_findings({"t": spark.createDataFrame([(64, 0), (-1, 0), (3, 0)], "pixel_id long, tile_id int")}, "demo", Grid(0.0, 0.0, 1.0, 8, 8, 4))
    assert [r.issue for r in off.collect()] == ["2 pixels are off the grid"]


def test_register_and_create_with_a_mask(spark, service, tmp_path, capsys):
    told, path = service
    file = tmp_path / "other.json"
    file.write_text(json.dumps(asdict(replace(told.catalogue["demo"], name="other", path=""))))
    assert run(spark, parser().parse_args([path, "dataset-register", str(file)])) == 0
    assert Catalogue.open(spark, path)["other"].grid == told.catalogue["demo"].grid
    spark.createDataFrame([(1,), (1,), (2,)], "pixel_id long").write.parquet(str(tmp_path / "mask"))
    assert run(spark, parser().parse_args([path, "dataset-create", "snodas", "masked", "--mask", str(tmp_path / "mask")])) == 0
    assert run(spark, parser().parse_args([path, "dataset-stage", "snodas", "staged"])) == 0
    capsys.readouterr()
    opened = Catalogue.open(spark, path)
    assert opened.mask("masked").count() == 2 and opened.mask("staged") is None and "staged" not in opened.active()


def test_problems_by_key_and_guards(spark, service):
    told, _ = service
    assert told.problem("CoverageError")["status"] == 409
    with pytest.raises(UnknownProblem):
        told.problem("x")
    point = json.dumps({"type": "Feature", "id": "1:MT:USGS", "properties": {"name": "A"}, "geometry": {"type": "Point", "coordinates": [1, 2]}})
    parsed = B.parse_records(spark.createDataFrame([("a", point)], "path string, json string"))
    with pytest.raises(NoBasin):
        B.require_basin(parsed, "1:MT:USGS")
    with pytest.raises(UnknownBasin):
        B.require_basin(parsed, "2:MT:USGS")


def test_csv_rows_of_large_areas(spark, tmp_path):
    """Numbers of 1e7 and more have no exponent in CSV, and of those below only small ones do: as the SQL and Python write them."""
    texts = ["10000000.0", "17424625.0", "9999999.0", "1234567890123456.0", "1e+16", "0.0001", "5e-05", "0.3333333333333333", "2e-44", "-12345678.25", ""]
    numbers = spark.createDataFrame([("b", dt.date(2020, 1, k + 1), 0, float(t) if t else None, 1.0) for k, t in enumerate(texts)], "basin string, date date, cell int, area_m2 double, mean_swe_mm double")
    result = ZonalResult(numbers, numbers.select("basin", "cell", "area_m2"), [], [Variable("swe", "mm")])
    assert [r.area_m2 for r in csv_columns(result).collect()] == texts
    spark.range(300_000).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand", "45 AS p_size", "900D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, dt.date(1996, 4, 1), 1, 1, 7.0, 0.07, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_shipdate date, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [(r.area_m2, r.mean_qty_ea) for r in Q.QUERIES["s24_csv_rows"](spark, str(tmp_path)).collect()] == [(str(45.0 * (300_000 - len(range(0, 300_000, 89)))), "7.0")]
