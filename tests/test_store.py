"""The basin store, the service's answers and the command line, end to end on a small grid."""

import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from firnline.__main__ import parser, run
from firnline.api import Service, answer
from firnline.errors import QueryError
from firnline.functions.grid import Grid
from firnline.sources.basins import BasinStore
from firnline.sources.catalog import TEMPLATES, Catalogue

GRID = Grid(-120.0, 45.0, 0.01, 32, 32, 8)


def record(triplet, west, north, size, name="A"):
    ring = [[west, north], [west + size, north], [west + size, north - size], [west, north - size], [west, north]]
    return json.dumps({"type": "GeometryCollection", "id": triplet, "properties": {"name": name, "huc": "17"}, "geometries": [{"type": "Point", "coordinates": [west, north]}, {"type": "Polygon", "coordinates": [ring]}]})


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("root"))
    catalogue = Catalogue.initialise(spark, path)
    base = TEMPLATES["snodas"]
    d = catalogue.register(replace(base, name="demo", grid=GRID, variables={"swe": base.variables["swe"]}))
    pixels = GRID.frame(spark)
    pixels.select("pixel_id", "tile_id", F.lit(300.0).alias("elevation"), F.when(F.col("col") < 5, 80).otherwise(10).alias("forest_cover")).write.parquet(f"{d.path}/zone_pixels")
    pixels.select(F.lit(dt.date(2020, 4, 1)).alias("date"), "tile_id", "pixel_id", F.col("row").cast("short").alias("swe")).write.partitionBy("date").parquet(f"{d.path}/observations")
    spark.createDataFrame([("swe", "v1:a", dt.date(2020, 4, 1))], "variable string, source_hash string, date date").write.partitionBy("date").parquet(f"{d.path}/manifest")
    return path


def sources(spark, *texts):
    return spark.createDataFrame([(f"{i}.geojson", t) for i, t in enumerate(texts)], "path string, json string")


def test_import_burn_query_sync_and_remove(spark, root, capsys):
    catalogue = Catalogue.open(spark, root)
    store, demo = BasinStore(spark, f"{root}/pourpoints"), catalogue["demo"]
    first = sources(spark, record("1:MT:USGS", -119.95, 44.95, 0.1), record("2:MT:USGS", -119.75, 44.9, 0.2, "B"), record("3:MT:USGS", -90.0, 40.0, 0.1, "C"), "junk")
    assert store.import_(first, [demo], dry_run=True).count() == 4 and store.records.read().count() == 0
    assert [r.status for r in store.import_(first, [demo]).orderBy("path").collect()] == ["import", "import", "import", "invalid"]
    index = {r.triplet: r.coverage["demo"] for r in store.index.read().collect()}
    assert index == {"1:MT:USGS": "full", "2:MT:USGS": "partial", "3:MT:USGS": "none"}
    outcome = lambda **how: {r.triplet[0]: r.action for r in store.rasterise(demo, **how).collect()}
    assert outcome() == {"1": "burn", "2": "burn", "3": "outside"}
    assert outcome() == {"1": "current", "2": "current", "3": "outside"} and outcome(rebuild=True)["1"] == "burn"

    service = Service(catalogue, store)
    body = service.stats_date_range("demo", "1:MT:USGS", "2020-01-01/..", ["swe"], zones=["landcover.forest_cover"])
    assert body["results"]["2020-04-01"][0][0] == pytest.approx(9.5, abs=0.01) and body["zones"][0]["zone"][0]["side"] == "below"
    assert answer(service, "stats_doy", dataset="demo", triplet="2:MT:USGS", month=4, day=1, start_year=2019, end_year=2020, variables=["swe"])[0] == 409
    assert answer(service, "stats_doy", dataset="demo", triplet="2:MT:USGS", month=4, day=1, start_year=2019, end_year=2020, variables=["swe"], allow_partial=True)[0] == 200
    for status, how in ((404, {"dataset": "nope"}), (422, {"variables": ["x"]}), (422, {"zones": ["terrain.aspect:a=1"]}), (400, {"datetime": "x"}), (409, {"triplet": "9:MT:USGS"})):
        assert answer(service, "stats_date_range", **{"dataset": "demo", "triplet": "1:MT:USGS", "datetime": None, "variables": ["swe"], **how})[0] == status
    assert service.pourpoints(1, 1)["total"] == 3 and service.pourpoints(1, 1)["features"][0]["id"] == "2:MT:USGS"
    assert service.pourpoint("1:MT:USGS")["geometry"]["type"] == "Polygon"
    assert service.dataset("demo")["variables"][0]["stat"] == "mean_swe_mm" and service.dates("demo") == ["2020-04-01"]
    assert service.values("demo")[0]["maximum"] == 31 and service.status()[0]["dates"] == 1
    assert {(f["target"][0], f["issue"]) for f in service.doctor("demo", ["dates", "pourpoints"])} == {("2", "partial coverage"), ("3", "no coverage"), ("3", "no raster")}

    assert run(spark, parser().parse_args([root, "stats", "demo", "1:MT:USGS", "--variable", "swe", "--dates", "04-01", "--years", "2020"])) == 0
    assert capsys.readouterr().out.splitlines()[0] == "date,area_m2,mean_swe_mm"
    assert run(spark, parser().parse_args([root, "doctor", "demo"])) == 1

    second = sources(spark, record("1:MT:USGS", -119.9, 44.95, 0.1), record("4:MT:USGS", -119.9, 44.95, 0.05))
    with pytest.raises(QueryError):
        store.sync(second, [demo])
    assert store.records.read().count() == 3
    changes = {r.triplet[0]: r.change for r in store.sync(second, [demo], f"{root}/dump").collect()}
    assert changes == {"1": "update", "2": "prune", "3": "prune", "4": "add"} and spark.read.parquet(f"{root}/dump").count() == 2
    assert outcome() == {"1": "burn", "4": "burn"}
    assert {r.basin for r in demo.table(spark, "aoi_pixels").select("basin").distinct().collect()} == {"1:MT:USGS", "4:MT:USGS"}
    assert store.remove("4:MT:USGS", [demo]) == ["records", "index", "demo pixels"]
