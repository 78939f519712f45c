"""The crossed reduction, by hand-worked examples and relations between queries."""

import datetime as dt
import json

import pytest

from firnline.errors import IncompleteData, QueryError
from firnline.functions.dates import DateRange, DayOfYear, parse_dates
from firnline.functions.zones import STANDARD_LAYERS, parse_selection, resolve_axis
from firnline.plans.output import compact_json, iter_csv
from firnline.plans.zonal import Variable, ordered, require_cell_count, require_complete, zonal_stats

DAY = dt.date(2018, 4, 27)
SWE, TOTAL = Variable("swe", "mm", nodata=-1), Variable("swe", "mm", nodata=-1, reducer="total")
ALL = DateRange()


def run(spark, values, areas, zones=None, variables=(SWE,), tokens=(), dates=ALL, day=DAY, **how):
    """values, areas and each zone column are lists over pixels; None in areas leaves the pixel out."""
    observations = spark.createDataFrame([(day, i, v) for i, v in enumerate(values) if v is not None], "date date, pixel_id long, swe int")
    aoi = spark.createDataFrame([("b", i, float(a)) for i, a in enumerate(areas)], "basin string, pixel_id long, area_m2 float")
    pixels = None
    if zones:
        names = list(zones)
        pixels = spark.createDataFrame([(i, *[float(zones[n][i]) for n in names]) for i in range(len(areas))], "pixel_id long, " + ", ".join(f"{n} double" for n in names))
    return zonal_stats(observations, aoi, pixels, dates, list(variables), [resolve_axis(parse_selection(t)) for t in tokens], **how)


def rows(result):
    return [tuple(r) for r in ordered(result).drop("basin", "date", *[f"{p}{k}" for p in "oz" for k in range(len(result.axes))]).collect()]


def test_weighted_mean_and_total_leave_nodata_out_but_area_keeps_it(spark):
    zone = {"elevation": [100.0] * 4}
    assert rows(run(spark, [100, 200, -1, 400], [10, 20, 30, 40], zone, tokens=["terrain.elevation"])) == [(1, 100.0, 300.0)]
    assert rows(run(spark, [100, 200, -1, 400], [10, 20, 30, 40], zone, [TOTAL], ["terrain.elevation"])) == [(1, 100.0, 21000.0)]


def test_all_nodata_is_null_with_its_area(spark):
    assert rows(run(spark, [-1, -1], [5, 7], {"elevation": [10, 10]}, tokens=["terrain.elevation"])) == [(1, 12.0, None)]


def test_bands_and_empty_cells(spark):
    zone = {"elevation": [100, 400]}
    assert rows(run(spark, [100, 200], [10, 20], zone, tokens=["terrain.elevation"])) == [(1, 10.0, 100.0), (2, 20.0, 200.0)]
    full = rows(run(spark, [100, 200], [10, 20], zone, [TOTAL], ["terrain.elevation"], include_empty=True))
    assert len(full) == 16 and full[0] == (0, 0.0, None) and full[2] == (2, 20.0, 4000.0)


def test_crossing_has_the_first_axis_most_significant(spark):
    zone = {"forest_cover": [10, 90, 10, 90], "aspect_entropy": [0.1, 0.1, 0.9, 0.9]}
    tokens = ["landcover.forest_cover", "terrain.aspect_entropy"]
    got = rows(run(spark, [10, 20, 30, 40], [1, 2, 4, 8], zone, tokens=tokens))
    assert got == [(0, 1.0, 10.0), (1, 4.0, 30.0), (2, 2.0, 20.0), (3, 8.0, 40.0)]
    back = rows(run(spark, [10, 20, 30, 40], [1, 2, 4, 8], zone, tokens=tokens[::-1]))
    assert sorted(r[1:] for r in got) == sorted(r[1:] for r in back)


def test_whole_basin_is_one_cell_and_never_dropped(spark):
    assert rows(run(spark, [1, 2, 3, 4], [1, 2, 0, 4])) == [(0, 7.0, 3.0)]
    assert rows(run(spark, [-1], [0])) == [(0, 0.0, None)]


def test_bands_recombine_to_the_whole_basin(spark):
    values, areas, zone = list(range(40)), [1 + i % 7 for i in range(40)], {"elevation": [i * 50 for i in range(40)]}
    bands = rows(run(spark, values, areas, zone, [TOTAL], ["terrain.elevation"]))
    whole = rows(run(spark, values, areas, None, [TOTAL]))
    assert sum(b[1] for b in bands) == whole[0][1] and sum(b[2] for b in bands) == whole[0][2]


def test_scale_divides_after_the_reduction(spark):
    assert rows(run(spark, [15, 25], [1, 1], variables=[Variable("swe", "k", 10, nodata=-1)])) == [(0, 2.0, 2.0)]


def test_no_matching_date_still_tells_zones_and_header(spark):
    result = run(spark, [1], [10], {"elevation": [100]}, tokens=["terrain.elevation"], dates=DateRange(dt.date(2020, 1, 1)))
    assert rows(result) == []
    assert "".join(iter_csv(result)).strip() == "date,terrain.elevation_min_ft,terrain.elevation_max_ft,area_m2,mean_swe_mm"
    body = json.loads(compact_json(result, "b"))
    assert body["results"] == {} and [z["area_m2"] for z in body["zones"]] == [10.0]


def test_csv_text(spark):
    result = run(spark, [5], [10], {"elevation": [100], "aspect": [4]}, tokens=["terrain.elevation", "terrain.aspect"])
    lines = "".join(iter_csv(result)).splitlines()
    assert lines == ["date,terrain.elevation_min_ft,terrain.elevation_max_ft,terrain.aspect,area_m2,mean_swe_mm", "2018-04-27,0,1000,flat,10.0,5.0"]
    empty = run(spark, [-1], [50], {"elevation": [400]}, tokens=["terrain.elevation"])
    assert "".join(iter_csv(empty)).splitlines()[1] == "2018-04-27,1000,2000,50.0,"


def test_compact_json(spark):
    body = json.loads(compact_json(run(spark, [5, -1], [10, 3], {"forest_cover": [80, 20]}, tokens=["landcover.forest_cover"]), "b"))
    assert body["variables"] == ["mean_swe_mm"] and body["zone_layers"] == ["landcover.forest_cover"]
    assert body["results"] == {"2018-04-27": [[None], [5.0]]} and body["zones"][1]["zone"][0]["threshold"] == 50.0


def test_guards(spark):
    axes = [resolve_axis(parse_selection("terrain.elevation:band_step_ft=1"))]
    with pytest.raises(QueryError):
        require_cell_count(axes)
    listing = spark.createDataFrame([(DAY, "swe"), (DAY, "depth"), (dt.date(2018, 4, 28), "swe")], "date date, variable string")
    with pytest.raises(IncompleteData):
        require_complete(listing, ["swe", "depth"], ALL)
    require_complete(listing, ["swe"], ALL)
    with pytest.raises(QueryError):
        Variable("a__b", "mm")
    with pytest.raises(QueryError):
        Variable("a", "mm", nodata=float("nan"))


def test_dates():
    assert parse_dates("2024-01-01/..") == DateRange(dt.date(2024, 1, 1), None)
    assert parse_dates("20240101") == DateRange(dt.date(2024, 1, 1), dt.date(2024, 1, 1))
    assert parse_dates("02-29", "2018..2024") == DayOfYear(2, 29, 2018, 2024)
    assert parse_dates(None) == DateRange()
    for bad in (("04-01", None), ("2024-02-30", None), ("04-01", "2024..2018"), ("02-30", "2018"), ("2024-01-01", "2018"), ("a/b/c", None)):
        with pytest.raises(QueryError):
            parse_dates(*bad)


def test_dates_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("date_add(date'2018-04-25', cast(id as int)) AS date", "id AS pixel_id", "id AS swe").write.partitionBy("date").parquet(str(tmp_path / "o"))
    table = spark.read.parquet(str(tmp_path / "o"))
    from pyspark.sql import functions as F

    plan = table.where(DayOfYear(4, 27, 2017, 2019).predicate(F.col("date")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_standard_layers_cover_the_six_axes():
    assert sorted(STANDARD_LAYERS) == ["landcover.forest_cover", "terrain.aspect", "terrain.aspect_entropy", "terrain.eastness", "terrain.elevation", "terrain.northness"]
