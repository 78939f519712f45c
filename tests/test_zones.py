"""Zone schemes: edges, nodata, overrides, tokens."""

import pytest
from pyspark.sql import functions as F

from firnline.errors import QueryError, ZoneConfigError
from firnline.functions.zones import STANDARD_LAYERS, Bands, Buckets, Classes, Split, parse_selection, resolve_axis


def ordinals(spark, scheme, values, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", scheme.ordinal(F.col("v")).alias("o")).orderBy("i").collect()]


def test_bands_are_half_open_and_aligned_to_zero(spark):
    scheme = Bands(-1000, 3000, 1000, "ft", 1, -9999)
    assert [(z.low, z.high) for z in scheme.zones()] == [(-1000, 0), (0, 1000), (1000, 2000), (2000, 3000), (3000, 4000)]
    assert ordinals(spark, scheme, [-1000.0, -0.5, 0.0, 999.999, 1000.0, 3999.0, 4000.0, -1000.1, -9999.0, float("nan"), None]) == [0, 0, 1, 1, 2, 4, -1, -1, -1, -1, -1]


def test_standard_elevation_has_sixteen_bands_and_scales_metres(spark):
    scheme = STANDARD_LAYERS["terrain.elevation"].scheme
    assert len(scheme.zones()) == 16 and len(scheme.set_to(500).zones()) == 31 and len(scheme.set_to(250).zones()) == 62
    assert scheme.zones()[ordinals(spark, scheme, [1000.0])[0]].label == "3000-4000 ft"


def test_bands_agree_with_edges_one_step_of_a_double_away(spark):
    import math

    scheme = Bands(0, 100, 7, "u", 1, -9999)
    edges = [float(z.low) for z in scheme.zones()]
    values = [f(e) for e in edges for f in (lambda e: math.nextafter(e, -1e9), lambda e: e, lambda e: math.nextafter(e, 1e9))]
    expected = [max((z.ordinal for z in scheme.zones() if z.low <= v), default=-1) for v in values]
    assert ordinals(spark, scheme, values) == expected


def test_top_edge_is_in_the_last_bucket(spark):
    scheme = Buckets(-1.0, 1.0, 4, -9999)
    assert ordinals(spark, scheme, [-1.0, -0.5, 0.0, 0.5, 0.999, 1.0, 1.0001, -1.0001, -9999.0, float("nan")]) == [0, 1, 2, 3, 3, 3, -1, -1, -1, -1]
    assert Buckets(-1.0, 1.0, 3, -9999).edges() == [-1, -0.333333, 0.333333, 1]


def test_split_has_nan_below_and_does_not_enforce_its_range(spark):
    scheme = Split(50.0, 0, 100, "%", 1, 255, "no", "yes")
    assert ordinals(spark, scheme, [49.9, 50.0, 300.0, -5.0, 255.0, float("nan"), None]) == [0, 1, 1, 0, -1, 0, -1]


def test_unknown_class_codes_are_in_no_zone(spark):
    assert ordinals(spark, Classes(((4, "a", "A"), (2, "b", "B"))), [4, 2, 3, None], "int") == [0, 1, -1, -1]


@pytest.mark.parametrize("token,value", [("terrain.elevation", None), ("terrain.elevation:band_step_ft=500", 500), ("landcover.forest_cover:threshold_pct=40", 40.0)])
def test_tokens(token, value):
    assert parse_selection(token).value == value


@pytest.mark.parametrize("token", ["terrain.nope", "terrain.aspect:band_step_ft=5", "terrain.elevation:500", "terrain.elevation:nope=500", "terrain.elevation:band_step_ft=x"])
def test_bad_tokens(token):
    with pytest.raises(QueryError):
        parse_selection(token)


def test_settings_of_a_dataset_and_of_a_query():
    selection = parse_selection("terrain.elevation")
    assert resolve_axis(selection, {"terrain.elevation": {"band_step_ft": 500}}).scheme.step == 500
    assert resolve_axis(parse_selection("terrain.elevation:band_step_ft=250"), {"terrain.elevation": {"band_step_ft": 500}}).scheme.step == 250
    with pytest.raises(ZoneConfigError):
        resolve_axis(selection, {"terrain.elevation": {"buckets": 4}})
    with pytest.raises(ZoneConfigError):
        resolve_axis(parse_selection("terrain.aspect"), {"terrain.aspect": {"buckets": 4}})
    with pytest.raises(QueryError):
        resolve_axis(parse_selection("terrain.elevation:band_step_ft=0"))


def test_columns_of_zones():
    assert STANDARD_LAYERS["terrain.aspect"].scheme.zones()[4].columns("terrain.aspect") == {"terrain.aspect": "flat"}
    assert STANDARD_LAYERS["landcover.forest_cover"].scheme.zones()[1].columns("x") == {"x_side": "forested", "x_threshold_%": "50"}
