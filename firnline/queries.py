"""Queries of the zonal engine over the driver's tables, each with the SQL that gives the same rows.

Parts stand for pixels, line items for observations, orders for ingested dates, suppliers for stations; the views below
say how. Each query calls the engine's operators; the SQL says the same independently.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.functions import grid as G
from firnline.functions import names as N
from firnline.functions.dates import DateRange, DayOfYear, selected_dates
from firnline.functions.zones import STANDARD_LAYERS, parse_selection, resolve_axis
from firnline.operators import basins as B
from firnline.operators import diagnostics as D
from firnline.operators import footprint as P
from firnline.operators import generate as L
from firnline.operators import terrain as T
from firnline.plans import output as O
from firnline.plans import tiles as A
from firnline.plans import zonal as Z
from firnline.sources import ingest as I
from firnline.sources.snapshots import Snapshot
from firnline.sources.tables import work_folder
from firnline.streaming.ingest import start_ingest

GRID = G.Grid(-120.0, 45.0, 0.01, 50, 40_000, 10)
FINE = G.Grid(0.0, 0.0, 1.0, 50, 40_000, 10, "local")
QTY = Z.Variable("qty", "ea", 1, "mean", 50, "double")
QTY_TOTAL = Z.Variable("qty", "ea", 1, "total", 50, "double")
DISC = Z.Variable("disc", "pct", 100, "mean", -9999, "double")
SPRING = DateRange(dt.date(1996, 3, 1), dt.date(1996, 5, 31))
APRIL_1 = DayOfYear(4, 1, 1995, 2000)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    cell = lambda test, nodata, value: F.when(test, F.lit(nodata)).otherwise(value)
    rows = _read(spark, sf_dir, "part").select(
        key.alias("pixel_id"), F.floor(key / 50).cast("int").alias("row"), (key % 50).cast("int").alias("col"), F.col("p_brand").alias("basin"),
        F.when(size <= 45, size).otherwise(0).cast("float").alias("area_m2"), cell(key % 97 == 0, -9999.0, (F.col("p_retailprice") - 900) * 45).alias("elevation"), (key % 6).cast("int").alias("aspect"),
        ((key % 201) - 100).cast("double").alias("_n"), cell(key % 83 == 0, -1.0, (key % 11) / 10.0).alias("aspect_entropy"), cell(key % 89 == 0, 255, size * 2).cast("int").alias("forest_cover"),
    )
    return rows.withColumn("northness", F.col("_n") / 100.0).withColumn("eastness", -F.col("_n") / 100.0).drop("_n")


PIXELS_SQL = """pixels AS (
    SELECT p_partkey AS pixel_id, p_partkey // 50 AS "row", p_partkey % 50 AS col, p_brand AS basin,
        CAST(CASE WHEN p_size <= 45 THEN p_size ELSE 0 END AS FLOAT) AS area_m2,
        CASE WHEN p_partkey % 97 = 0 THEN -9999e0 ELSE (p_retailprice - 900) * 45 END AS elevation, p_partkey % 6 AS aspect,
        ((p_partkey % 201) - 100) / 100e0 AS northness, -((p_partkey % 201) - 100) / 100e0 AS eastness,
        CASE WHEN p_partkey % 83 = 0 THEN -1e0 ELSE (p_partkey % 11) / 10e0 END AS aspect_entropy,
        CASE WHEN p_partkey % 89 = 0 THEN 255 ELSE p_size * 2 END AS forest_cover
    FROM part)"""


def _zone_sql(step: int = 1000, percent: int = 50) -> str:
    """Ordinals of the pixels' layers."""
    start = int((-100 * 3.28084) // step)
    count = int((4500 * 3.28084) // step) + 1 - start
    return f"""zoned AS (
    SELECT *, CASE WHEN elevation = -9999 OR floor(elevation * 3.28084 / {step}) - ({start}) NOT BETWEEN 0 AND {count - 1} THEN -1 ELSE CAST(floor(elevation * 3.28084 / {step}) - ({start}) AS INT) END AS o_elev,
        CASE WHEN aspect BETWEEN 0 AND 4 THEN CAST(aspect AS INT) ELSE -1 END AS o_aspect,
        CASE WHEN northness < -0.5 THEN 0 WHEN northness < 0 THEN 1 WHEN northness < 0.5 THEN 2 ELSE 3 END AS o_north,
        CASE WHEN aspect_entropy = -1 THEN -1 WHEN aspect_entropy >= 0.5 THEN 1 ELSE 0 END AS o_entropy,
        CASE WHEN forest_cover = 255 THEN -1 WHEN forest_cover >= {percent} THEN 1 ELSE 0 END AS o_forest
    FROM pixels)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_partkey").alias("pixel_id"), F.col("l_quantity").alias("qty"), (F.col("l_discount") * 100).alias("disc"))


OBS_SQL = "obs AS (SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS pixel_id, l_quantity AS qty, l_discount * 100 AS disc FROM lineitem)"


def _aoi(spark: SparkSession, sf_dir: str, basin: str | None = None) -> DataFrame:
    rows = pixels(spark, sf_dir).select("basin", "pixel_id", "area_m2")
    return rows.where(F.col("basin") == basin) if basin else rows.withColumn("basin", F.lit("all"))


def _axes(*tokens: str) -> list:
    return [resolve_axis(parse_selection(t)) for t in tokens]


def _zonal(dates, variables, *tokens, basin=None, include_empty=False, by_brand=False, mask=False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        zones = pixels(spark, sf_dir).drop("basin", "area_m2", "row", "col")
        aoi = pixels(spark, sf_dir).select("basin", "pixel_id", "area_m2") if by_brand else _aoi(spark, sf_dir, basin)
        ground = pixels(spark, sf_dir).where("pixel_id % 7 <> 0").select("pixel_id") if mask else None
        result = Z.zonal_stats(observations(spark, sf_dir), aoi, zones, dates, variables, _axes(*tokens), ground, include_empty=include_empty)
        return result.rows.drop(*[f"z{k}" for k in range(len(tokens))])

    return query


_PREDICATE = {
    "spring": "date BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'",
    "april": "month(date) = 4 AND day(date) = 1 AND year(date) BETWEEN 1995 AND 2000",
}


def _zonal_sql(when: str, stats: str, axes: list[tuple[str, int]], basin: str = "'all'", include_empty: bool = False, step: int = 1000, percent: int = 50, extra: str = "TRUE") -> str:
    """SQL of a zonal query. stats: of w_*, a_* sums; axes: ordinal column and its number of zones."""
    cell = "0"
    for column, size in axes:
        cell = f"({cell}) * {size} + {column}"
    product = "cells AS (SELECT 0 AS cell)" if not axes else "cells AS (SELECT " + cell.replace("o_", "z_") + " AS cell, " + ", ".join(f"z_{c[2:]} AS o{k}" for k, (c, _) in enumerate(axes)) + " FROM " + ", ".join(f"(SELECT CAST(range AS INT) AS z_{c[2:]} FROM range({n}))" for c, n in axes) + ")"
    inside = " AND ".join([f"{c} >= 0" for c, _ in axes] + ["area_m2 > 0", extra])
    ordinals = "".join(f", c.o{k}" for k in range(len(axes)))
    keep = "" if include_empty or not axes else "WHERE coalesce(a.area, 0) > 0"
    return f"""WITH {PIXELS_SQL}, {_zone_sql(step, percent)}, {OBS_SQL},
    inz AS (SELECT {basin} AS basin, pixel_id, area_m2, {cell} AS cell FROM zoned WHERE {inside}),
    basins AS (SELECT DISTINCT {basin} AS basin FROM pixels),
    {product},
    areas AS (SELECT basin, cell, sum(CAST(area_m2 AS DOUBLE)) AS area FROM inz GROUP BY ALL),
    days AS (SELECT DISTINCT date FROM obs WHERE {_PREDICATE[when]}),
    red AS (SELECT basin, date, cell,
            sum(CAST(CAST(qty AS FLOAT) * area_m2 AS DOUBLE)) FILTER (qty <> 50) AS w_qty, sum(CAST(area_m2 AS DOUBLE)) FILTER (qty <> 50) AS a_qty,
            sum(CAST(CAST(disc AS FLOAT) * area_m2 AS DOUBLE)) AS w_disc, sum(CAST(area_m2 AS DOUBLE)) AS a_disc
        FROM obs JOIN inz USING (pixel_id) WHERE {_PREDICATE[when]} GROUP BY ALL)
    SELECT b.basin, d.date, c.cell{ordinals}, coalesce(a.area, 0e0) AS area_m2, {stats}
    FROM basins b CROSS JOIN cells c CROSS JOIN days d LEFT JOIN areas a ON a.basin = b.basin AND a.cell = c.cell
    LEFT JOIN red r ON r.basin = b.basin AND r.date = d.date AND r.cell = c.cell {keep}"""


_MEAN, _TOTAL, _DISC = "w_qty / a_qty AS mean_qty_ea", "w_qty AS total_qty_ea", "w_disc / a_disc / 100 AS mean_disc_pct"
_ELEV, _FOREST, _ASPECT, _NORTH, _ENTROPY = ("o_elev", 16), ("o_forest", 2), ("o_aspect", 5), ("o_north", 4), ("o_entropy", 2)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_E, _F, _A, _N, _H = "terrain.elevation", "landcover.forest_cover", "terrain.aspect", "terrain.northness", "terrain.aspect_entropy"
_add("a6_crossed_two_axis", _zonal(APRIL_1, [QTY], _E, _F), _zonal_sql("april", _MEAN, [_ELEV, _FOREST]))
_add("a3_mean_whole_basin", _zonal(SPRING, [QTY]), _zonal_sql("spring", _MEAN, []))
_add("a3_mean_banded", _zonal(SPRING, [QTY], _E), _zonal_sql("spring", _MEAN, [_ELEV]))
_add("a4_total_banded", _zonal(SPRING, [QTY_TOTAL], _E), _zonal_sql("spring", _TOTAL, [_ELEV]))
_add("a6_crossed_all_axes", _zonal(APRIL_1, [QTY], _E, _A, _N, _H, _F), _zonal_sql("april", _MEAN, [_ELEV, _ASPECT, _NORTH, _ENTROPY, _FOREST]))
_add("a6_multi_basin", _zonal(APRIL_1, [QTY, DISC], _F, by_brand=True), _zonal_sql("april", f"{_DISC}, {_MEAN}", [_FOREST], "basin"))
_add("p6_unit_scale", _zonal(SPRING, [DISC]), _zonal_sql("spring", _DISC, []))
_add("p10_valid_domain_mask", _zonal(APRIL_1, [QTY], _F, mask=True), _zonal_sql("april", _MEAN, [_FOREST], extra="pixel_id % 7 <> 0"))
_add("p11_nonempty_cells", _zonal(APRIL_1, [QTY], _E, _A), _zonal_sql("april", _MEAN, [_ELEV, _ASPECT]))
_add("j3_dense_spine", _zonal(APRIL_1, [QTY], _E, _A, include_empty=True), _zonal_sql("april", _MEAN, [_ELEV, _ASPECT], include_empty=True))


def _month_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest quantity and discount of a part in a month, one row for each; tiles are of 1,024 parts."""
    rows = observations(spark, sf_dir).groupBy(F.trunc("date", "month").cast("date").alias("date"), "pixel_id").agg(F.max("qty").alias("qty"), F.max("disc").alias("disc"))
    return rows.withColumn("tile_id", F.floor(F.col("pixel_id") / 1024).cast("int"))


_MONTHS_SQL = "obs AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_partkey AS pixel_id, max(l_quantity) AS qty, max(l_discount * 100) AS disc FROM lineitem GROUP BY ALL)"


def _of_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zonal query of tile arrays: what is joined is a row for a tile and month."""
    at = F.pmod("pixel_id", F.lit(1024))
    tiles = A.pack(_month_values(spark, sf_dir), at, ["disc", "qty"])
    aoi = pixels(spark, sf_dir).select("basin", "pixel_id", "area_m2", F.floor(F.col("pixel_id") / 1024).cast("int").alias("tile_id"))
    zones = pixels(spark, sf_dir).drop("basin", "area_m2", "row", "col")
    months = _month_values(spark, sf_dir).select("date").distinct()
    return Z.zonal_stats(tiles, aoi, zones, SPRING, [DISC, QTY], _axes(_F), available=months, reduction=partial(A.tile_reductions, position=at)).rows.drop("z0")


_add("a6_tile_arrays", _of_tiles, _zonal_sql("spring", f"{_DISC}, {_MEAN}", [_FOREST], "basin").replace(OBS_SQL, _MONTHS_SQL))
_add(
    "j1_tile_round_trip",
    lambda s, d: A.unpack(A.pack(_month_values(s, d), F.pmod("pixel_id", F.lit(1024)), ["disc", "qty"]), ["disc", "qty"]),
    f"WITH {_MONTHS_SQL} SELECT date, CAST(pixel_id // 1024 AS INT) AS tile_id, CAST(pixel_id % 1024 AS INT) AS position, disc, qty FROM obs",
)
_add("z2_banded_step_override", _zonal(APRIL_1, [QTY], _E + ":band_step_ft=500"), _zonal_sql("april", _MEAN, [("o_elev", 31)], step=500))
_add("z6_threshold_override", _zonal(APRIL_1, [QTY], _F + ":threshold_pct=40"), _zonal_sql("april", _MEAN, [_FOREST], percent=40))


def _one_basin_dates(query):
    return lambda spark, sf_dir: selected_dates(observations(spark, sf_dir), query)


_add("p1_date_range", _one_basin_dates(SPRING), f"WITH {OBS_SQL} SELECT DISTINCT date FROM obs WHERE {_PREDICATE['spring']}")
_add("p1_open_start", _one_basin_dates(DateRange(None, dt.date(1995, 12, 31))), f"WITH {OBS_SQL} SELECT DISTINCT date FROM obs WHERE date <= DATE '1995-12-31'")
_add("p1_open_end", _one_basin_dates(DateRange(dt.date(2001, 1, 1))), f"WITH {OBS_SQL} SELECT DISTINCT date FROM obs WHERE date >= DATE '2001-01-01'")
_add("p3_day_of_year", _one_basin_dates(APRIL_1), f"WITH {OBS_SQL} SELECT DISTINCT date FROM obs WHERE {_PREDICATE['april']}")
_add("p3_leap_day", _one_basin_dates(DayOfYear(2, 29, 1995, 2001)), f"WITH {OBS_SQL} SELECT DISTINCT date FROM obs WHERE month(date) = 2 AND day(date) = 29 AND year(date) BETWEEN 1995 AND 2001")
_add("s3_available_dates", _one_basin_dates(DateRange()), f"WITH {OBS_SQL} SELECT DISTINCT date FROM obs")
_add("o3_latest_date", lambda s, d: D.latest_date(observations(s, d)), f"WITH {OBS_SQL} SELECT max(date) AS date FROM obs")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("variable"))


_LISTING = "listing AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS variable FROM lineitem)"
_add("o4_first_present", lambda s, d: Z.first_present(_listing(s, d)), f"WITH {_LISTING} SELECT date, variable FROM listing ORDER BY date, variable LIMIT 1")
_add("s4_resolve_variables", lambda s, d: Z.resolved(_listing(s, d)), f"WITH {_LISTING} SELECT date, variable, count(*) AS files FROM listing GROUP BY ALL")
_add(
    "f4_glob_listing",
    lambda s, d: Z.resolved(Z.listing_of(_listing(s, d).select("date", F.concat("variable", F.lit("__x.tif")).alias("name")), [replace(QTY, glob="[AR]__*.tif"), replace(DISC, glob="[!A]__?.tif"), Z.Variable("other", "ea")])),
    f"WITH {_LISTING} SELECT date, v AS variable, count(*) AS files FROM listing, (VALUES ('qty', 'A'), ('qty', 'R'), ('disc', 'N'), ('disc', 'R')) AS m(v, flag) WHERE variable = flag GROUP BY date, v",
)
_add(
    "j15_completeness",
    lambda s, d: Z.completeness(_listing(s, d), ["A", "N", "R"]).select("date", F.array_join("missing", ",").alias("missing")),
    f"""WITH {_LISTING}, n AS (SELECT date, count(*) FILTER (variable = 'A') AS a, count(*) FILTER (variable = 'N') AS n, count(*) FILTER (variable = 'R') AS r FROM listing GROUP BY date)
    SELECT date, concat_ws(',', CASE WHEN a <> 1 THEN 'A' END, CASE WHEN n <> 1 THEN 'N' END, CASE WHEN r <> 1 THEN 'R' END) AS missing FROM n WHERE a <> 1 OR n <> 1 OR r <> 1""",
)
_add(
    "m13_completeness_findings",
    lambda s, d: D.completeness_findings(_listing(s, d), "demo", ["A", "N"], SPRING),
    f"""WITH {_LISTING}, n AS (SELECT date, count(*) FILTER (variable = 'A') AS a, count(*) FILTER (variable = 'N') AS n FROM listing WHERE {_PREDICATE["spring"]} GROUP BY date)
    SELECT 'dates' AS "check", 'demo' AS dataset, CAST(date AS VARCHAR) AS target, 'missing ' || concat_ws(', ', CASE WHEN a <> 1 THEN 'A' END, CASE WHEN n <> 1 THEN 'N' END) AS issue FROM n WHERE a <> 1 OR n <> 1""",
)


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))


_ORDER_DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"
_add("j8_missing_dates", lambda s, d: D.missing_dates(_order_days(s, d)), f"WITH {_ORDER_DAYS}, span AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM days) SELECT date FROM span WHERE date NOT IN (SELECT date FROM days)")
_add(
    "a19_status",
    lambda s, d: D.status(_read(s, d, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderdate").cast("date").alias("date"))),
    "SELECT o_orderpriority AS dataset, count(DISTINCT CAST(o_orderdate AS DATE)) AS dates, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders GROUP BY 1",
)
_add(
    "a11_value_ranges",
    lambda s, d: D.value_ranges(observations(s, d), [QTY, DISC], dt.date(1997, 6, 10)).select("variable", "unit", *[F.round(c, 6).alias(c) for c in ("minimum", "maximum", "mean", "nodata_pct")]),
    f"""WITH {OBS_SQL}, o AS (SELECT * FROM obs WHERE date = DATE '1997-06-10')
    SELECT 'qty' AS variable, 'ea' AS unit, round(min(qty) FILTER (qty <> 50), 6) AS minimum, round(max(qty) FILTER (qty <> 50), 6) AS maximum, round(avg(qty) FILTER (qty <> 50), 6) AS mean, round(100e0 * count(*) FILTER (qty = 50) / count(*), 6) AS nodata_pct FROM o
    UNION ALL SELECT 'disc', 'pct', round(min(disc) / 100, 6), round(max(disc) / 100, 6), round(avg(disc) / 100, 6), 0e0 FROM o""",
)
_add(
    "s20_band_stats",
    lambda s, d: D.band_statistics(observations(s, d), "qty", 50, ["date"]).select("date", *[F.round(c, 6).alias(c) for c in ("minimum", "maximum", "mean", "deviation")]),
    f"WITH {OBS_SQL} SELECT date, round(min(qty) FILTER (qty <> 50), 6) AS minimum, round(max(qty) FILTER (qty <> 50), 6) AS maximum, round(avg(qty) FILTER (qty <> 50), 6) AS mean, round(stddev_pop(qty) FILTER (qty <> 50), 6) AS deviation FROM obs GROUP BY date",
)


def _assign(layer: str, token: str | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        axis = resolve_axis(parse_selection(token or layer))
        return pixels(spark, sf_dir).select("pixel_id", axis.ordinal.alias("ordinal"))

    return query


for _name, _layer, _column in (("z2_banded_assign", _E, "o_elev"), ("z4_bucket_assign", _N, "o_north"), ("z6_threshold_assign", _H, "o_entropy"), ("z7_categorical_assign", _A, "o_aspect")):
    _add(_name, _assign(_layer), f"WITH {PIXELS_SQL}, {_zone_sql()} SELECT pixel_id, {_column} AS ordinal FROM zoned")


def _met(layer: str, *columns: str):
    """The zones of a layer that pixels meet, as its scheme describes them, with how many pixels do."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _assign(layer)(spark, sf_dir).where("ordinal >= 0").groupBy("ordinal").agg(F.count(F.lit(1)).alias("pixels"))
        return STANDARD_LAYERS[layer].scheme.frame(spark, layer).join(found, "ordinal").select("ordinal", "pixels", *columns)

    return query


def _met_sql(column: str, told: str) -> str:
    return f"WITH {PIXELS_SQL}, {_zone_sql()}, met AS (SELECT {column} AS ordinal, count(*) AS pixels FROM zoned WHERE {column} >= 0 GROUP BY 1) SELECT ordinal, pixels, {told} FROM met"


_add("z1_banded_zones", _met(_E, "axis", "label", "low", "high"), _met_sql("o_elev", "'terrain.elevation' AS axis, ((ordinal - 1) * 1000) || '-' || (ordinal * 1000) || ' ft' AS label, (ordinal - 1) * 1000e0 AS low, ordinal * 1000e0 AS high"))
_add("z3_bucket_zones", _met(_N, "axis", "low", "high"), _met_sql("o_north", "'terrain.northness' AS axis, ordinal * 0.5e0 - 1 AS low, ordinal * 0.5e0 - 0.5e0 AS high"))
_add("z5_threshold_zones", _met(_F, "label", "side", "threshold", "unit"), _met_sql("o_forest", "['unforested', 'forested'][ordinal + 1] AS label, ['below', 'above'][ordinal + 1] AS side, 50e0 AS threshold, '%' AS unit"))


def _met_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of two crossed axes that each basin's pixels meet, with their zones."""
    axes = _axes(_A, _F)
    met = Z.in_zone_geometry(pixels(spark, sf_dir).select("basin", "pixel_id", "area_m2"), pixels(spark, sf_dir).drop("basin", "area_m2"), axes).groupBy("basin", "cell").agg(F.count(F.lit(1)).alias("pixels"))
    return met.join(Z.cells_frame(spark, axes), "cell").select("basin", "cell", "pixels", "o0", "z0", "o1", "z1")


_add(
    "j2_zone_product",
    _met_cells,
    f"""WITH {PIXELS_SQL}, {_zone_sql()} SELECT basin, CAST(o_aspect * 2 + o_forest AS INT) AS cell, count(*) AS pixels, o_aspect AS o0, ['North', 'East', 'South', 'West', 'Flat'][o_aspect + 1] AS z0, o_forest AS o1, ['unforested', 'forested'][o_forest + 1] AS z1
    FROM zoned WHERE area_m2 > 0 AND o_aspect >= 0 AND o_forest >= 0 GROUP BY basin, o_aspect, o_forest""",
)


def _zone_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV columns of the zones that pixels meet, on three layers."""
    rows = [(layer, z.ordinal, header, text) for layer in (_E, _A, _F) for z in STANDARD_LAYERS[layer].scheme.zones() for header, text in z.columns(layer).items()]
    ordinals = F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), resolve_axis(parse_selection(k)).ordinal.alias("ordinal")) for k in (_E, _A, _F)]))
    met = pixels(spark, sf_dir).select(ordinals.alias("m")).select("m.*").distinct()
    return spark.createDataFrame(rows, "layer string, ordinal int, header string, value string").join(met, ["layer", "ordinal"], "left_semi")


_add(
    "z15_zone_columns",
    _zone_columns,
    f"""WITH {PIXELS_SQL}, {_zone_sql()}, e AS (SELECT DISTINCT o_elev AS o FROM zoned WHERE o_elev >= 0), a AS (SELECT DISTINCT o_aspect AS o FROM zoned WHERE o_aspect >= 0), f AS (SELECT DISTINCT o_forest AS o FROM zoned WHERE o_forest >= 0)
    SELECT 'terrain.elevation' AS layer, o AS ordinal, 'terrain.elevation_' || h || '_ft' AS header, CAST((o - 1 + CASE h WHEN 'max' THEN 1 ELSE 0 END) * 1000 AS VARCHAR) AS value FROM e, (SELECT unnest(['min', 'max']) AS h)
    UNION ALL SELECT 'terrain.aspect', o, 'terrain.aspect', ['N', 'E', 'S', 'W', 'flat'][o + 1] FROM a
    UNION ALL SELECT 'landcover.forest_cover', o, 'landcover.forest_cover_side', ['unforested', 'forested'][o + 1] FROM f
    UNION ALL SELECT 'landcover.forest_cover', o, 'landcover.forest_cover_threshold_%', '50' FROM f""",
)


def _layer_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry says of each layer, with how many pixels its scheme gives a zone."""
    given = F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), (resolve_axis(parse_selection(k)).ordinal >= 0).alias("zoned")) for k in STANDARD_LAYERS]))
    used = pixels(spark, sf_dir).select(given.alias("g")).groupBy("g.layer").agg(F.count_if("g.zoned").alias("pixels"))
    return _layer_rows(spark).join(used, "layer")


_add(
    "z13_registry",
    _layer_use,
    f"""WITH {PIXELS_SQL}, {_zone_sql()}, n AS (SELECT count(*) FILTER (o_elev >= 0) AS e, count(*) FILTER (o_aspect >= 0) AS a, count(*) FILTER (o_north >= 0) AS n, count(*) FILTER (o_entropy >= 0) AS h, count(*) FILTER (o_forest >= 0) AS f FROM zoned)
    SELECT layer, kind, param, "default", [f, a, h, n, e, n][k] AS pixels FROM n, (VALUES (1, 'landcover.forest_cover', 'threshold', 'threshold_pct', 50e0), (2, 'terrain.aspect', 'categorical', NULL, NULL), (3, 'terrain.aspect_entropy', 'threshold', 'entropy_threshold', 0.5e0),
        (4, 'terrain.eastness', 'bucketed', 'buckets', 4e0), (5, 'terrain.elevation', 'banded', 'band_step_ft', 1000e0), (6, 'terrain.northness', 'bucketed', 'buckets', 4e0)) t(k, layer, kind, param, "default")""",
)


def _layer_rows(spark: SparkSession) -> DataFrame:
    from firnline.functions.zones import layers_frame

    return layers_frame(spark).select("layer", "kind", "param", "default")


_add(
    "a1_cell_index",
    lambda s, d: Z.in_zone_geometry(_aoi(s, d), pixels(s, d).drop("basin", "area_m2"), _axes(_E, _F)).select("pixel_id", "cell"),
    f"WITH {PIXELS_SQL}, {_zone_sql()} SELECT pixel_id, o_elev * 2 + o_forest AS cell FROM zoned WHERE area_m2 > 0 AND o_elev >= 0 AND o_forest >= 0",
)
_add(
    "a2_cell_areas",
    lambda s, d: Z.cell_areas(Z.in_zone_geometry(pixels(s, d).select("basin", "pixel_id", "area_m2"), pixels(s, d).drop("basin", "area_m2"), _axes(_A, _H))),
    f"WITH {PIXELS_SQL}, {_zone_sql()} SELECT basin, o_aspect * 2 + o_entropy AS cell, sum(CAST(area_m2 AS DOUBLE)) AS area_m2 FROM zoned WHERE area_m2 > 0 AND o_aspect >= 0 AND o_entropy >= 0 GROUP BY ALL",
)


def _result(spark: SparkSession, sf_dir: str, dates=APRIL_1, variables=(DISC, QTY), tokens=(_F,)) -> Z.ZonalResult:
    return Z.zonal_stats(observations(spark, sf_dir), _aoi(spark, sf_dir), pixels(spark, sf_dir).drop("basin", "area_m2"), dates, list(variables), _axes(*tokens))


_LONG = f"WITH r AS ({_zonal_sql('april', f'{_DISC}, {_MEAN}', [_FOREST])}) "
_add("a9_long_rows", lambda s, d: O.long_rows(_result(s, d)), _LONG + "SELECT basin, date, cell, 'mean_disc_pct' AS variable, mean_disc_pct AS value FROM r UNION ALL SELECT basin, date, cell, 'mean_qty_ea', mean_qty_ea FROM r")
_add("a9_variable_pivot", lambda s, d: O.pivoted(O.long_rows(_result(s, d)), ["date", "cell"], ["mean_disc_pct", "mean_qty_ea"]), _LONG + "SELECT date, cell, mean_disc_pct, mean_qty_ea FROM r")
_MATRIX = "'[' || string_agg('[' || coalesce(CAST(mean_disc_pct AS VARCHAR), 'null') || ',' || coalesce(CAST(mean_qty_ea AS VARCHAR), 'null') || ']', ',' ORDER BY cell) || ']'"
_add("a10_compact_matrix", lambda s, d: O.matrix(_result(s, d)).select("basin", "date", F.to_json("values").alias("values")), _LONG + f'SELECT basin, date, {_MATRIX} AS "values" FROM r GROUP BY basin, date')
_add(
    "s24_csv_rows",
    lambda s, d: O.csv_columns(_result(s, d)),
    _LONG + """SELECT CAST(date AS VARCHAR) AS date, CASE o0 WHEN 0 THEN 'unforested' ELSE 'forested' END AS "landcover.forest_cover_side", '50' AS "landcover.forest_cover_threshold_%", CAST(area_m2 AS VARCHAR) AS area_m2,
        coalesce(CAST(mean_disc_pct AS VARCHAR), '') AS mean_disc_pct, coalesce(CAST(mean_qty_ea AS VARCHAR), '') AS mean_qty_ea FROM r""",
)
_add("s25_compact_json", lambda s, d: O.matrix(_result(s, d)).select(F.to_json(F.struct("date", "values")).alias("json")), _LONG + f"""SELECT '{{"date":"' || date || '","values":' || {_MATRIX} || '}}' AS json FROM r GROUP BY basin, date""")


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return p.select((F.floor(F.col("row") / 4) * 13 + F.floor(F.col("col") / 4)).cast("long").alias("cell"), F.col("elevation").alias("z"), F.when(F.col("aspect") == 5, -1).otherwise(F.col("aspect")).cast("int").alias("aspect_class"), (F.col("pixel_id") % 360).cast("double").alias("aspect"), (F.lit(40) + (F.col("forest_cover") % 6)).alias("_n")).withColumn("nlcd", F.when(F.col("_n") == 45, 0).otherwise(F.col("_n")).cast("int"))


_COARSE = """coarse AS (SELECT ("row" // 4) * 13 + col // 4 AS cell, elevation AS z, CASE WHEN aspect = 5 THEN -1 ELSE aspect END AS cls, CAST(pixel_id % 360 AS DOUBLE) AS aspect,
    CASE WHEN 40 + forest_cover % 6 = 45 THEN 0 ELSE 40 + forest_cover % 6 END AS nlcd FROM pixels),
counted AS (SELECT cell, count(*) FILTER (cls = 0) AS n0, count(*) FILTER (cls = 1) AS n1, count(*) FILTER (cls = 2) AS n2, count(*) FILTER (cls = 3) AS n3, count(*) FILTER (cls = 4) AS n4,
    count(*) FILTER (cls >= 0) AS total, sum(z) FILTER (cls >= 0) AS sum_z, sum(cos(radians(aspect))) FILTER (cls BETWEEN 0 AND 3) AS sum_cos, sum(sin(radians(aspect))) FILTER (cls BETWEEN 0 AND 3) AS sum_sin FROM coarse GROUP BY cell)"""
_TERRAIN = lambda s, d: T.terrain_cells(_coarse(s, d), ["cell"])
_CELLS_SQL = f"WITH {PIXELS_SQL}, {_COARSE} "
_add("a12_class_counts", lambda s, d: _TERRAIN(s, d).select("cell", *[f"n{k}" for k in range(5)], "total"), _CELLS_SQL + "SELECT cell, n0, n1, n2, n3, n4, total FROM counted")
_add("a13_cell_mean", lambda s, d: _TERRAIN(s, d).select("cell", F.round("elevation", 6).alias("elevation")), _CELLS_SQL + "SELECT cell, round(CASE WHEN total > 0 THEN sum_z / total ELSE -9999 END, 6) AS elevation FROM counted")
_add("a14_majority", lambda s, d: _TERRAIN(s, d).select("cell", "aspect"), _CELLS_SQL + "SELECT cell, CAST(CASE WHEN total = 0 THEN 255 ELSE list_position([n0, n1, n2, n3, n4], list_max([n0, n1, n2, n3, n4])) - 1 END AS INT) AS aspect FROM counted")
_add("a15_components", lambda s, d: _TERRAIN(s, d).select("cell", F.round("northness", 6).alias("northness"), F.round("eastness", 6).alias("eastness")), _CELLS_SQL + "SELECT cell, round(CASE WHEN total - n4 > 0 THEN sum_cos / (total - n4) ELSE -9999 END, 6) AS northness, round(CASE WHEN total - n4 > 0 THEN sum_sin / (total - n4) ELSE -9999 END, 6) AS eastness FROM counted")
_add("a16_entropy", lambda s, d: _TERRAIN(s, d).select("cell", F.round("aspect_entropy", 6).alias("aspect_entropy")), _CELLS_SQL + ", p AS (SELECT cell, total, unnest([n0, n1, n2, n3, n4]) AS n FROM counted) SELECT cell, round(CASE WHEN any_value(total) = 0 THEN -1 ELSE sum(CASE WHEN n > 0 THEN -(n / total) * ln(n / total) ELSE 0 END) / ln(5) END, 6) AS aspect_entropy FROM p GROUP BY cell")
_add(
    "a17_percent_forest",
    lambda s, d: T.forest_cells(_coarse(s, d), ["cell"]),
    _CELLS_SQL + ", f AS (SELECT cell, count(*) FILTER (nlcd IN (41, 42, 43)) AS forest, count(*) FILTER (nlcd <> 0) AS valid FROM coarse GROUP BY cell) SELECT cell, forest, valid, CAST(CASE WHEN valid > 0 THEN round_even(100e0 * forest / valid, 0) ELSE 255 END AS INT) AS forest_cover FROM f",
)


def _surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("row", "col", F.when(F.col("elevation") == -9999, None).otherwise(F.col("elevation")).alias("z"))


_HORN = f"""WITH {PIXELS_SQL}, f AS (SELECT "row" AS r, col AS c, CASE WHEN elevation = -9999 THEN NULL ELSE elevation END AS z FROM pixels),
n AS (SELECT a.r, a.c, any_value(a.z) AS z, count(b.z) AS n, max(b.z) FILTER (b.r = a.r - 1 AND b.c = a.c - 1) AS z00, max(b.z) FILTER (b.r = a.r - 1 AND b.c = a.c) AS z01, max(b.z) FILTER (b.r = a.r - 1 AND b.c = a.c + 1) AS z02,
    max(b.z) FILTER (b.r = a.r AND b.c = a.c - 1) AS z10, max(b.z) FILTER (b.r = a.r AND b.c = a.c + 1) AS z12, max(b.z) FILTER (b.r = a.r + 1 AND b.c = a.c - 1) AS z20, max(b.z) FILTER (b.r = a.r + 1 AND b.c = a.c) AS z21, max(b.z) FILTER (b.r = a.r + 1 AND b.c = a.c + 1) AS z22
    FROM f a JOIN f b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c),
g AS (SELECT r, c, n, ((z02 + 2 * z12 + z22) - (z00 + 2 * z10 + z20)) / 80 AS dx, ((z20 + 2 * z21 + z22) - (z00 + 2 * z01 + z02)) / 80 AS dy FROM n),
s AS (SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col, CASE WHEN n = 9 THEN degrees(atan(sqrt(dx * dx + dy * dy))) END AS slope, CASE WHEN n = 9 THEN (degrees(atan2(-dx, dy)) + 360) % 360 END AS aspect FROM g) """
_add("w1_horn_slope", lambda s, d: T.slope_aspect(_surface(s, d), 10, 10).select("row", "col", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect")), _HORN + 'SELECT "row", col, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM s')
_add(
    "w2_default_flat",
    lambda s, d: T.slope_aspect(_surface(s, d), 500, 500).select("row", "col", T.aspect_class(F.col("slope"), F.col("aspect")).alias("cls")),
    _HORN.replace("/ 80", "/ 4000e0") + 'SELECT "row", col, CAST(CASE WHEN slope IS NULL THEN -1 WHEN slope < 2 THEN 4 WHEN aspect >= 315 OR aspect < 45 THEN 0 WHEN aspect < 135 THEN 1 WHEN aspect < 225 THEN 2 ELSE 3 END AS INT) AS cls FROM s',
)
_add(
    "w2_aspect_class",
    lambda s, d: T.slope_aspect(_surface(s, d), 10, 10).select("row", "col", T.aspect_class(F.col("slope"), F.col("aspect"), 60.0).alias("cls")),
    _HORN + 'SELECT "row", col, CAST(CASE WHEN slope IS NULL THEN -1 WHEN slope < 60 THEN 4 WHEN aspect >= 315 OR aspect < 45 THEN 0 WHEN aspect < 135 THEN 1 WHEN aspect < 225 THEN 2 ELSE 3 END AS INT) AS cls FROM s',
)


def _grids(spark: SparkSession, sf_dir: str, least: int) -> tuple[G.Grid, G.Grid]:
    """A source grid of so many rows at least that holds every part's pixel, and a target grid of 4 x 4 source pixels."""
    last = _read(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0
    rows = max(least, last // 50 + 1)
    return G.Grid(0.0, 0.0, 1.0, 50, rows, 10, "local", 10.0), G.Grid(0.0, 0.0, 4.0, 13, -(-rows // 4), 4, "local")


def _layers(kind: str, fine: Callable[[SparkSession, str], DataFrame], least: int = 1):
    """One kind of zone layers on every pixel of the target grid, as generation makes them."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, target = _grids(spark, sf_dir, least)
        cells = L.ENGINES[kind](L.cells_of(L.source_pixels(kind, fine(spark, sf_dir), source), source, target))
        layers = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, (t, _) in L.LAYERS[kind].items()]
        return L.layers_on(target, {kind: cells}).select("pixel_id", "tile_id", *layers)

    return query


_CELLS_OF_PARTS = "CAST(13 * (max(p_partkey) // 50 // 4 + 1) AS BIGINT)"
_frame = lambda size: f"frame AS (SELECT range AS pixel_id, CAST((range // 13 // 4) * 4 + range % 13 // 4 AS INT) AS tile_id FROM range((SELECT {size} FROM part)))"
_CLASSED = """, cl AS (SELECT (s."row" // 4) * 13 + s.col // 4 AS cell, z, aspect, CASE WHEN slope IS NULL THEN -1 WHEN slope < 2 THEN 4 WHEN aspect >= 315 OR aspect < 45 THEN 0 WHEN aspect < 135 THEN 1 WHEN aspect < 225 THEN 2 ELSE 3 END AS cls FROM s JOIN f ON s."row" = f.r AND s.col = f.c),
counted AS (SELECT cell, count(*) FILTER (cls = 0) AS n0, count(*) FILTER (cls = 1) AS n1, count(*) FILTER (cls = 2) AS n2, count(*) FILTER (cls = 3) AS n3, count(*) FILTER (cls = 4) AS n4, count(*) FILTER (cls >= 0) AS total,
    sum(z) FILTER (cls >= 0) AS sum_z, sum(cos(radians(aspect))) FILTER (cls BETWEEN 0 AND 3) AS sum_cos, sum(sin(radians(aspect))) FILTER (cls BETWEEN 0 AND 3) AS sum_sin FROM cl GROUP BY cell HAVING count(*) FILTER (cls >= 0) > 0),
shares AS (SELECT cell, sum(CASE WHEN n > 0 THEN -(n / total) * ln(n / total) ELSE 0 END) / ln(5) AS entropy FROM (SELECT cell, total, unnest([n0, n1, n2, n3, n4]) AS n FROM counted) GROUP BY cell), """
_add(
    "m5_terrain_layers",
    _layers("terrain", lambda s, d: _surface(s, d)),
    _HORN + _CLASSED + _frame(_CELLS_OF_PARTS) + """ SELECT pixel_id, tile_id, round(coalesce(sum_z / total, -9999), 6) AS elevation, CAST(CASE WHEN total IS NULL THEN 255 ELSE list_position([n0, n1, n2, n3, n4], list_max([n0, n1, n2, n3, n4])) - 1 END AS INT) AS aspect,
    round(CASE WHEN total - n4 > 0 THEN sum_cos / (total - n4) ELSE -9999 END, 6) AS northness, round(CASE WHEN total - n4 > 0 THEN sum_sin / (total - n4) ELSE -9999 END, 6) AS eastness, round(coalesce(entropy, -1), 6) AS aspect_entropy
    FROM frame LEFT JOIN counted ON pixel_id = counted.cell LEFT JOIN shares ON pixel_id = shares.cell""",
)
_add(
    "m6_forest_layers",
    _layers("landcover", lambda s, d: pixels(s, d).select("row", "col", F.when(F.col("forest_cover") % 7 == 0, 0).otherwise(F.lit(38) + F.col("forest_cover") % 7).alias("nlcd")), 40_000),
    f"""WITH {PIXELS_SQL}, c AS (SELECT ("row" // 4) * 13 + col // 4 AS cell, CASE WHEN forest_cover % 7 = 0 THEN 0 ELSE 38 + forest_cover % 7 END AS nlcd FROM pixels),
    n AS (SELECT cell, count(*) FILTER (nlcd IN (41, 42, 43)) AS forest, count(*) FILTER (nlcd <> 0) AS valid FROM c GROUP BY cell), {_frame(f"greatest(130000, {_CELLS_OF_PARTS})")}
    SELECT pixel_id, tile_id, CAST(CASE WHEN valid > 0 THEN round_even(100e0 * forest / valid, 0) ELSE 255 END AS INT) AS forest_cover FROM frame LEFT JOIN n ON pixel_id = cell""",
)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a month as a stream in two runs: quantities of some lines first, then discounts of all and quantities anew."""
    path = f"{work_folder(spark)}/streamed-{uuid.uuid4().hex}"
    schema = _read(spark, sf_dir, "lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/lineitem*")
    base = lines.select(F.trunc("l_shipdate", "month").alias("date"), F.col("l_partkey").alias("pixel_id"), (F.col("l_partkey") % 64).cast("int").alias("tile_id"), "l_linenumber", "l_quantity", "l_discount")
    long = lambda rows, variable, value: rows.select("date", F.lit(variable).alias("variable"), "tile_id", "pixel_id", value.alias("value"))
    first = long(base.where("l_linenumber <= 3"), "qty", F.col("l_quantity"))
    then = long(base, "disc", F.col("l_discount") * 100).unionByName(long(base.where("l_linenumber = 2"), "qty", -F.col("l_quantity")))
    for k, rows in enumerate((first, then, then)):  # the last run finds all of it known
        start_ingest(rows, ["disc", "qty"], path, f"{path}-progress-{min(k, 1)}").awaitTermination()
    return Snapshot.current(spark, path).observations().select("date", "pixel_id", "tile_id", "disc", "qty")


_add(
    "stream_ingest",
    _streamed,
    """WITH l AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_partkey AS pixel_id, l_linenumber AS n, l_quantity AS qty, l_discount * 100 AS disc FROM lineitem)
    SELECT date, pixel_id, CAST(pixel_id % 64 AS INT) AS tile_id, max(disc) AS disc, coalesce(max(-qty) FILTER (n = 2), max(qty) FILTER (n <= 3)) AS qty FROM l GROUP BY date, pixel_id""",
)


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of a month's line items as a stream in two runs: the last shipped of a batch counts, then those of the second run; tax is no variable."""
    path = f"{work_folder(spark)}/folded-{uuid.uuid4().hex}"
    lines = spark.readStream.schema(_read(spark, sf_dir, "lineitem").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/lineitem*")
    base = lines.select(F.trunc("l_shipdate", "month").alias("date"), F.col("l_partkey").alias("pixel_id"), (F.col("l_partkey") % 64).cast("int").alias("tile_id"), "l_linenumber", "l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("shipped"))
    long = lambda rows, variable, value: rows.select("date", F.lit(variable).alias("variable"), "tile_id", "pixel_id", value.alias("value"), "shipped")
    for k, rows in enumerate((long(base, "qty", F.col("l_quantity")).unionByName(long(base, "tax", F.lit(1e9))), long(base.where("l_linenumber = 1"), "qty", -F.col("l_quantity")))):
        start_ingest(rows, ["qty"], path, f"{path}-progress-{k}", order="shipped").awaitTermination()
    return Snapshot.current(spark, path).observations().select("date", "pixel_id", "qty")


_add(
    "stream_fold",
    _folded,
    """WITH l AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_partkey AS pixel_id, l_linenumber AS n, l_quantity AS qty, (l_shipdate, l_orderkey, l_linenumber) AS shipped FROM lineitem)
    SELECT date, pixel_id, coalesce(arg_max(-qty, shipped) FILTER (n = 1), arg_max(qty, shipped)) AS qty FROM l GROUP BY date, pixel_id""",
)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation")
    joined = _read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(":"), F.upper(F.substring("n_name", 1, 2)), F.lit(":USGS")).alias("triplet"), F.col("s_name").alias("name"), (F.lit(-120.0) + (F.col("s_suppkey") % 50) / 10.0).alias("lon"), (F.lit(40.0) + F.col("s_nationkey") / 5.0).alias("lat"), F.col("n_name").alias("nation"), "s_suppkey")


_STATIONS = """stations AS (SELECT s_suppkey || ':' || upper(substr(n_name, 1, 2)) || ':USGS' AS triplet, s_name AS name, -120e0 + (s_suppkey % 50) / 10e0 AS lon, 40e0 + s_nationkey / 5e0 AS lat, n_name AS nation, s_suppkey
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_add("p12_bbox_filter", lambda s, d: B.within(stations(s, d), (-119.0, 41.0, -117.0, 43.0)).select("triplet", "lon", "lat"), f"WITH {_STATIONS} SELECT triplet, lon, lat FROM stations WHERE lon BETWEEN -119 AND -117 AND lat BETWEEN 41 AND 43")
_add("o2_page", lambda s, d: B.page(stations(s, d), 10, 25)[0].select("triplet", "name"), f"WITH {_STATIONS} SELECT triplet, name FROM stations ORDER BY triplet LIMIT 25 OFFSET 10")
_add("f1_triplet_codec", lambda s, d: stations(s, d).select("triplet", N.stem_of_triplet(F.col("triplet")).alias("stem"), N.triplet_of_stem(N.stem_of_triplet(F.col("triplet"))).alias("back")), f"WITH {_STATIONS} SELECT triplet, replace(triplet, ':', '_') AS stem, triplet AS back FROM stations")
_add("f2_triplet_validity", lambda s, d: stations(s, d).select("name", N.is_triplet(F.when(F.col("s_suppkey") % 3 == 0, F.lower("triplet")).otherwise(F.col("triplet"))).alias("valid")), f"WITH {_STATIONS} SELECT name, regexp_matches(CASE WHEN s_suppkey % 3 = 0 THEN lower(triplet) ELSE triplet END, '^[A-Za-z0-9_-]+:[A-Z][A-Z]:[A-Z]+$') AS valid FROM stations")


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage = F.create_map(F.lit("snodas"), F.lit("full"), F.lit("swann"), F.when(F.col("s_suppkey") % 2 == 0, "partial").otherwise("none"))
    return stations(spark, sf_dir).withColumn("coverage", coverage)


_add("p14_active_coverage", lambda s, d: _covered(s, d).select("triplet", O.flattened(B.active_coverage(F.col("coverage"), ["swann"]), "map").alias("coverage")), f"WITH {_STATIONS} SELECT triplet, 'swann=' || CASE WHEN s_suppkey % 2 = 0 THEN 'partial' ELSE 'none' END AS coverage FROM stations")
_add(
    "j12_coverage_fold",
    lambda s, d: B.folded_coverage(_covered(s, d), "instarr", stations(s, d).where("s_suppkey % 5 = 0").select("triplet", F.lit("full").alias("coverage"))).select("triplet", O.flattened(F.col("coverage"), "map").alias("coverage")),
    f"WITH {_STATIONS} SELECT triplet, 'instarr=' || CASE WHEN s_suppkey % 5 = 0 THEN 'full' ELSE 'none' END || ', snodas=full, swann=' || CASE WHEN s_suppkey % 2 = 0 THEN 'partial' ELSE 'none' END AS coverage FROM stations",
)
_add("f41_map_flatten", lambda s, d: _covered(s, d).select("triplet", O.flattened(F.col("coverage"), "map").alias("text")), f"WITH {_STATIONS} SELECT triplet, 'snodas=full, swann=' || CASE WHEN s_suppkey % 2 = 0 THEN 'partial' ELSE 'none' END AS text FROM stations")


def _drift(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of suppliers, pixels of customers' keys: neither has all of the other."""
    records = stations(spark, sf_dir).where("s_suppkey % 4 <> 0").select("triplet")
    pixels_of = stations(spark, sf_dir).where("s_suppkey % 3 <> 0").select(F.col("triplet").alias("basin"), F.when(F.col("s_suppkey") % 5 == 0, 0.0).otherwise(1.0).alias("area_m2"))
    return records, pixels_of


_DRIFT = f"WITH {_STATIONS}, rec AS (SELECT triplet FROM stations WHERE s_suppkey % 4 <> 0), burned AS (SELECT triplet, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS area FROM stations WHERE s_suppkey % 3 <> 0) "
_add("j9_record_without_raster", lambda s, d: D.without_pixels(*_drift(s, d)), _DRIFT + "SELECT triplet FROM rec EXCEPT SELECT triplet FROM burned")
_add("j9_raster_without_record", lambda s, d: D.without_record(*_drift(s, d)[::-1]), _DRIFT + "SELECT triplet FROM burned EXCEPT SELECT triplet FROM rec")


def _basin_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, burned = _drift(spark, sf_dir)
    states = stations(spark, sf_dir).select("triplet", F.when(F.col("s_suppkey") % 7 == 0, "partial").when(F.col("s_suppkey") % 11 == 0, "none").otherwise("full").alias("coverage"))
    return D.basin_findings("demo", records, burned, states)


_BASIN_FINDINGS = """SELECT 'pourpoints' AS "check", 'demo' AS dataset, triplet AS target, 'no raster' AS issue FROM rec WHERE triplet NOT IN (SELECT triplet FROM burned)
    UNION ALL SELECT 'pourpoints', 'demo', triplet, 'orphan raster' FROM burned WHERE triplet NOT IN (SELECT triplet FROM rec)
    UNION ALL SELECT 'pourpoints', 'demo', triplet, 'partial coverage' FROM stations WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'pourpoints', 'demo', triplet, 'no coverage' FROM stations WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 = 0
    UNION ALL SELECT 'pourpoints', 'demo', triplet, 'empty basin: it does not meet the grid, or is all masked' FROM burned WHERE area = 0"""
_add("m15_basin_findings", _basin_findings, _DRIFT + _BASIN_FINDINGS)
_add(
    "u2_findings_union",
    lambda s, d: D.health({"dates": lambda: D.completeness_findings(_listing(s, d), "demo", ["A", "N"], SPRING), "pourpoints": lambda: _basin_findings(s, d)}),
    _DRIFT + f""", {_LISTING}, n AS (SELECT date, count(*) FILTER (variable = 'A') AS a, count(*) FILTER (variable = 'N') AS n FROM listing WHERE {_PREDICATE["spring"]} GROUP BY date) {_BASIN_FINDINGS}
    UNION ALL SELECT 'dates', 'demo', CAST(date AS VARCHAR), 'missing ' || concat_ws(', ', CASE WHEN a <> 1 THEN 'A' END, CASE WHEN n <> 1 THEN 'N' END) FROM n WHERE a <> 1 OR n <> 1""",
)
_add(
    "j10_record_changes",
    lambda s, d: B.changes(stations(s, d).where("s_suppkey % 4 <> 0").select("triplet", F.col("name").alias("geometry_hash")), stations(s, d).where("s_suppkey % 3 <> 0").select("triplet", F.when(F.col("s_suppkey") % 5 == 0, "new").otherwise(F.col("name")).alias("geometry_hash"))),
    f"WITH {_STATIONS} SELECT triplet, CASE WHEN s_suppkey % 3 = 0 THEN 'prune' WHEN s_suppkey % 4 = 0 THEN 'add' WHEN s_suppkey % 5 = 0 THEN 'update' ELSE 'keep' END AS change FROM stations WHERE s_suppkey % 4 <> 0 OR s_suppkey % 3 <> 0",
)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation")
    west, south = F.col("n_nationkey") * 2.0 - 130, F.col("n_regionkey") * 3.0 + 35
    return nation.select(F.col("n_name").alias("dataset"), west.alias("origin_x"), (south + 2.0).alias("origin_y"), F.lit(0.1).alias("pixel"), (F.lit(10) + F.col("n_nationkey")).alias("cols"), F.lit(20).alias("rows"))


_add("a21_combined_extent", lambda s, d: G.combined_extent(_boxes(s, d)).select(*[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")]), "SELECT round(min(n_nationkey * 2e0 - 130), 6) AS west, round(min(n_regionkey * 3e0 + 35), 6) AS south, round(max(n_nationkey * 2e0 - 130 + (10 + n_nationkey) * 0.1e0), 6) AS east, round(max(n_regionkey * 3e0 + 37), 6) AS north FROM nation")


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of 2 degrees about each station."""
    x, y = F.col("lon"), F.col("lat")
    ring = F.array(*[F.array(x + dx, y + dy) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    return stations(spark, sf_dir).select("triplet", F.array(ring).alias("rings"))


_add(
    "f28_coverage_class",
    lambda s, d: B.coverage(_squares(s, d), [(-119.5, 40.5, -116.5, 43.5)]),
    f"WITH {_STATIONS} SELECT triplet, CASE WHEN lon - 1 >= -119.5 AND lon + 1 <= -116.5 AND lat - 1 >= 40.5 AND lat + 1 <= 43.5 THEN 'full' WHEN lon + 1 >= -119.5 AND lon - 1 <= -116.5 AND lat + 1 >= 40.5 AND lat - 1 <= 43.5 THEN 'partial' ELSE 'none' END AS coverage FROM stations",
)


def _triangle(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("1:MT:USGS", [[[-119.95, 44.95], [-119.55, 44.85], [-119.8, 44.65], [-119.95, 44.95]]])], "triplet string, rings array<array<array<double>>>")


_add(
    "j6_point_in_polygon",
    lambda s, d: B.burned(_triangle(s), GRID).join(pixels(s, d).select("pixel_id"), "pixel_id", "left_semi").select("basin", "pixel_id"),
    """WITH e(x1, y1, x2, y2) AS (VALUES (-119.95e0, 44.95e0, -119.55e0, 44.85e0), (-119.55e0, 44.85e0, -119.8e0, 44.65e0), (-119.8e0, 44.65e0, -119.95e0, 44.95e0)),
    p AS (SELECT p_partkey AS pixel_id, -120e0 + (p_partkey % 50 + 0.5e0) * 0.01e0 AS x, 45e0 - (p_partkey // 50 + 0.5e0) * 0.01e0 AS y FROM part)
    SELECT '1:MT:USGS' AS basin, pixel_id FROM p, e GROUP BY pixel_id HAVING count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1""",
)

SINUSOIDAL, CONIC = G.Grid(-10.6e6, 5.15e6, 10_000.0, 190, 90, 32, G.SINUSOIDAL_CRS), G.Grid(-2.25e6, 3.0e6, 10_000.0, 100, 120, 32, G.ALBERS_CRS)
_CORNERS = ((-1.0, -0.8), (1.2, -0.5), (0.1, 0.9))


def _wedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle of some degrees about each station."""
    ring = F.array(*[F.array(F.col("lon") + dx, F.col("lat") + dy) for dx, dy in (*_CORNERS, _CORNERS[0])])
    return stations(spark, sf_dir).select("triplet", F.array(ring).alias("rings"))


def _burned_sql(grid: G.Grid, placed: str) -> str:
    """Ray casting in longitude and latitude, with each pixel's centre taken back there."""
    sides = ", ".join(f"({ax}e0, {ay}e0, {bx}e0, {by}e0)" for (ax, ay), (bx, by) in zip(_CORNERS, (*_CORNERS[1:], _CORNERS[0]), strict=True))
    return f"""WITH {_STATIONS}, side(px, py, qx, qy) AS (VALUES {sides}),
    centres AS (SELECT range AS pixel_id, {grid.origin_x}e0 + (range % {grid.cols} + 0.5e0) * {grid.pixel}e0 AS x, {grid.origin_y}e0 - (range // {grid.cols} + 0.5e0) * {grid.pixel}e0 AS y FROM range({grid.rows * grid.cols})),
    {placed},
    near AS (SELECT triplet, pixel_id, p.lon AS x, p.lat AS y, s.lon, s.lat FROM stations s JOIN places p ON p.lon BETWEEN s.lon - 1.3 AND s.lon + 1.3 AND p.lat BETWEEN s.lat - 1 AND s.lat + 1)
    SELECT triplet AS basin, pixel_id FROM near, side GROUP BY triplet, pixel_id
    HAVING count(*) FILTER ((lat + py > y) <> (lat + qy > y) AND x < (qx - px) * (y - lat - py) / (qy - py) + lon + px) % 2 = 1"""


_add(
    "f25_burn_sinusoidal",
    lambda s, d: B.burned(_wedges(s, d), SINUSOIDAL, bend=1e-6).select("basin", "pixel_id"),
    _burned_sql(SINUSOIDAL, "places AS (SELECT pixel_id, degrees(x / (6371007.181e0 * cos(y / 6371007.181e0))) AS lon, degrees(y / 6371007.181e0) AS lat FROM centres)"),
)
_LATITUDE = "phi + (1 - e2 * sin(phi) ** 2) ** 2 / (2 * cos(phi)) * (q / (1 - e2) - sin(phi) / (1 - e2 * sin(phi) ** 2) + ln((1 - e * sin(phi)) / (1 + e * sin(phi))) / (2 * e))"
_CONE = f"""ell AS (SELECT sqrt(f * (2 - f)) AS e, f * (2 - f) AS e2 FROM (SELECT 1 / 298.257222101e0 AS f)),
    at_lat AS (SELECT phi, e, e2, cos(phi) / sqrt(1 - e2 * sin(phi) ** 2) AS m, (1 - e2) * (sin(phi) / (1 - e2 * sin(phi) ** 2) - ln((1 - e * sin(phi)) / (1 + e * sin(phi))) / (2 * e)) AS q FROM ell, (SELECT unnest([radians(23e0), radians(29.5e0), radians(45.5e0)]) AS phi)),
    three AS (SELECT e, e2, list(m ORDER BY phi) AS m, list(q ORDER BY phi) AS q FROM at_lat GROUP BY e, e2),
    cone AS (SELECT e, e2, n, m[2] ** 2 + n * q[2] AS c, 6378137e0 * sqrt(m[2] ** 2 + n * q[2] - n * q[1]) / n AS rho FROM (SELECT *, (m[2] ** 2 - m[3] ** 2) / (q[3] - q[2]) AS n FROM three)),
    p0 AS (SELECT pixel_id, e, e2, degrees(atan2(x, rho - y) / n) - 96 AS lon, (c - (x ** 2 + (rho - y) ** 2) * n ** 2 / 6378137e0 ** 2) / n AS q FROM centres, cone),
    p1 AS (SELECT *, asin(q / 2) AS phi FROM p0), p2 AS (SELECT * REPLACE ({_LATITUDE} AS phi) FROM p1), p3 AS (SELECT * REPLACE ({_LATITUDE} AS phi) FROM p2), p4 AS (SELECT * REPLACE ({_LATITUDE} AS phi) FROM p3),
    p5 AS (SELECT * REPLACE ({_LATITUDE} AS phi) FROM p4), places AS (SELECT pixel_id, lon, degrees(phi) AS lat FROM p5)"""
_add("f27_burn_albers", lambda s, d: B.burned(_wedges(s, d), CONIC, bend=1e-6).select("basin", "pixel_id"), _burned_sql(CONIC, _CONE))

#: A footprint of slanted tiles, three by three, of which the middle and one corner are absent.
_SLANT = lambda i, j: (-121.03 + 1.5 * i + 0.4 * j, 40.23 + 0.15 * i + 1.3 * j)
_ABSENT = ((1, 1), (2, 2))
FOOTPRINT = [[[_SLANT(i, j), _SLANT(i + 1, j), _SLANT(i + 1, j + 1), _SLANT(i, j + 1), _SLANT(i, j)]] for i in range(3) for j in range(3) if (i, j) not in _ABSENT]


def _footprint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = P.band_height(FOOTPRINT)
    return P.covered(B.edges(_wedges(spark, sf_dir)), P.outline(P.polygon_edges(spark, FOOTPRINT), band, 1e-9), band, 1e-9)


_SHAPES = f"""tile(i, j, there, size) AS (SELECT i.range, j.range, (i.range, j.range) NOT IN ((1, 1), (2, 2)), 1 FROM range(3) i, range(3) j UNION ALL SELECT 0, 0, TRUE, 3),
    quad AS (SELECT i, j, there, size, k, -121.03e0 + 1.5e0 * (i + di * size) + 0.4e0 * (j + dj * size) AS x, 40.23e0 + 0.15e0 * (i + di * size) + 1.3e0 * (j + dj * size) AS y FROM tile, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) AS c(k, di, dj)),
    tri AS (SELECT triplet, k, lon + dx AS x, lat + dy AS y FROM stations, (VALUES {", ".join(f"({k}, {dx}e0, {dy}e0)" for k, (dx, dy) in enumerate(_CORNERS))}) AS c(k, dx, dy)),
    qe AS (SELECT a.i, a.j, a.there, a.size, a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM quad a JOIN quad b ON a.i = b.i AND a.j = b.j AND a.size = b.size AND b.k = (a.k + 1) % 4),
    te AS (SELECT a.triplet, a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM tri a JOIN tri b ON a.triplet = b.triplet AND b.k = (a.k + 1) % 3),
    by_quad AS (SELECT triplet, i, j, there, size, bool_or(apart) AS apart, bool_and(within) AS within FROM (
        SELECT t.triplet, i, j, there, size, e.k, bool_and((x2 - x1) * (t.y - y1) - (y2 - y1) * (t.x - x1) < 0) AS apart, bool_and((x2 - x1) * (t.y - y1) - (y2 - y1) * (t.x - x1) >= 0) AS within FROM qe e, tri t GROUP BY ALL) GROUP BY ALL),
    by_tri AS (SELECT triplet, i, j, size, bool_or(apart) AS apart FROM (
        SELECT e.triplet, i, j, size, e.k, bool_and((x2 - x1) * (q.y - y1) - (y2 - y1) * (q.x - x1) < 0) AS apart FROM te e, quad q GROUP BY ALL) GROUP BY ALL),
    met AS (SELECT q.*, NOT (q.apart OR t.apart) AS meets FROM by_quad q JOIN by_tri t USING (triplet, i, j, size))"""
_add(
    "j7_footprint_coverage",
    _footprint_coverage,
    f"""WITH {_STATIONS}, {_SHAPES}
    SELECT triplet, CASE WHEN bool_or(within) FILTER (size = 3) AND NOT bool_or(meets) FILTER (NOT there) THEN 'full' WHEN bool_or(meets) FILTER (there AND size = 1) THEN 'partial' ELSE 'none' END AS coverage FROM met GROUP BY triplet""",
)
_add("f24_cell_area", lambda s, d: pixels(s, d).select("row").distinct().select("row", F.round(GRID.cell_area(F.col("row")), 3).alias("area_m2")), """WITH r AS (SELECT DISTINCT p_partkey // 50 AS "row" FROM part), k AS (SELECT sqrt(f * (2 - f)) AS e, 6378137e0 * (1 - f) AS b FROM (SELECT 1 / 298.257223563e0 AS f)),
    s AS (SELECT "row", e, b, sin(radians(45e0 - "row" * 0.01e0)) AS n, sin(radians(45e0 - ("row" + 1) * 0.01e0)) AS s FROM r, k)
    SELECT CAST("row" AS INT) AS "row", round(abs(b * b / 2 * (n / (1 - e * e * n * n) + ln((1 + e * n) / (1 - e * n)) / (2 * e)) - b * b / 2 * (s / (1 - e * e * s * s) + ln((1 + e * s) / (1 - e * s)) / (2 * e))) * radians(0.01e0), 3) AS area_m2 FROM s""")
_add("f18_point_to_cell", lambda s, d: stations(s, d).select("triplet", *[c.alias(n) for c, n in zip(G.Grid(-119.0, 44.0, 0.25, 12, 10, 4).cell(F.col("lon"), F.col("lat")), ("row", "col"), strict=True)]), f"""WITH {_STATIONS}, c AS (SELECT triplet, CAST(floor((lon + 119) / 0.25) AS INT) AS c, CAST(floor((44 - lat) / 0.25) AS INT) AS r FROM stations)
    SELECT triplet, CASE WHEN r BETWEEN 0 AND 9 AND c BETWEEN 0 AND 11 THEN r END AS "row", CASE WHEN r BETWEEN 0 AND 9 AND c BETWEEN 0 AND 11 THEN c END AS col FROM c""")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.Grid(-119.0, 44.0, 0.25, 12, 10, 4)
    w = g.bounding_tiles(F.col("lon") - 0.6, F.col("lat") - 0.6, F.col("lon") + 0.6, F.col("lat") + 0.6)
    return stations(spark, sf_dir).select("triplet", w.alias("w")).select("triplet", F.when(F.col("w").isNotNull(), G.window_tag(F.col("w"))).alias("tag"), F.array_join(F.transform(g.tiles_in(F.col("w")), lambda x: x.cast("string")), ",").alias("tiles"))


_WINDOWS = f"""WITH {_STATIONS}, t AS (SELECT triplet, lon - 0.6e0 < -116 AND lon + 0.6e0 > -119 AND lat - 0.6e0 < 44 AND lat + 0.6e0 > 41.5 AS ok, greatest(0, least(2, CAST(floor((44 - (lat + 0.6e0)) / 1) AS INT))) AS r0, greatest(0, least(2, CAST(floor((lon - 0.6e0 + 119) / 1) AS INT))) AS c0,
    greatest(0, least(2, CAST(ceil((44 - (lat - 0.6e0)) / 1) AS INT) - 1)) AS r1, greatest(0, least(2, CAST(ceil((lon + 0.6e0 + 119) / 1) AS INT) - 1)) AS c1 FROM stations) """
_add("f10_window_of_tag", lambda s, d: _windows(s, d).select("triplet", G.window_tag(G.window_of_tag(F.concat(F.lit(" "), "tag"))).alias("tag")).where("tag <> ''"), _WINDOWS + "SELECT triplet, r0 || ' ' || c0 || ' ' || r1 || ' ' || c1 AS tag FROM t WHERE ok")


def _offset_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a station's own pixel stands in the array of the tiles around it."""
    g = G.Grid(-119.0, 44.0, 0.25, 12, 10, 4)
    w = g.bounding_tiles(F.col("lon") - 0.6, F.col("lat") - 0.6, F.col("lon") + 0.6, F.col("lat") + 0.6)
    row, col = g.cell(F.col("lon"), F.col("lat"))
    r, c = G.place_offset(F.col("w"), F.col("r"), F.col("c"), g.tile)
    return stations(spark, sf_dir).select("triplet", w.alias("w"), row.alias("r"), col.alias("c")).where("w is not null and r is not null and c is not null").select("triplet", r.alias("row"), c.alias("col"))


_add("f22_place_offset", _offset_in_window, _WINDOWS + """, c AS (SELECT triplet, CAST(floor((lon + 119) / 0.25) AS INT) AS c, CAST(floor((44 - lat) / 0.25) AS INT) AS r FROM stations)
    SELECT triplet, r - r0 * 4 AS "row", c - c0 * 4 AS col FROM t JOIN c USING (triplet) WHERE ok AND r BETWEEN 0 AND 9 AND c BETWEEN 0 AND 11""")
_add("f20_bounding_tiles", lambda s, d: _windows(s, d).select("triplet", "tag"), _WINDOWS + "SELECT triplet, CASE WHEN ok THEN r0 || ' ' || c0 || ' ' || r1 || ' ' || c1 END AS tag FROM t")
_add("f21_tiles_in_bbox", lambda s, d: _windows(s, d).where("tag is not null").select("triplet", "tiles"), _WINDOWS + ", x AS (SELECT triplet, r.range AS r, c.range AS c FROM t, range(3) r, range(3) c WHERE ok AND r.range BETWEEN r0 AND r1 AND c.range BETWEEN c0 AND c1) SELECT triplet, string_agg(CAST(r * 3 + c AS VARCHAR), ',' ORDER BY r, c) AS tiles FROM x GROUP BY triplet")
_add("f7_tile_name", lambda s, d: stations(s, d).select("triplet", N.tile_name(F.floor("lat"), F.floor("lon")).alias("tile")), f"WITH {_STATIONS} SELECT triplet, printf('n%02dw%03d', CAST(floor(lat) AS INT) + 1, CAST(-floor(lon) AS INT)) AS tile FROM stations")
_add(
    "s16_candidate_tiles",
    lambda s, d: _squares(s, d).select("triplet", F.explode(N.tiles_of(F.col("rings")[0][0][0], F.col("rings")[0][0][1], F.col("rings")[0][2][0], F.col("rings")[0][2][1])).alias("tile")),
    f"""WITH {_STATIONS} SELECT triplet, printf('n%02dw%03d', CAST(a AS INT) + 1, CAST(-b AS INT)) AS tile FROM (
        SELECT triplet, unnest(range(CAST(floor(lat - 1) AS BIGINT), CAST(ceil(lat + 1) AS BIGINT))) AS a, lon FROM stations) x, LATERAL (SELECT unnest(range(CAST(floor(x.lon - 1) AS BIGINT), CAST(ceil(x.lon + 1) AS BIGINT))) AS b)""",
)


def _snodas_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(c) for c in ("1034", "1036", "1025", "9999")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    stem = F.concat(F.lit("us_ssmv1"), code, F.lit("1SlL0"), (F.col("o_orderkey") % 2).cast("string"), F.lit("T0001TTNATS"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("05HP001"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit("junk")).otherwise(F.regexp_replace(stem, "1SlL0", "SlL0")).alias("stem"))


_add(
    "f8_filename_parse",
    lambda s, d: N.snodas_names(_snodas_stems(s, d)).select("o_orderkey", "region", "product_code", "vcode", "date", "hour", "product"),
    """SELECT o_orderkey, CASE WHEN ok THEN 'us' END AS region, CASE WHEN ok THEN code END AS product_code, CASE WHEN ok THEN 'lL0' || (o_orderkey % 2) END AS vcode, CASE WHEN ok THEN CAST(o_orderdate AS DATE) END AS date, CASE WHEN ok THEN 5 END AS hour,
    CASE WHEN ok THEN CASE code WHEN 1034 THEN 'swe' WHEN 1036 THEN 'depth' WHEN 1025 THEN CASE o_orderkey % 2 WHEN 0 THEN 'precip_liquid' ELSE 'precip_solid' END END END AS product
    FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 5 <> 0 AS ok, [1034, 1036, 1025, 9999][o_orderkey % 4 + 1] AS code FROM orders)""",
)
_add("f9_format_version", lambda s, d: _read(s, d, "orders").select("o_orderkey", N.format_version(F.when(F.col("o_orderkey") % 3 == 0, "v3:abc").when(F.col("o_orderkey") % 3 == 1, "legacy").otherwise("vx:1")).alias("version")), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 3 END AS version FROM orders")
_add(
    "f6_csv_filename",
    lambda s, d: stations(s, d).select("triplet", F.explode(F.array(*[N.csv_names(F.col("triplet"), q, n) for q, n in ((SPRING, 0), (APRIL_1, 2), (DateRange(), 1))])).alias("name")),
    f"WITH {_STATIONS} SELECT triplet, replace(triplet, ':', '_') || unnest(['_1996-03-01-1996-05-31.csv', '_4-1_1995-2000_zonal_2.csv', '_open-open_zonal_1.csv']) AS name FROM stations",
)


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pixels by tiles of 20 rows and 25 columns; one tile is absent."""
    p = pixels(spark, sf_dir)
    return p.select(F.floor(F.col("col") / 25).cast("int").alias("h"), F.floor(F.col("row") / 20).cast("int").alias("v"), (F.col("row") % 20).alias("row"), (F.col("col") % 25).alias("col"), F.col("forest_cover").alias("value")).where("not (h = 1 and v = 1)")


def _offsets(tiles: DataFrame) -> DataFrame:
    return tiles.select("h", "v").distinct().select("h", "v", (F.col("v") * 20).alias("row_off"), (F.col("h") * 25).alias("col_off"))


_add("s15_mosaic_offsets", lambda s, d: I.mosaic(_tiles(s, d), _offsets(_tiles(s, d)), 255), f'WITH {PIXELS_SQL} SELECT CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, CAST(forest_cover AS INT) AS value FROM pixels WHERE NOT (col >= 25 AND "row" BETWEEN 20 AND 39) AND forest_cover <> 255')


def _skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    incoming = days.select("date", F.array(F.lit("swe"), F.lit("depth")).alias("variables"), F.concat(F.lit("v1:"), F.when(F.dayofmonth("date") % 3 == 0, "changed").otherwise("same")).alias("source_hash"))
    manifest = days.where(F.month("date") % 2 == 0).select("date", F.explode(F.array(F.lit("swe"), F.lit("depth"))).alias("variable"), F.lit("v1:same").alias("source_hash"))
    return I.decisions(incoming, manifest).select("date", "action")


_add("s21_skip_decision", _skip, f"WITH {_ORDER_DAYS} SELECT date, CASE WHEN month(date) % 2 = 0 AND day(date) % 3 <> 0 THEN 'skip' ELSE 'write' END AS action FROM days")
_add(
    "a20_tiles_by_date",
    lambda s, d: I.tiles_by_date(_read(s, d, "lineitem").withColumn("date", F.col("l_shipdate").cast("date")), F.col("l_returnflag"), F.col("l_suppkey"), F.col("l_linenumber")).select("date", F.col("n").alias("tiles"), F.array_join("kinds", ",").alias("kinds")),
    "SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS tiles, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds FROM lineitem GROUP BY 1",
)


def _geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.format_string('{"type":"Point","coordinates":[%s,%s]}', "lon", "lat")
    polygon = F.lit('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}')
    head = F.format_string('"id":"%s","properties":{"name":"%s"}', "triplet", "name")
    text = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit('{"type":"Feature",'), head, F.lit(',"geometry":'), point, F.lit("}"))).when(F.col("s_suppkey") % 4 == 1, F.lit("not json")).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit('{"type":"GeometryCollection",'), head, F.lit(',"geometries":['), point, F.lit("]}")))
    text = text.otherwise(F.concat(F.lit('{"type":"GeometryCollection",'), head, F.lit(',"geometries":['), point, F.lit(","), polygon, F.lit("]}")))
    return stations(spark, sf_dir).select(F.col("name").alias("path"), text.alias("json"))


_add("f36_source_classify", lambda s, d: B.parse_records(_geojson(s, d)).select("path", "status", "triplet"), f"WITH {_STATIONS} SELECT name AS path, ['skipped', 'invalid', 'invalid', 'import'][s_suppkey % 4 + 1] AS status, CASE WHEN s_suppkey % 4 <> 1 THEN triplet END AS triplet FROM stations")
_add(
    "s27_index_features",
    lambda s, d: B.feature_json(_covered(s, d).select("triplet", "name", "lon", "lat", F.lit(1.5).alias("area_meters"), F.lit("h").alias("geometry_hash"), "coverage")),
    f"""WITH {_STATIONS} SELECT triplet, '{{"type":"Feature","id":"' || triplet || '","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}},"properties":{{"name":"' || name
        || '","area_meters":1.5,"geometry_hash":"h","coverage":{{"snodas":"full","swann":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'partial' ELSE 'none' END || '"}}}}}}' AS feature FROM stations""",
)
_add(
    "s11_archive_problems",
    lambda s, d: N.snodas_problems(N.snodas_names(_snodas_stems(s, d)).withColumn("archive", F.col("o_orderkey") % 100)).select("archive", "problem"),
    """WITH parsed AS (
        SELECT o_orderkey % 100 AS archive, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS date,
            CASE WHEN o_orderkey % 5 <> 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'swe' WHEN 1 THEN 'depth' WHEN 2 THEN CASE o_orderkey % 2 WHEN 0 THEN 'precip_liquid' ELSE 'precip_solid' END END END AS product
        FROM orders),
    each AS (SELECT archive, count(*) FILTER (product IS NULL OR date IS NULL) AS bad, count(product) AS n, list(DISTINCT product) FILTER (product IS NOT NULL) AS have, count(DISTINCT date) AS dates FROM parsed GROUP BY archive),
    told AS (SELECT *, list_filter(['average_temp', 'depth', 'precip_liquid', 'precip_solid', 'runoff', 'sublimation', 'sublimation_blowing', 'swe'], lambda x: NOT list_contains(coalesce(have, []), x)) AS missing FROM each),
    problems AS (SELECT archive, CASE WHEN bad > 0 THEN 'a file name can''t be parsed' WHEN len(missing) > 0 THEN 'missing products: ' || array_to_string(missing, ', ') WHEN n > len(have) THEN 'a product comes twice' WHEN dates > 1 THEN 'more than one date' END AS problem FROM told)
    SELECT archive, problem FROM problems WHERE problem IS NOT NULL""",
)
