"""Names and their parts: stations, statistics, files, tiles, versions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.errors import SourceError
from firnline.functions.dates import DateQuery

TRIPLET = r"^[A-Za-z0-9_-]+:[A-Z]{2}:[A-Z]+$"


def stem_of_triplet(triplet: Column) -> Column:
    """A station's name as a file stem: id_ST_NET."""
    return F.translate(triplet, ":", "_")


def triplet_of_stem(stem: Column) -> Column:
    """The station of a file stem; an id may hold underscores, state and network hold none."""
    return F.regexp_replace(stem, r"^(.*)_([^_]*)_([^_]*)$", "$1:$2:$3")


def is_triplet(triplet: Column) -> Column:
    return triplet.rlike(TRIPLET)


def is_path(token: str) -> bool:
    """Whether a word stands for a configuration file rather than for a dataset's name."""
    return token.endswith(".json") or any(mark in token for mark in "/\\")


def output_name(stem: Column, key: Column) -> Column:
    """The name of one variable's file from its source's stem."""
    return F.concat(stem, F.lit("__"), key, F.lit(".tif"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a file glob with ?, * and [...]."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        close = glob.find("]", k + 2) if c == "[" else -1
        if close > 0:
            body = glob[k + 1 : close]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            k = close
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        k += 1
    return f"(?s)^{out}$"


def csv_name(triplet: str, query: DateQuery, zones: int) -> str:
    """The file name of a result: station, dates, number of zone axes."""
    return f"{triplet.replace(':', '_')}_{query.fragment()}{f'_zonal_{zones}' if zones else ''}.csv"


def csv_names(triplet: Column, query: DateQuery, zones: int) -> Column:
    """The file names of results for a column of stations."""
    return F.concat(F.replace(triplet, F.lit(":"), F.lit("_")), F.lit(csv_name("", query, zones)))


def tile_name(lat: Column, lon: Column) -> Column:
    """The name of the 1-degree elevation tile whose south-west corner is (lat, lon): by its north-west corner."""
    return F.format_string("n%02dw%03d", (lat + 1).cast("int"), (-lon).cast("int"))


def tiles_of(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Names of all 1-degree tiles that cover the bounds of a row, as an array."""
    lats, lons = F.sequence(F.floor(south), F.ceil(north) - 1), F.sequence(F.floor(west), F.ceil(east) - 1)
    return F.flatten(F.transform(lats, lambda lat: F.transform(lons, lambda lon: tile_name(lat, lon))))


def tiles_covering(spark: SparkSession, west: float, south: float, east: float, north: float) -> DataFrame:
    """tile: names of all 1-degree tiles that cover the bounds, each once, in order."""
    cells = spark.range(1).select(F.explode(F.sequence(F.floor(F.lit(south)), F.ceil(F.lit(north)) - 1)).alias("lat")).select("lat", F.explode(F.sequence(F.floor(F.lit(west)), F.ceil(F.lit(east)) - 1)).alias("lon"))
    return cells.select(tile_name(F.col("lat"), F.col("lon")).alias("tile")).distinct().orderBy("tile")


def format_version(tag: Column) -> Column:
    """The number of a tag v{number}:{digest}, null for any other."""
    return F.nullif(F.regexp_extract(tag, "^v([+-]?[0-9]+):", 1), F.lit("")).try_cast("int")


def versioned(version: int, digest: Column) -> Column:
    return F.concat(F.lit(f"v{version}:"), digest)


#: Fixed value: a daily raster's name by the archive's user guide. Groups: region, product, vertical code, day, hour.
SNODAS = r"^([a-z]{2})_[a-z]{3}v\d(\d{4})S?([a-zA-Z]{2}[\d_]{2})[AT](?:0001|0024)TTNATS(\d{8})(\d\d)[HD]P00[01]$"
#: How converted daily files and tiles are named.
SWANN = r"^UA_SWE_Depth_800m_v1_(\d{8})_(early|provisional|stable)\.nc$"
INSTARR = r"^SPIRES_NRT_h(\d\d)v(\d\d)_(MOD09GA\d+)_(\d{8})_(V[\d.]+)\.nc$"
#: Product code, version code (null: any) and variable of SNODAS files.
SNODAS_PRODUCTS: Sequence[tuple[int, str | None, str]] = (
    (1025, "lL00", "precip_liquid"),
    (1025, "lL01", "precip_solid"),
    (1034, None, "swe"),
    (1036, None, "depth"),
    (1038, None, "average_temp"),
    (1039, None, "sublimation_blowing"),
    (1044, None, "runoff"),
    (1050, None, "sublimation"),
)


def snodas_names(files: DataFrame, stem: str = "stem") -> DataFrame:
    """files with region, product_code, vcode, date, hour, product.

    The product is that of code and version code, else that of the code alone. Names of another form have null in all
    of these, as have impossible dates and unknown products in theirs.
    """
    region, code, vertical, day, hour = (F.nullif(F.regexp_extract(stem, SNODAS, k), F.lit("")) for k in range(1, 6))
    product = F.lit(None).cast("string")
    for number, vcode, name in SNODAS_PRODUCTS:
        product = F.when((code.cast("int") == number) & (F.lit(True) if vcode is None else vertical == vcode), name).otherwise(product)
    told = {"region": region, "product_code": code.cast("int"), "vcode": vertical, "date": F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date"), "hour": hour.cast("int"), "product": product}
    return files.select("*", *[value.alias(name) for name, value in told.items()])


def snodas_problems(parsed: DataFrame, hour: int = 5, region: str = "us") -> DataFrame:
    """archive, problem of each archive of parsed names that can't be taken in; archives without a problem are absent.

    An archive must hold every product once, one date, and only the given hour and region.
    """
    wanted = sorted({name for _, _, name in SNODAS_PRODUCTS})
    each = parsed.groupBy("archive").agg(
        F.count_if(F.col("product").isNull() | F.col("date").isNull()).alias("bad"), F.count("product").alias("n"), F.collect_set("product").alias("have"), F.count_distinct("date").alias("dates"),
        F.count_if(F.col("hour") != hour).alias("hours"), F.count_if(F.col("region") != region).alias("regions"),
    )
    missing = F.array_except(F.array(*[F.lit(w) for w in wanted]), "have")
    problem = (
        F.when(F.col("bad") > 0, "a file name can't be parsed").when(F.size(missing) > 0, F.concat(F.lit("missing products: "), F.array_join(missing, ", "))).when(F.col("n") > F.size("have"), "a product comes twice")
        .when(F.col("dates") > 1, "more than one date").when(F.col("hours") > 0, f"not all of hour {hour:02d}").when(F.col("regions") > 0, f"not all of region {region}")
    )
    return each.select("archive", problem.alias("problem")).where("problem is not null")


def require_sound(problems: DataFrame) -> None:
    """Raise for the first archives with a problem."""
    if found := problems.orderBy("archive").limit(5).collect():
        raise SourceError("; ".join(f"{r.archive}: {r.problem}" for r in found))
