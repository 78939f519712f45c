"""Results as CSV, compact JSON and tables."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from firnline.plans.zonal import ZonalResult, cell_zones


def csv_columns(result: ZonalResult) -> DataFrame:
    """The result as text columns, as its CSV file has them: for one file, or for spark.write.csv at any size."""
    spark = result.rows.sparkSession
    names = ["date"]
    zones = cell_zones(result.axes)
    per_cell = [{k: v for layer, zone in zip(result.layers, cell, strict=True) for k, v in zone.columns(layer).items()} for cell in zones]
    header = list(per_cell[0])
    texts = F.broadcast(spark.createDataFrame([(i, *[x[h] for h in header]) for i, x in enumerate(per_cell)], "cell int" + "".join(f", t{k} string" for k in range(len(header)))))
    names += [*header, "area_m2", *[v.stat for v in result.variables]]
    number = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(_number_text(F.col(c).cast("double")))
    rows = result.rows.join(texts, "cell").orderBy("basin", "date", "cell")
    return rows.select(F.col("date").cast("string").alias("date"), *[F.col(f"t{k}").alias(h) for k, h in enumerate(header)], number("area_m2").alias("area_m2"), *[number(v.stat).alias(v.stat) for v in result.variables])


@F.pandas_udf(StringType())
def _number_text(numbers: pd.Series) -> pd.Series:
    """The fewest digits that tell a number, without an exponent from 0.0001 to below 1e16; a cast to text has one from 1e7."""
    return pd.Series([repr(x) for x in numbers.tolist()], dtype=object)


def iter_csv(result: ZonalResult) -> Iterator[str]:
    """CSV lines, the header first; rows come from the executors one partition at a time."""
    frame = csv_columns(result)

    def line(values: list[str]) -> str:
        out = io.StringIO()
        csv.writer(out).writerow(values)
        return out.getvalue()

    yield line(frame.columns)
    for row in frame.toLocalIterator():
        yield line(list(row))


def write_csv(result: ZonalResult, path: str) -> None:
    """A folder of CSV files with headers, written by the executors."""
    csv_columns(result).write.csv(path, header=True)


def matrix(result: ZonalResult) -> DataFrame:
    """basin, date, values: for each date an array over cells of the variables' values, null for none."""
    values = F.array(*[F.nanvl(F.col(v.stat), F.lit(None).cast("double")) for v in result.variables])
    packed = result.rows.groupBy("basin", "date").agg(F.array_sort(F.collect_list(F.struct("cell", values.alias("v")))).alias("cells"))
    return packed.select("basin", "date", F.transform("cells", lambda c: c["v"]).alias("values"))


def compact(result: ZonalResult, basin: str) -> dict[str, Any]:
    """One basin's result as a JSON object: zones and variables once, then a matrix for each date."""
    zones = cell_zones(result.axes)
    areas = {r["cell"]: r["area_m2"] for r in result.areas.where(F.col("basin") == basin).select("cell", "area_m2").collect()}  # at most max_cells rows
    shown = sorted(areas)
    days = matrix(result).where(F.col("basin") == basin).orderBy("date")
    return {
        "zone_layers": result.layers,
        "variables": [v.stat for v in result.variables],
        "zones": [{"zone": [z.reference(layer) for layer, z in zip(result.layers, zones[c], strict=True)], "area_m2": areas[c]} for c in shown],
        "results": {r["date"].isoformat(): [list(x) for x in r["values"]] for r in days.toLocalIterator()},
    }


def compact_json(result: ZonalResult, basin: str) -> str:
    return json.dumps(compact(result, basin), indent=2)


def long_rows(result: ZonalResult) -> DataFrame:
    """basin, date, cell, variable, value: the result unpivoted."""
    return result.rows.unpivot(["basin", "date", "cell"], [v.stat for v in result.variables], "variable", "value")


def pivoted(rows: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Long rows (keys, variable, value) with a column for each listed variable."""
    return rows.groupBy(*keys).pivot("variable", variables).agg(F.first("value"))


def emitted(frame: DataFrame, form: str) -> Iterator[str]:
    """A report's rows as lines of json, csv or tab-separated text; lists and maps are flattened except in json."""
    if form == "json":
        yield from frame.toJSON().toLocalIterator()
        return
    flat = frame.select(*[flattened(F.col(name), kind).alias(name) for name, kind in frame.dtypes])
    join = "\t" if form == "table" else ","
    out = io.StringIO()
    writer = csv.writer(out, delimiter=join)
    writer.writerow(flat.columns)
    yield out.getvalue()
    for row in flat.toLocalIterator():
        out = io.StringIO()
        csv.writer(out, delimiter=join).writerow(["" if x is None else x for x in row])
        yield out.getvalue()


def flattened(column: Column, kind: str) -> Column:
    """An array as `a, b`, a map as `k=v, l=w` in order of key, anything else as text."""
    if kind.startswith("array"):
        return F.array_join(F.transform(column, lambda x: x.cast("string")), ", ")
    if kind.startswith("map"):
        return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ", ")
    return column.cast("string")
