"""Queries over tables larger than the small ones, so that a fixed limit or an id prefix shows."""

import duckdb
from pyspark.sql import functions as F

from firnline import queries


def test_mosaic_has_the_pixels_of_every_row(spark, tmp_path):
    keys = [*range(7000), 2_500_049]  # the last lies far beyond the grid's 40,000 rows
    part = spark.createDataFrame([(k, "b", k % 60, 1000.0) for k in keys], "p_partkey long, p_brand string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["s15_mosaic_offsets"](spark, str(tmp_path)).select("row", "col", "value").collect())
    absent = lambda k: k % 89 == 0 or k % 50 >= 25 and 20 <= k // 50 < 40
    assert got == sorted((k // 50, k % 50, k % 60 * 2) for k in keys if not absent(k))


def test_bbox_filter_keeps_all_stations_in_the_box(spark, tmp_path):
    n = 250_000  # of which 105,000 lie in the box
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.lit("n").alias("s_name"), F.lit(10).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(10, "IRAN")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = queries.QUERIES["p12_bbox_filter"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    theirs = {t for (t,) in con.sql(f"SELECT triplet FROM ({queries.ORACLES['p12_bbox_filter']})").fetchall()}
    assert len(theirs) == n * 21 // 50 and {r.triplet for r in got.collect()} == theirs
