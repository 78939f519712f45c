"""The store of basins: records, their index, and their pixels on each dataset.

Tables are versioned, so a job can read what it replaces, and one that dies leaves the old version in force. Plans of
what changes are written beside them and read back, so no row of them passes the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.errors import QueryError, UnknownBasin
from firnline.operators import basins as B
from firnline.sources.catalog import Dataset, mask_digest
from firnline.sources.ingest import provenance_tag
from firnline.sources.tables import Table

RECORDS = "triplet string, name string, awdb_id string, usgs_id string, lon double, lat double, rings array<array<array<double>>>, polygons array<int>, properties map<string,string>, geometry_hash string"
INDEX = "triplet string, name string, lon double, lat double, area_meters double, geometry_hash string, coverage map<string,string>"
PIXELS = "basin string, row int, col int, pixel_id long, tile_id int, area_m2 float, burn_hash string"


class BasinStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.records = Table(spark, f"{path}/records", RECORDS)
        self.index = Table(spark, f"{path}/index", INDEX)

    def _kept_plan(self, name: str, plan: DataFrame) -> DataFrame:
        """A plan with a row for each station, as it was before what it reads is replaced."""
        table = Table(self.spark, f"{self.path}/plans/{name}")
        table.replace(plan)
        return table.read()

    def pixels(self, dataset: Dataset) -> Table:
        return Table(self.spark, f"{dataset.path}/burned", PIXELS)

    def sources(self, path: str) -> DataFrame:
        """path, json of GeoJSON files: one file, or all *.geojson of a folder."""
        return self.spark.read.option("wholetext", True).option("pathGlobFilter", "*.geojson").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))

    def import_(self, sources: DataFrame, datasets: Sequence[Dataset], dry_run: bool = False) -> DataFrame:
        """Add or replace the records of sources (path, json); gives path, status, reason, triplet of each source.

        Of several sources for one station the last by path counts. Records that sources don't name stay.
        """
        parsed = B.parse_records(sources)
        if not dry_run:
            incoming = self._incoming(parsed)
            kept = self.records.read().join(incoming.select("triplet"), "triplet", "left_anti")
            self.records.replace(kept.unionByName(incoming))
            self.reindex(datasets, full=False)
        return parsed.select("path", "status", "reason", "triplet")

    def sync(self, sources: DataFrame, datasets: Sequence[Dataset], dump_to: str | None = None, dry_run: bool = False) -> DataFrame:
        """Make the records those of the sources; gives triplet, change. Records that go are written to dump_to first.

        Without a place to dump them nothing is pruned, and nothing is written. A point-only source keeps its record.
        """
        parsed = B.parse_records(sources)
        incoming = self._incoming(parsed)
        present = parsed.where("status = 'skipped'").select("triplet").distinct()
        stored = self.records.read()
        planned = B.changes(stored, incoming).join(present.withColumn("_p", F.lit(True)), "triplet", "left")
        planned = planned.select("triplet", F.when((F.col("change") == "prune") & F.col("_p"), "keep").otherwise(F.col("change")).alias("change"))
        pruned = planned.where("change = 'prune'").select("triplet")
        if dry_run:
            return planned
        if not pruned.isEmpty():
            if dump_to is None:
                raise QueryError("records would be pruned: give a folder to dump them to")
            stored.join(pruned, "triplet", "left_semi").write.mode("overwrite").parquet(dump_to)
        outcome = self._kept_plan("sync", planned)
        pruned = outcome.where("change = 'prune'").select("triplet")
        kept = stored.join(incoming.select("triplet"), "triplet", "left_anti").join(pruned, "triplet", "left_anti")
        self.records.replace(kept.unionByName(incoming))
        self.reindex(datasets, full=False)
        return outcome

    def _incoming(self, parsed: DataFrame) -> DataFrame:
        latest = parsed.where("status = 'import'").groupBy("triplet").agg(F.max("path").alias("path"))
        rows = parsed.join(latest, ["triplet", "path"], "left_semi").withColumn("geometry_hash", B.wkb_hash(F.col("rings"), F.col("polygons")))
        return rows.dropDuplicates(["triplet"]).select("triplet", "name", "awdb_id", "usgs_id", "lon", "lat", "rings", "polygons", "properties", "geometry_hash")

    def remove(self, triplet: str, datasets: Sequence[Dataset], dry_run: bool = False) -> list[str]:
        """Take a basin out of records, index and pixels; tells what had it."""
        tables: Mapping[str, tuple[Table, str]] = {"records": (self.records, "triplet"), "index": (self.index, "triplet"), **{f"{d.name} pixels": (self.pixels(d), "basin") for d in datasets}}
        had = [name for name, (table, key) in tables.items() if not table.read().where(F.col(key) == triplet).isEmpty()]
        if not had:
            raise UnknownBasin(f"there is no basin {triplet}")
        for name in had if not dry_run else []:
            table, key = tables[name]
            table.replace(table.read().where(F.col(key) != triplet))
        return had

    def reindex(self, datasets: Sequence[Dataset], full: bool = True) -> None:
        """Build the index; unless full, entries whose geometry and datasets are unchanged are kept."""
        records = self.records.read().withColumn("status", F.lit("import"))
        coverages = {d.name: d.coverage(records) for d in datasets}
        self.index.replace(B.build_index(records, coverages, None if full else self.index.read()))

    def rasterise(self, dataset: Dataset, mask: DataFrame | None = None, rebuild: bool = False) -> DataFrame:
        """Burn the basins that are missing or stale on a dataset, and drop those without a record; gives triplet, action.

        What a basin's pixels depend on (outline, grid, mask) is hashed into them; the mask is the dataset's own unless one
        is given. Basins outside the dataset's domain are
        skipped. The dataset's aoi_pixels table becomes the pixels in force.
        """
        g = dataset.grid
        mask = dataset.mask(self.spark) if mask is None else mask
        tag = provenance_tag([F.col("geometry_hash"), F.lit(f"{g.origin_x} {g.origin_y} {g.pixel} {g.cols} {g.rows} {g.crs}"), F.lit(mask_digest(mask))])
        records = self.records.read().withColumn("burn_hash", tag)
        states = dataset.coverage(records)
        table = self.pixels(dataset)
        have = table.read()
        burned = have.select(F.col("basin").alias("triplet"), "burn_hash", F.lit(True).alias("_b")).distinct()
        plan = records.select("triplet", "burn_hash").join(states, "triplet").join(burned, ["triplet", "burn_hash"], "left")
        action = F.when(F.col("coverage") == "none", "outside").when(F.col("_b") & F.lit(not rebuild), "current").otherwise("burn")
        outcome = self._kept_plan(f"rasterise-{dataset.name}", plan.select("triplet", action.alias("action")))
        todo = records.join(outcome.where("action = 'burn'"), "triplet", "left_semi")
        fresh = B.burned(todo, g, mask).join(todo.select(F.col("triplet").alias("basin"), "burn_hash"), "basin")
        kept = have.join(outcome.where("action = 'current'").select(F.col("triplet").alias("basin")), "basin", "left_semi")
        columns = [c.split(" ")[0] for c in PIXELS.split(", ")]
        table.replace(kept.select(columns).unionByName(fresh.select(columns)))
        pixels = table.read().select("basin", "pixel_id", "tile_id", "area_m2").repartition("tile_id").sortWithinPartitions("basin", "pixel_id")
        Table(self.spark, f"{dataset.path}/aoi_pixels").replace(pixels)
        return outcome
