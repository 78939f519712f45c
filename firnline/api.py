"""The engine's questions as functions, one for each route of a service; what they give is ready to be sent as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline import errors
from firnline.functions.dates import DateQuery, DateRange, DayOfYear, parse_dates
from firnline.functions.names import csv_name
from firnline.operators import basins as B
from firnline.operators import diagnostics as D
from firnline.plans.output import compact, iter_csv
from firnline.sources.basins import BasinStore
from firnline.sources.catalog import Catalogue, Dataset
from firnline.sources.ingest import FORMAT
from firnline.sources.tables import exists

VERSION = "0.1.0"
POINT_PAGE, BASIN_PAGE, MOST_PAGE = 100, 25, 1000


class Service:
    """Answers from one catalogue and its basins. Tables are read anew for each question."""

    def __init__(self, catalogue: Catalogue, store: BasinStore):
        self.catalogue, self.store = catalogue, store

    def version(self) -> dict[str, str]:
        return {"version": VERSION}

    def problems(self) -> list[dict[str, Any]]:
        kinds = [e for e in vars(errors).values() if isinstance(e, type) and issubclass(e, errors.FirnlineError)]
        return [{"key": e.__name__, "status": e.status, "about": (e.__doc__ or "").strip()} for e in sorted(kinds, key=lambda e: e.__name__)]

    def problem(self, key: str) -> dict[str, Any]:
        """One kind of error by its key."""
        found = [p for p in self.problems() if p["key"] == key]
        if not found:
            raise errors.UnknownProblem(f"there is no problem {key}")
        return found[0]

    def datasets(self) -> list[dict[str, Any]]:
        return [{"name": name} for name in self.catalogue.active()]

    def dataset(self, name: str) -> dict[str, Any]:
        d = self.catalogue[name]
        zones = [{"layer": k, **layer.scheme.configured(d.zones.get(k)).described()} for k, layer in sorted(d.layers().items())]
        grid = {"crs": d.grid.crs, "cols": d.grid.cols, "rows": d.grid.rows, "pixel": d.grid.pixel, "extent": d.grid.extent}
        return {"name": name, "variables": [{"key": v.key, "unit": v.unit, "reducer": v.reducer, "stat": v.stat} for _, v in sorted(d.variables.items())], "zones": zones, "grid": grid}

    def dates(self, name: str, query: DateQuery | None = None) -> list[str]:
        listing = self.catalogue[name].table(self.catalogue.spark, "manifest")
        return [r[0].isoformat() for r in listing.where((query or DateRange()).predicate(F.col("date"))).select("date").distinct().orderBy("date").collect()]

    def pourpoints(self, offset: int = 0, limit: int | None = None, bbox: B.Box | None = None, with_basins: bool = False) -> dict[str, Any]:
        limit = limit or (BASIN_PAGE if with_basins else POINT_PAGE)
        if not 1 <= limit <= MOST_PAGE or offset < 0:
            raise errors.QueryError(f"a page has 1 to {MOST_PAGE} entries, from offset 0 on")
        rows, total = B.page(self.store.index.read(), offset, limit, bbox, self.store.records.read() if with_basins else None)
        return {"total": total, "features": [self._feature(r.asDict(recursive=True)) for r in rows.collect()]}

    def pourpoint(self, triplet: str) -> dict[str, Any]:
        rows = B.one_record(self.store.index.read(), triplet).join(self.store.records.read().select("triplet", "rings", "properties"), "triplet", "left")
        return self._feature(rows.first().asDict(recursive=True))

    def _feature(self, row: dict[str, Any]) -> dict[str, Any]:
        active = set(self.catalogue.active())
        geometry = {"type": "Polygon", "coordinates": row["rings"]} if row.get("rings") else {"type": "Point", "coordinates": [row["lon"], row["lat"]]}
        properties = {"name": row["name"], "area_meters": row["area_meters"], "coverage": {k: v for k, v in row["coverage"].items() if k in active}, **(row.get("properties") or {})}
        return {"type": "Feature", "id": row["triplet"], "geometry": geometry, "properties": properties}

    def stats(self, dataset: str, triplet: str, dates: DateQuery, variables: Sequence[str], zones: Sequence[str] = (), allow_partial: bool = False, include_empty: bool = False, form: str = "json") -> dict[str, Any] | Iterator[str]:
        """Compact JSON, or the lines of a CSV file."""
        result = self.catalogue.zonal_stats(dataset, triplet, dates, variables, zones, self.store.index.read(), allow_partial, include_empty)
        return compact(result, triplet) if form == "json" else iter_csv(result)

    def stats_date_range(self, dataset: str, triplet: str, datetime: str | None, variables: Sequence[str], **how: Any) -> Any:
        return self.stats(dataset, triplet, parse_dates(datetime), variables, **how)

    def stats_doy(self, dataset: str, triplet: str, month: int, day: int, start_year: int, end_year: int, variables: Sequence[str], **how: Any) -> Any:
        return self.stats(dataset, triplet, DayOfYear(month, day, start_year, end_year), variables, **how)

    def stats_file_name(self, triplet: str, dates: DateQuery, zones: Sequence[str]) -> str:
        return csv_name(triplet, dates, len(zones))

    def status(self) -> list[dict[str, Any]]:
        out = []
        for name in sorted(self.catalogue.datasets):
            d = self.catalogue.registered(name)
            try:
                row = D.status(d.table(self.catalogue.spark, "manifest").withColumn("dataset", F.lit(name))).first()
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                row = None
            out.append({"dataset": name, "active": d.active, "dates": row.dates if row else 0, "first": row.first_date.isoformat() if row else None, "last": row.last_date.isoformat() if row else None})
        return out

    def values(self, name: str, on: str | None = None) -> list[dict[str, Any]]:
        d = self.catalogue.registered(name)
        day = parse_dates(on).start if on else None
        mask = d.mask(self.catalogue.spark)
        pixels, observations = d.grid.rows * d.grid.cols, d.table(self.catalogue.spark, "observations")
        if mask is not None:
            pixels, observations = mask.select("pixel_id").distinct().count(), observations.join(mask.select("pixel_id").distinct(), "pixel_id", "left_semi")
        return [r.asDict() for r in D.value_ranges(observations, list(d.variables.values()), day, pixels).collect()]

    def doctor(self, name: str, checks: Sequence[str] | None = None) -> list[dict[str, str]]:
        return [r.asDict() for r in self.findings(name, checks).collect()]

    def findings(self, name: str, checks: Sequence[str] | None = None) -> DataFrame:
        """Findings about a dataset's grid, dates, files and basins, as rows; without a choice, of all that it has tables for."""
        d, spark = self.catalogue.registered(name), self.catalogue.spark
        records = self.store.records.read()
        dated = d.snapshot(spark).has_dates()
        there = [t for t in ("zone_pixels", "aoi_pixels") if exists(spark, f"{d.path}/{t}")] + ["observations"] * dated
        tables = {t: d.table(spark, t) for t in there}
        known = {
            "grid": lambda: D.lattice_findings(tables, name, d.grid),
            "dates": lambda: D.completeness_findings(d.table(spark, "manifest"), name, sorted(d.variables)),
            "files": lambda: self._file_findings(d, tables),
            "pourpoints": lambda: D.basin_findings(name, records.select("triplet"), tables["aoi_pixels"], d.coverage(records)),
        }
        missing = {"grid": not there, "dates": not dated, "pourpoints": "aoi_pixels" not in tables}
        has = {k: v for k, v in known.items() if not missing.get(k)}
        return D.health(has, checks) if has else spark.createDataFrame([], D.FINDING)

    def _file_findings(self, d: Dataset, tables: Mapping[str, DataFrame]) -> DataFrame:
        """Zone layers that are enabled but absent, dates and basins in another format version."""
        spark, wanted = self.catalogue.spark, {k: FORMAT for k in d.layers()}
        columns = tables["zone_pixels"].columns if "zone_pixels" in tables else []
        have = [(k, f"v{FORMAT}:") for k, layer in d.layers().items() if layer.column in columns]
        found = D.artifact_findings(spark.createDataFrame(have, "artifact string, tag string"), d.name, wanted)
        tags = []
        if d.snapshot(spark).has_dates():
            tags.append(d.table(spark, "manifest").select(F.concat_ws(" ", F.col("date").cast("string"), "variable").alias("artifact"), F.col("source_hash").alias("tag")))
        tags.append(self.store.pixels(d).read().select(F.col("basin").alias("artifact"), F.col("burn_hash").alias("tag")).distinct())
        for rows in tags:
            found = found.unionByName(D.stale_findings(rows, d.name, FORMAT))
        return found


def answer(service: Service, question: str, **how: Any) -> tuple[int, str]:
    """Status and JSON text of a question: an error gives its status and what it says."""
    try:
        return 200, json.dumps(getattr(service, question)(**how), default=str)
    except errors.FirnlineError as e:
        return e.status, json.dumps({"type": type(e).__name__, "status": e.status, "detail": str(e)})


