"""Basins: records, index, pages, coverage by dataset domains, and burning onto grids."""

from __future__ import annotations

import itertools
import math
import struct
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from firnline.errors import CoverageError, NoBasin, UnknownBasin
from firnline.functions.grid import GEOGRAPHIC, Grid, ellipsoid_strip, reprojected
from firnline.functions.names import is_triplet

_RING = "array<array<double>>"
SOURCE_SCHEMA = (
    f"type string, id string, properties map<string,string>, "
    f"geometry struct<type: string, coordinates: string>, geometries array<struct<type: string, coordinates: string>>"
)


def parse_records(sources: DataFrame, text: str = "json", path: str = "path") -> DataFrame:
    """path, status, reason, triplet, name, awdb_id, usgs_id, lon, lat, rings, polygons, properties of GeoJSON texts.

    A record is a Feature with a Point (no basin: status skipped) or a GeometryCollection of exactly one Point and one
    Polygon or MultiPolygon (status import). All else is invalid, with a reason; one bad text spoils no other.
    rings: every ring of every polygon; a place is in the basin where an odd number of rings hold it. polygons: how many
    of them each polygon of a MultiPolygon has, null for a Polygon.
    """
    parsed = sources.select(path, F.from_json(F.col(text), SOURCE_SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select(path, "r.*")
    everything = F.when(F.col("type") == "Feature", F.array("geometry")).when(F.col("type") == "GeometryCollection", F.col("geometries"))
    points, areas = F.filter(everything, lambda g: g["type"] == "Point"), F.filter(everything, lambda g: g["type"].isin("Polygon", "MultiPolygon"))
    point = F.from_json(F.get(points, F.lit(0))["coordinates"], "array<double>")
    area = F.get(areas, F.lit(0))
    several = F.when(area["type"] == "MultiPolygon", F.from_json(area["coordinates"], f"array<array<{_RING}>>"))
    rings = F.when(area["type"] == "Polygon", F.from_json(area["coordinates"], f"array<{_RING}>")).otherwise(F.flatten(several))
    polygons = F.transform(several, lambda p: F.size(p))
    name = F.coalesce(F.nullif(F.col("properties")["nwccname"], F.lit("")), F.nullif(F.col("properties")["name"], F.lit("")))
    rows = parsed.select(
        path, F.col("type").alias("_type"), F.col("id").alias("triplet"), name.alias("name"), F.col("properties")["awdb_id"].alias("awdb_id"), F.col("properties")["usgs_id"].alias("usgs_id"),
        F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"), rings.alias("rings"), polygons.alias("polygons"), "properties", F.size(everything).alias("_n"), F.size(points).alias("_points"), F.size(areas).alias("_areas"),
    )
    collection = F.col("_type") == "GeometryCollection"
    broken = F.exists("rings", lambda ring: (F.size(ring) < 4) | F.exists(ring, lambda p: F.size(p) < 2))
    reason = (
        F.when(F.col("_type").isNull() | ~F.col("_type").isin("Feature", "GeometryCollection"), "no Feature or GeometryCollection")
        .when(F.col("triplet").isNull() | ~is_triplet(F.col("triplet")), "no station triplet as id")
        .when((F.col("_points") != 1) | F.col("lon").isNull() | F.col("lat").isNull(), "not exactly one point")
        .when(collection & ((F.col("_areas") != 1) | (F.col("_n") != 2)), "not exactly one point and one polygon")
        .when(~collection & (F.col("_n") != 1), "not exactly one geometry")
        .when(F.col("name").isNull(), "no name")
        .when(collection & (F.col("rings").isNull() | (F.size("rings") == 0) | broken), "a polygon that can't be read")
    )
    status = F.when(reason.isNotNull(), "invalid").when(collection, "import").otherwise("skipped")
    return rows.select(path, status.alias("status"), reason.alias("reason"), "triplet", "name", "awdb_id", "usgs_id", "lon", "lat", F.when(collection, F.col("rings")).alias("rings"), F.when(collection, F.col("polygons")).alias("polygons"), "properties")


def edges(basins: DataFrame, key: str = "triplet") -> DataFrame:
    """key, x1, y1, x2, y2: the edges of all rings, closed if they are not."""
    ring = F.col("_ring")
    pairs = F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, F.when(i == F.size(ring) - 1, 0).otherwise(i + 1)).alias("b")))
    each = basins.select(key, F.explode("rings").alias("_ring")).select(key, F.explode(pairs).alias("_e"))
    at = lambda end, k: F.get(F.col(f"_e.{end}"), F.lit(k))
    return each.select(key, at("a", 0).alias("x1"), at("a", 1).alias("y1"), at("b", 0).alias("x2"), at("b", 1).alias("y2")).where("not (x1 = x2 and y1 = y2)")


def placed_edges(basins: DataFrame, crs: str, bound: float | None, key: str = "triplet") -> DataFrame:
    """key, x1, y1, x2, y2: the edges of rings in longitude and latitude, in a projection.

    An edge is straight in longitude and latitude, so it is bent in the projection. It is cut into as many pieces as it
    takes for each to stay within `bound` (in the projection's unit) of the bent line: how far its middle and quarters
    lie from the chord tells how many, and a second round cuts what the first took for too straight. No bound: only the
    corners are projected.
    """
    if crs in GEOGRAPHIC:
        return edges(basins, key)
    (x1, y1), (x2, y2) = (reprojected(F.col(f"x{k}"), F.col(f"y{k}"), GEOGRAPHIC[0], crs) for k in (1, 2))
    return _pieces(basins, crs, bound, key).select(key, x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).where("not (x1 = x2 and y1 = y2)")


def _pieces(basins: DataFrame, crs: str, bound: float | None, key: str) -> DataFrame:
    """key, x1, y1, x2, y2: the edges of rings, still in longitude and latitude, cut so that pieces are within the bound.

    A basin's record is short and its work is long, so its edges are dealt out first: a file of many basins is one task
    otherwise. How many tasks it takes is left to adaptive execution.
    """
    out = edges(basins, key)
    out = out.repartition(*out.columns)
    if bound is not None:
        for _ in range(2):
            out = _bent(out, crs, bound, key)
    return out


def _bent(lonlat: DataFrame, crs: str, bound: float, key: str) -> DataFrame:
    """The edges in longitude and latitude, cut so that pieces are within the bound if they bend evenly."""
    at = lambda t: tuple(F.col(f"{c}1") + t * (F.col(f"{c}2") - F.col(f"{c}1")) for c in "xy")
    names = ("a", "q", "m", "r", "b")
    places = {n: reprojected(*at(t), GEOGRAPHIC[0], crs) for n, t in zip(names, (0.0, 0.25, 0.5, 0.75, 1.0), strict=True)}
    seen = lonlat.withColumns({f"_{n}{c}": v for n, place in places.items() for c, v in zip("xy", place, strict=True)})

    def off(n: str, t: float) -> Column:
        """How far a place is from the chord's at the same share of it."""
        d = [F.col(f"_{n}{c}") - F.col(f"_a{c}") - t * (F.col(f"_b{c}") - F.col(f"_a{c}")) for c in "xy"]
        return F.sqrt(d[0] * d[0] + d[1] * d[1])

    most = F.greatest(off("q", 0.25) * (4 / 3), off("m", 0.5), off("r", 0.75) * (4 / 3))  # of an even bend, the middle's
    pieces = F.greatest(F.ceil(F.sqrt(most / bound)), F.lit(1)).cast("int")
    # outer: there is always a piece, and no filter on the array makes all places be worked out twice
    each = seen.withColumn("_n", pieces).select(key, "x1", "y1", "x2", "y2", "_n", F.explode_outer(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    end = lambda c, i: F.when(i == F.col("_n"), F.col(f"{c}2")).otherwise(F.col(f"{c}1") + i / F.col("_n") * (F.col(f"{c}2") - F.col(f"{c}1")))
    i = F.col("_i")
    return each.select(key, end("x", i).alias("x1"), end("y", i).alias("y1"), end("x", i + 1).alias("x2"), end("y", i + 1).alias("y2"))


def crosses(x: Column, y: Column) -> Column:
    """Whether the edge x1, y1, x2, y2 crosses the ray from (x, y) to the east."""
    straddles = (F.col("y1") > y) != (F.col("y2") > y)
    return straddles & (x < (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1"))


def grid_edges(basins: DataFrame, grid: Grid, key: str = "triplet", bend: float | None = None) -> DataFrame:
    """The edges of rings in the grid's coordinates; a bend is in pixels."""
    if not grid.has_projection:
        return edges(basins, key)
    return placed_edges(basins, grid.crs, None if bend is None else bend * grid.pixel, key)


#: How far a projected edge may be from the bent line that it stands for, in pixels.
BEND = 1 / 16
#: The same away from the centres of pixels, where no finer place of an edge changes which pixels it parts.
COARSE = 1 / 1000


def _rows_of(placed: DataFrame, grid: Grid, margin: float = 0.0) -> DataFrame:
    """The edges with each grid row whose centre line they span, or come near to."""
    first = F.greatest(F.lit(0), F.ceil((F.lit(grid.origin_y - margin) - F.greatest("y1", "y2")) / grid.pixel - 0.5)).cast("int")
    last = F.least(F.lit(grid.rows - 1), F.floor((F.lit(grid.origin_y + margin) - F.least("y1", "y2")) / grid.pixel - 0.5)).cast("int")
    spans = placed.withColumns({"_f": first, "_l": last})
    return spans.select(*placed.columns, F.explode_outer(F.when(F.col("_f") <= F.col("_l"), F.sequence("_f", "_l"))).alias("row")).where("row is not null")


def _crossings(spanned: DataFrame, grid: Grid, key: str) -> DataFrame:
    """key, row, x: where edges cross their rows' centre lines."""
    y = F.lit(grid.origin_y) - (F.col("row") + 0.5) * grid.pixel
    return spanned.where((F.col("y1") > y) != (F.col("y2") > y)).select(key, "row", ((F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"))


def _near_crossings(basins: DataFrame, grid: Grid, key: str, bend: float) -> DataFrame:
    """key, row, x: where bent edges cross rows' centre lines, to within `bend` pixels wherever that tells pixels apart.

    A chord and the bent line over it have the same ends, so they part the same pixels unless a pixel's centre lies
    between them. Edges are placed coarsely; of a piece and a row, the piece is cut finely only if a centre of that row
    is within twice the coarse bound of its chord. So few pieces are cut, however small the bend.
    """
    margin, size = 2 * COARSE * grid.pixel, grid.pixel
    names = ("x1", "y1", "x2", "y2")
    lonlat = _pieces(basins, grid.crs, COARSE * size, key)
    ends = [c for k in (1, 2) for c in reprojected(F.col(f"x{k}"), F.col(f"y{k}"), GEOGRAPHIC[0], grid.crs)]
    spanned = _rows_of(lonlat.select(key, *[F.col(c).alias(f"_{c}") for c in names], *[e.alias(c) for e, c in zip(ends, names, strict=True)]), grid, margin)

    y, dy = F.lit(grid.origin_y) - (F.col("row") + 0.5) * size, F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    share = lambda side, level: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y + side - F.col("y1")) / dy)), F.lit(level))
    xs = [F.col("x1") + share(side, level) * (F.col("x2") - F.col("x1")) for side, level in ((-margin, 0.0), (margin, 1.0))]
    west, east = ((x - grid.origin_x) / size - 0.5 for x in (F.least(*xs) - margin, F.greatest(*xs) + margin))
    pieces = math.ceil(math.sqrt(2 * COARSE / bend))
    numbers = F.when(F.ceil(west) <= F.floor(east), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(-1)))  # -1: the chord does
    cut = spanned.select("*", F.explode_outer(numbers).alias("_i"))
    i = F.col("_i")

    def end(c: str, k: Column) -> Column:
        a, b = F.col(f"_{c}1"), F.col(f"_{c}2")
        return F.when(k == 0, a).when(k == pieces, b).otherwise(a + k / pieces * (b - a))

    fine = [c for k in (i, i + 1) for c in reprojected(end("x", k), end("y", k), GEOGRAPHIC[0], grid.crs)]
    return _crossings(cut.select(key, "row", *[F.when(i < 0, F.col(c)).otherwise(f).alias(c) for c, f in zip(names, fine, strict=True)]), grid, key)


def burned(basins: DataFrame, grid: Grid, mask: DataFrame | None = None, key: str = "triplet", bend: float | None = BEND) -> DataFrame:
    """basin, row, col, pixel_id, tile_id, area_m2 of the pixels whose centres lie in a basin.

    A grid row meets only those edges that span it, and the crossings to the right of a centre are counted by sorting
    them per row: each pair of crossings bounds a run of pixels. So the work grows with the basin's outline and pixels
    and no basin is set against the whole grid. mask: pixel_ids of valid ground. Rings are in longitude and latitude;
    on a projected grid their edges are placed to within `bend` pixels. A grid of no known projection has the rings' own.
    """
    finer = bend is not None and bend < COARSE and grid.has_projection and grid.crs not in GEOGRAPHIC
    at = _near_crossings(basins, grid, key, bend) if finer else _crossings(_rows_of(grid_edges(basins, grid, key, bend), grid), grid, key)
    lines = at.groupBy(key, "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.get("xs", i).alias("a"), F.get("xs", i + 1).alias("b")))
    runs = lines.where(F.size("xs") >= 2).select(key, "row", F.explode(pairs).alias("p"))
    left = F.greatest(F.lit(0), F.ceil((F.col("p.a") - grid.origin_x) / grid.pixel - 0.5)).cast("int")
    right = F.least(F.lit(grid.cols - 1), F.ceil((F.col("p.b") - grid.origin_x) / grid.pixel - 0.5) - 1).cast("int")
    cells = runs.select(key, "row", left.alias("_a"), right.alias("_b")).where("_a <= _b").select(F.col(key).alias("basin"), "row", F.explode(F.sequence("_a", "_b")).alias("col"))
    cells = cells.withColumns({"pixel_id": grid.pixel_id(F.col("row"), F.col("col")), "tile_id": grid.tile_id(F.col("row"), F.col("col"))}).withColumn("area_m2", grid.cell_area(F.col("row")).cast("float"))
    return cells if mask is None else cells.join(mask.select("pixel_id"), "pixel_id", "left_semi").select(cells.columns)


def geodesic_area(basins: DataFrame, key: str = "triplet") -> DataFrame:
    """key, area_meters on the WGS84 ellipsoid: under each edge, the strip to the equator at its mean latitude (Simpson).

    Edges are taken as straight in longitude and latitude, which for a basin's short edges is the geodesic to well under
    a millionth.
    """
    lat1, lat2 = F.radians("y1"), F.radians("y2")
    strip = (ellipsoid_strip(lat1) + 4 * ellipsoid_strip((lat1 + lat2) / 2) + ellipsoid_strip(lat2)) / 6
    signed = F.radians(F.col("x2") - F.col("x1")) * strip
    rings = basins.select(key, F.posexplode("rings").alias("_k", "_r")).select(F.struct(key, "_k").alias("_id"), F.array("_r").alias("rings"))
    per_ring = edges(rings, "_id").groupBy("_id").agg(F.sum(signed).alias("s"))
    return per_ring.groupBy(F.col(f"_id.{key}").alias(key)).agg(F.abs(F.sum("s")).alias("area_meters"))


Box = tuple[float, float, float, float]


def coverage(basins: DataFrame, boxes: Sequence[Box], holes: Sequence[Box] = (), key: str = "triplet", grid: Grid | None = None, bend: float | None = BEND) -> DataFrame:
    """key, coverage (full, partial, none) of each basin by a domain: boxes (west, south, east, north) less holes.

    With a grid, boxes are in its coordinates, and rings, in longitude and latitude, are placed there first.

    Covered: every corner lies in a box and no part of the basin in a hole. Boxes must tile a region whose only gaps
    are the holes; with one box there is none.
    """
    from functools import reduce

    e = edges(basins, key) if grid is None else grid_edges(basins, grid, key, bend)
    inside = lambda x, y, b: (F.col(x) >= b[0]) & (F.col(x) <= b[2]) & (F.col(y) >= b[1]) & (F.col(y) <= b[3])
    any_of = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))

    def meets(b: Box, strict: bool) -> Column:
        """Whether the edge passes through the box, by cutting it at the box's sides."""
        dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

        def span(p: Column, d: Column, low: float, high: float) -> tuple[Column, Column]:
            t1, t2 = (F.lit(low) - p) / F.nullif(d, F.lit(0.0)), (F.lit(high) - p) / F.nullif(d, F.lit(0.0))
            ok = (p > low) & (p < high) if strict else (p >= low) & (p <= high)
            still = F.when(ok, F.lit(0.0)).otherwise(F.lit(2.0))
            return F.coalesce(F.least(t1, t2), still), F.coalesce(F.greatest(t1, t2), F.lit(1.0))

        (a1, a2), (b1, b2) = span(F.col("x1"), dx, b[0], b[2]), span(F.col("y1"), dy, b[1], b[3])
        enter, leave = F.greatest(a1, b1, F.lit(0.0)), F.least(a2, b2, F.lit(1.0))
        return enter < leave if strict else enter <= leave

    corner_in = lambda b: F.sum(F.when(crosses(F.lit((b[0] + b[2]) / 2), F.lit((b[1] + b[3]) / 2)), 1).otherwise(0)) % 2 == 1
    in_holes = reduce(lambda a, b: a | b, [F.max(meets(h, True)) | corner_in(h) for h in holes], F.lit(False))
    touched = reduce(lambda a, b: a | b, [F.max(meets(b, False)) | corner_in(b) for b in boxes], F.lit(False))
    all_in = F.min(any_of([inside("x1", "y1", b) for b in boxes]) & any_of([inside("x2", "y2", b) for b in boxes]))
    found = e.groupBy(key).agg(F.when(all_in & ~in_holes, "full").when(touched, "partial").otherwise("none").alias("coverage"))
    return basins.select(key).distinct().join(found, key, "left").select(key, F.coalesce("coverage", F.lit("none")).alias("coverage"))


def require_coverage(state: str | None, basin: str, dataset: str, allow_partial: bool = False) -> None:
    """Raise unless the coverage of the index lets the query run; no entry is none."""
    if state == "full" or state == "partial" and allow_partial:
        return
    detail = "covers it only in part; partial coverage can be allowed" if state == "partial" else "does not cover it at all"
    raise CoverageError(f"dataset {dataset} {detail}: basin {basin}")


def wkb_hash(rings: Column, polygons: Column | None = None) -> Column:
    """sha256 of little-endian well-known binary: of one polygon with these rings, or of as many as polygons has counts of rings."""
    return F.sha2(_wkb(rings, F.lit(None).cast("array<int>") if polygons is None else polygons), 256)


@F.pandas_udf(BinaryType())
def _wkb(rings: pd.Series, polygons: pd.Series) -> pd.Series:
    """One call for a batch of basin records; pixels never pass here."""

    def encoded(polygon: list) -> bytes:
        out = struct.pack("<BII", 1, 3, len(polygon))
        for ring in polygon:
            out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", p[0], p[1]) for p in ring)
        return out

    def whole(own: list | None, counts: list | None) -> bytes | None:
        if own is None or counts is None:
            return None if own is None else encoded(own)
        ends = [0, *itertools.accumulate(counts)]
        return struct.pack("<BII", 1, 6, len(counts)) + b"".join(encoded(own[a:b]) for a, b in itertools.pairwise(ends))

    return pd.Series([whole(r, p) for r, p in zip(rings, polygons, strict=True)], dtype=object)


def build_index(records: DataFrame, coverages: Mapping[str, DataFrame], previous: DataFrame | None = None) -> DataFrame:
    """triplet, name, lon, lat, area_meters, geometry_hash, coverage (dataset -> state) of imported records.

    An entry of `previous` whose geometry hash is unchanged and whose coverage has exactly the given datasets is kept
    as it is; the others are worked out anew.
    """
    hashed = records.where("status = 'import'").withColumn("geometry_hash", wkb_hash(F.col("rings"), F.col("polygons") if "polygons" in records.columns else None))
    names = sorted(coverages)
    fresh = hashed
    kept = None
    if previous is not None:
        same = F.array_sort(F.map_keys("coverage")) == F.array(*[F.lit(n) for n in names])
        old = previous.where(same) if names else previous.where(F.size("coverage") == 0)
        kept = old.join(hashed.select("triplet", "geometry_hash"), ["triplet", "geometry_hash"], "left_semi").select("triplet", "name", "lon", "lat", "area_meters", "geometry_hash", "coverage")
        fresh = hashed.join(kept.select("triplet"), "triplet", "left_anti")
    out = fresh.join(geodesic_area(fresh), "triplet", "left")
    states = []
    for i, name in enumerate(names):
        out = out.join(coverages[name].select("triplet", F.col("coverage").alias(f"_c{i}")), "triplet", "left")
        states += [F.lit(name), F.coalesce(F.col(f"_c{i}"), F.lit("none"))]
    entries = out.select("triplet", "name", "lon", "lat", "area_meters", "geometry_hash", (F.create_map(*states) if states else F.create_map().cast("map<string,string>")).alias("coverage"))
    return entries if kept is None else entries.unionByName(kept)


def folded_coverage(index: DataFrame, dataset: str, states: DataFrame) -> DataFrame:
    """The index with one dataset's coverage set in every entry; basins that states lacks have none."""
    joined = index.join(states.select("triplet", F.col("coverage").alias("_c")), "triplet", "left")
    others = F.map_filter("coverage", lambda k, _: k != dataset)
    return joined.withColumn("coverage", F.map_concat(others, F.create_map(F.lit(dataset), F.coalesce("_c", F.lit("none"))))).drop("_c")


def active_coverage(coverage_map: Column, active: Sequence[str]) -> Column:
    return F.map_filter(coverage_map, lambda k, _: k.isin(*active))


def within(index: DataFrame, bbox: Box) -> DataFrame:
    """All entries whose points lie in the box, its edges included."""
    return index.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))


def page(index: DataFrame, offset: int = 0, limit: int = 100, bbox: Box | None = None, records: DataFrame | None = None) -> tuple[DataFrame, int]:
    """A page of the index by triplet, and how many entries match in all; records: join the page with their rings."""
    chosen = index if bbox is None else within(index, bbox)
    rows = chosen.orderBy("triplet").offset(offset).limit(limit)
    if records is not None:
        rows = rows.join(records.select("triplet", "rings"), "triplet", "left").orderBy("triplet")
    return rows, chosen.count()


def changes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """triplet, change (add, update, keep, prune) between stored and incoming records (triplet, geometry_hash)."""
    both = stored.select("triplet", F.col("geometry_hash").alias("_old"), F.lit(True).alias("_s")).join(incoming.select("triplet", F.col("geometry_hash").alias("_new"), F.lit(True).alias("_i")), "triplet", "full")
    change = F.when(F.col("_i").isNull(), "prune").when(F.col("_s").isNull(), "add").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    return both.select("triplet", change.alias("change"))


def one_record(records: DataFrame, triplet: str) -> DataFrame:
    found = records.where(F.col("triplet") == triplet)
    if found.isEmpty():
        raise UnknownBasin(f"there is no basin {triplet}")
    return found


def require_basin(parsed: DataFrame, triplet: str) -> DataFrame:
    """The parsed record of a station; raises where it has a point only, or where there is none."""
    found = parsed.where((F.col("triplet") == triplet) & F.col("status").isin("import", "skipped"))
    if found.isEmpty():
        raise UnknownBasin(f"there is no basin {triplet}")
    with_basin = found.where("status = 'import'")
    if with_basin.isEmpty():
        raise NoBasin(f"{triplet} has a point but no basin")
    return with_basin


def feature_json(index: DataFrame) -> DataFrame:
    """Each entry as a GeoJSON Feature text, in order of triplet."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    properties = F.struct("name", "area_meters", "geometry_hash", "coverage")
    return index.orderBy("triplet").select("triplet", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("triplet").alias("id"), point.alias("geometry"), properties.alias("properties"))).alias("feature"))
