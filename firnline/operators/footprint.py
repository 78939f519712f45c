"""Coverage by footprints: the union of polygons, and how much of a basin lies in it.

The union is an arrangement of edges: each polygon's edges are cut where others cross or touch them, and of the pieces
those stay that have the union on one side only. A basin's edges are cut by that outline in turn, and the middles of
the pieces tell whether the basin's boundary stays inside; a part of the outline within the basin is a gap. Edges meet
in horizontal bands, so that a join finds those that can cross, and no outline is set against all others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.operators.basins import crosses, edges

_ENDS = ("x1", "y1", "x2", "y2")


def polygon_edges(spark: SparkSession, polygons: Sequence[Sequence[Sequence[Sequence[float]]]]) -> DataFrame:
    """poly, x1, y1, x2, y2 of polygons (lists of rings of places), numbered in their order."""
    rows = [(k, [[[float(x), float(y)] for x, y, *_ in ring] for ring in rings]) for k, rings in enumerate(polygons)]
    return edges(spark.createDataFrame(rows, "poly int, rings array<array<array<double>>>"), "poly")


def band_height(polygons: Sequence[Sequence[Sequence[Sequence[float]]]], bands: int = 64) -> float:
    """The height of bands of which the polygons span so many."""
    ys = [p[1] for rings in polygons for ring in rings for p in ring]
    return (max(ys) - min(ys)) / bands or 1.0


def _banded(rows: DataFrame, band: float, eps: float) -> DataFrame:
    """rows once for each band that their edges reach."""
    at = lambda y: F.floor(y / band)
    return rows.withColumn("_b", F.explode(F.sequence(at(F.least("y1", "y2") - eps), at(F.greatest("y1", "y2") + eps))))


def _cuts(own: DataFrame, others: DataFrame, band: float, eps: float, apart: Column | None = None) -> DataFrame:
    """id, t: where (0 to 1 along them) other edges cross or touch the edges of own (id, x1 to y2), ends left out."""
    a, b = _banded(own, band, eps), _banded(others.select(*[F.col(c).alias(f"o{c}") for c in others.columns]).withColumnsRenamed({f"o{c}": f"o_{c}" for c in _ENDS}).withColumns({c: F.col(f"o_{c}") for c in _ENDS}), band, eps).drop(*_ENDS)
    boxes = reduce(lambda x, y: x & y, [(F.least(f"o_{c}1", f"o_{c}2") <= F.greatest(f"{c}1", f"{c}2") + eps) & (F.least(f"{c}1", f"{c}2") <= F.greatest(f"o_{c}1", f"o_{c}2") + eps) for c in "xy"])
    met = a.join(b, "_b").where(boxes if apart is None else boxes & apart)
    rx, ry, sx, sy = (F.col(p) - F.col(q) for p, q in (("x2", "x1"), ("y2", "y1"), ("o_x2", "o_x1"), ("o_y2", "o_y1")))
    qx, qy = F.col("o_x1") - F.col("x1"), F.col("o_y1") - F.col("y1")
    met = met.withColumns({"_rx": rx, "_ry": ry, "_sx": sx, "_sy": sy, "_qx": qx, "_qy": qy})
    cross = lambda p, q: F.col(f"_{p}x") * F.col(f"_{q}y") - F.col(f"_{p}y") * F.col(f"_{q}x")
    long_r, long_s = F.sqrt(F.col("_rx") ** 2 + F.col("_ry") ** 2), F.sqrt(F.col("_sx") ** 2 + F.col("_sy") ** 2)
    met = met.withColumns({"_d": cross("r", "s"), "_lr": long_r, "_ls": long_s})
    parallel = F.abs("_d") <= 1e-12 * F.col("_lr") * F.col("_ls")
    t, u = cross("q", "s") / F.col("_d"), cross("q", "r") / F.col("_d")
    meets = (u >= -eps / F.col("_ls")) & (u <= 1 + eps / F.col("_ls"))
    along = (F.col("_qx") * F.col("_rx") + F.col("_qy") * F.col("_ry")) / F.col("_lr") ** 2
    on_line = F.abs(cross("q", "r")) <= eps * F.col("_lr")
    both = F.array(along, along + (F.col("_sx") * F.col("_rx") + F.col("_sy") * F.col("_ry")) / F.col("_lr") ** 2)
    found = F.when(parallel & on_line, both).when(~parallel & meets, F.array(t))
    ends = met.select("id", "_lr", F.explode(found).alias("t"))
    return ends.where((F.col("t") > 0) & (F.col("t") < 1)).select("id", "t").distinct()


def _pieces(own: DataFrame, cuts: DataFrame) -> DataFrame:
    """own's rows with x1 to y2 of the pieces that the cuts make of each edge."""
    per_edge = cuts.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    every = own.join(per_edge, "id", "left").withColumn("ts", F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    each = every.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("ts") - 2))).withColumns({"_s": F.get("ts", F.col("_i")), "_e": F.get("ts", F.col("_i") + 1)}).where("_s < _e")
    at = lambda axis, t: F.when(t == 1.0, F.col(f"{axis}2")).otherwise(F.col(f"{axis}1") + t * (F.col(f"{axis}2") - F.col(f"{axis}1")))
    ends = {"_x1": at("x", F.col("_s")), "_y1": at("y", F.col("_s")), "_x2": at("x", F.col("_e")), "_y2": at("y", F.col("_e"))}
    return each.withColumns(ends).drop(*_ENDS, "ts", "_i", "_e").withColumnsRenamed({f"_{c}": c for c in _ENDS})


def _near(x: Column, y: Column, eps: float) -> Column:
    """Whether a place lies on the edge x1, y1, x2, y2, to within eps."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.least(F.greatest(((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    ex, ey = x - F.col("x1") - t * dx, y - F.col("y1") - t * dy
    return ex * ex + ey * ey <= eps * eps


def _placed(points: DataFrame, others: DataFrame, keys: Sequence[str], band: float, eps: float, which: Sequence[str] = (), same: Sequence[str] = ()) -> DataFrame:
    """keys, which, inside, on of points (keys, px, py): whether the edges (which, x1 to y2) hold a point, and have it on them.

    A point that no edge of its band passes has no row. same: columns in which a point and an edge must agree.
    """
    own = points.withColumn("_b", F.floor(F.col("py") / band))
    met = own.join(_banded(others, band, eps), ["_b", *same])
    hit, near = crosses(F.col("px"), F.col("py")), _near(F.col("px"), F.col("py"), eps)
    return met.groupBy(*keys, *which).agg((F.sum(F.when(hit, 1).otherwise(0)) % 2 == 1).alias("inside"), F.max(near).alias("on"))


def outline(polygons: DataFrame, band: float, eps: float) -> DataFrame:
    """x1, y1, x2, y2 of the outline of the union of polygons (poly, x1 to y2). Gaps of less than eps count as none.

    Of pieces that several polygons share, with the union on one side, that of the first polygon stays.
    """
    own = polygons.withColumn("id", F.struct("poly", *_ENDS))
    cuts = _cuts(own, polygons, band, eps, F.col("poly") != F.col("opoly"))
    pieces = _pieces(own, cuts).withColumn("piece", F.struct("poly", *_ENDS))
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    mid = lambda axis: (F.col(f"{axis}1") + F.col(f"{axis}2")) / 2
    aside = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    points = pieces.withColumns({"_l": length, "side": aside}).where("_l > 0")
    points = points.select("piece", F.col("poly").alias("own"), "side", (mid("x") - F.col("side") * 2 * eps * (F.col("y2") - F.col("y1")) / F.col("_l")).alias("px"), (mid("y") + F.col("side") * 2 * eps * (F.col("x2") - F.col("x1")) / F.col("_l")).alias("py"))
    found = _placed(points, polygons, ["piece", "own", "side"], band, eps, ["poly"])
    flag = lambda test: F.max(F.when(test, 1).otherwise(0))
    judged = found.groupBy("piece").agg(flag((F.col("side") == -1) & F.col("inside")).alias("l"), flag((F.col("side") == 1) & F.col("inside")).alias("r"), flag((F.col("side") == 0) & F.col("on") & (F.col("poly") < F.col("own"))).alias("again"))
    return judged.where("l <> r and again = 0").select("piece.x1", "piece.y1", "piece.x2", "piece.y2")


def _beside_the_outline(pieces: DataFrame, basin_edges: DataFrame, footprint: DataFrame, band: float, eps: float, key: str) -> DataFrame:
    """key, bare: basins that have ground outside the footprint just beside a piece of their boundary that lies on its outline."""
    x1, y1, x2, y2 = (F.col(f"piece.{c}") for c in _ENDS)
    step = F.col("side") * 2 * eps / F.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)
    points = pieces.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumns({"px": (x1 + x2) / 2 - step * (y2 - y1), "py": (y1 + y2) / 2 + step * (x2 - x1)})
    at = [key, "piece", "side"]
    own = _placed(points, basin_edges, at, band, eps / 2, same=[key]).where("inside")
    served = _placed(points, footprint, at, band, eps / 2).where("inside").select(at)
    return own.select(at).join(served, at, "left_anti").select(key).distinct().withColumn("bare", F.lit(True))


def covered(basin_edges: DataFrame, footprint: DataFrame, band: float, eps: float, key: str = "triplet") -> DataFrame:
    """key, coverage (full, partial, none) of basins (key, x1 to y2) by a footprint's outline (x1 to y2).

    full: no part of the basin lies outside, boundaries may touch; partial: they meet at all. Basins without edges have
    no row.
    """
    own = basin_edges.withColumn("id", F.struct(key, *_ENDS))
    cuts = _cuts(own, footprint, band, eps)
    mid = lambda axis: (F.col(f"{axis}1") + F.col(f"{axis}2")) / 2
    points = _pieces(own, cuts).select(key, F.struct(*_ENDS).alias("piece"), mid("x").alias("px"), mid("y").alias("py"))
    placed = points.join(_placed(points, footprint, [key, "piece"], band, eps), [key, "piece"], "left")
    inside = F.coalesce(F.col("inside") | F.col("on"), F.lit(False))
    boundary = placed.groupBy(key).agg(F.min(inside).alias("all_in"), F.max(inside).alias("any_in"))
    gaps = footprint.select(F.struct(*_ENDS).alias("piece"), mid("x").alias("px"), mid("y").alias("py"))
    within = _placed(gaps, basin_edges, ["piece"], band, eps, [key]).groupBy(key).agg(F.max(F.col("inside") & ~F.col("on")).alias("gap"))
    beside = _beside_the_outline(placed.where("on").select(key, "piece"), basin_edges, footprint, band, eps, key)
    touched = cuts.select(f"id.{key}").distinct().withColumn("touch", F.lit(True))
    judged = boundary.join(within, key, "left").join(touched, key, "left").join(beside, key, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.when(F.col("all_in") & ~yes("gap") & ~yes("bare"), "full").when(F.col("any_in") | yes("gap") | yes("touch"), "partial").otherwise("none")
    return judged.select(key, state.alias("coverage"))
