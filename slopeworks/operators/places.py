"""Where things are: polygon validity, interior points, bounds, raster samples and warps, masks, corridors, origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.operators.geometry import by_cell, contains, edges, to_segment_m, touches, with_box
from slopeworks.operators.joins import enforce
from slopeworks.operators.validity import validity
from slopeworks.runtime import by_key


def usable(polygons: DataFrame, code: str, parts: str = "parts") -> DataFrame:
    """The polygons that are valid."""
    return polygons.join(by_key(validity(polygons, code, parts).filter("valid").select(code)), code, "left_semi")


def merged(polygons: DataFrame, polygon_id: str, code: str, master: DataFrame, parts: str = "parts") -> DataFrame:
    """(code, parts) of the master's codes: all parts of a code's valid polygons; invalid ones and other codes are left out.

    District and sub-district are not compared, unlike in ``geometry.exact_code_polygons``. A point is inside if it is inside of any part.
    """
    known = usable(polygons, polygon_id, parts).join(master.select(code).distinct(), code, "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(polygon_id).alias("id"), F.col(parts).alias("parts"))))
    return known.groupBy(code).agg(F.flatten(F.transform(ordered, lambda p: p["parts"])).alias(parts))


def interior_point(ring_edges: Column) -> Column:
    """A point inside (struct of x and y): the middle of the widest interior stretch half way up."""
    ys = F.concat(F.transform(ring_edges, lambda e: e["y1"]), F.transform(ring_edges, lambda e: e["y2"]))
    middle = (F.array_min(ys) + F.array_max(ys)) / 2
    # a level that no corner is on: half way from the middle to the next corner above it
    above = F.array_min(F.filter(ys, lambda y: y > middle))
    level = (middle + above) / 2
    crossing = F.filter(ring_edges, lambda e: (e["y1"] > level) != (e["y2"] > level))
    xs = F.array_sort(F.transform(crossing, lambda e: e["x1"] + (level - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
    stretches = F.transform(F.sequence(F.lit(0), F.size(xs) - 2, F.lit(2)), lambda k: F.struct((F.get(xs, k + 1) - F.get(xs, k)).alias("width"), ((F.get(xs, k + 1) + F.get(xs, k)) / 2).alias("x")))
    return F.when(F.size(xs) >= 2, F.struct(F.array_max(stretches)["x"].alias("x"), level.alias("y")))


def origins(master: DataFrame, polygons: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """Places of the master that have a polygon, with a point inside it; others have no origin."""
    points = polygons.select(key, interior_point(edges(F.col(parts))).alias("_p"))
    return master.join(points, key).filter(F.col("_p").isNotNull()).withColumns({"longitude": F.col("_p.x"), "latitude": F.col("_p.y")}).drop("_p")


def bounds(polygons: DataFrame, parts: str = "parts", step: float | None = None) -> DataFrame:
    """One row: the extent of all polygons (west, south, east, north), widened to multiples of a step if one is given."""
    boxed = with_box(polygons, parts).agg(F.min("_x1").alias("west"), F.min("_y1").alias("south"), F.max("_x2").alias("east"), F.max("_y2").alias("north"))
    if step is None:
        return boxed
    return boxed.select(*((F.floor(F.col(c) / step) * F.lit(float(step))).alias(c) for c in ("west", "south")), *((F.ceil(F.col(c) / step) * F.lit(float(step))).alias(c) for c in ("east", "north")))


def sample(points: DataFrame, cells: DataFrame, west: float, north: float, res: float, n_rows: int, n_cols: int, values: list[str]) -> DataFrame:
    """Points (x, y) with the raster's values at the cell they are in, and sample_status: sampled, outside, or nodata."""
    placed = points.withColumns({"row": F.floor((F.lit(north) - F.col("y")) / res).cast("int"), "col": F.floor((F.col("x") - F.lit(west)) / res).cast("int")})
    known = lambda c: F.coalesce(~F.isnan(F.col(c).cast("double")), F.lit(False))
    joined = placed.join(cells.select("row", "col", *values), ["row", "col"], "left")
    inside = F.coalesce(F.col("row").between(0, n_rows - 1) & F.col("col").between(0, n_cols - 1), F.lit(False))
    there = known(values[0])
    for c in values[1:]:
        there = there & known(c)
    return joined.withColumn("sample_status", F.when(~inside, "outside").when(there, "sampled").otherwise("nodata"))


def require_samples(points: DataFrame, point_id: str) -> DataFrame:
    """Sampled points, refused with the ids of those that are outside or on cells without data."""
    enforce(points.filter("sample_status <> 'sampled'").select(point_id, "sample_status").orderBy(point_id), "points cannot be sampled")
    return points


def bilinear(points: DataFrame, cells: DataFrame, west: float, north: float, res: float, value: str = "z") -> DataFrame:
    """Points (x, y in the raster's coordinates) with the raster's value by bilinear weights of the four cells around.

    Cells without a value take no part, and the weights of the others are scaled up; without any it is null.
    """
    fx, fy = (F.col("x") - F.lit(west)) / res - 0.5, (F.lit(north) - F.col("y")) / res - 0.5
    rows = points.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_c": F.floor(fx), "_r": F.floor(fy)}).withColumns({"_u": fx - F.col("_c"), "_v": fy - F.col("_r")})
    corner = lambda dr, dc, w: F.struct((F.col("_r") + dr).cast("int").alias("row"), (F.col("_c") + dc).cast("int").alias("col"), w.alias("w"))
    u, v = F.col("_u"), F.col("_v")
    corners = F.array(corner(0, 0, (1 - u) * (1 - v)), corner(0, 1, u * (1 - v)), corner(1, 0, (1 - u) * v), corner(1, 1, u * v))
    spread = rows.select(*points.columns, F.explode(corners).alias("_k")).select(*points.columns, "_k.*")
    valid = cells.filter(F.coalesce(~F.isnan(F.col(value).cast("double")), F.lit(False))).select("row", "col", F.col(value).alias("_z"))
    met = spread.join(valid, ["row", "col"], "left")
    weight = F.sum(F.when(F.col("_z").isNotNull(), F.col("w")))
    return met.groupBy(*points.columns).agg(F.when(weight > 0, F.sum(F.col("w") * F.col("_z")) / weight).alias(value))


def within(cells: DataFrame, polygons: DataFrame, code: str, buffer: float = 0.0, cell: float = 8.0) -> DataFrame:
    """(code and the cells' columns) of cells whose centre (x, y) is inside of a polygon or at most ``buffer`` from its border."""
    boxed = with_box(polygons).select(code, "_edges", *((F.col(c) + d).alias(c) for c, d in (("_x1", -buffer), ("_y1", -buffer), ("_x2", buffer), ("_y2", buffer))))
    x, y = F.col("x"), F.col("y")
    placed = cells.withColumns({"_cx": F.floor(x / cell), "_cy": F.floor(y / cell)})
    near = placed.join(by_cell(boxed, cell), ["_cx", "_cy"]).filter(x.between(F.col("_x1"), F.col("_x2")) & y.between(F.col("_y1"), F.col("_y2")))
    close = F.exists("_edges", lambda e: to_segment_m(x, y, e["x1"], e["y1"], e["x2"], e["y2"]) <= buffer) if buffer > 0 else touches(F.col("_edges"), x, y)
    return near.filter(contains(F.col("_edges"), x, y) | close).select(code, *cells.columns)


def analysis_mask(cells: DataFrame, polygons: DataFrame, code: str, buffer: float = 5000.0, cell: float = 50_000.0) -> DataFrame:
    """Cells with ``in_mask``: whether the centre is in any polygon or its buffer."""
    hit = within(cells.select("row", "col", "x", "y"), polygons, code, buffer, cell).select("row", "col").distinct().withColumn("in_mask", F.lit(True))
    return cells.join(hit, ["row", "col"], "left").withColumn("in_mask", F.coalesce("in_mask", F.lit(False)))


def corridor(polygons: DataFrame, segments: DataFrame, code: str, route_id: str, width: float, cell: float | None = None) -> DataFrame:
    """(route, code) of polygons that a route's corridor meets: one of its segments (x1, y1, x2, y2) comes within ``width`` of it or lies in it."""
    side = float(cell or 8 * width)
    boxed = by_cell(with_box(polygons).select(code, "_edges", "_x1", "_x2", "_y1", "_y2"), side).select(code, "_edges", "_cx", "_cy")
    lo, hi = (lambda a, b: F.floor((F.least(a, b) - width) / side)), (lambda a, b: F.floor((F.greatest(a, b) + width) / side))
    s = segments.withColumn("_cx", F.explode(F.sequence(lo(F.col("x1"), F.col("x2")), hi(F.col("x1"), F.col("x2")))))
    s = s.withColumn("_cy", F.explode(F.sequence(lo(F.col("y1"), F.col("y2")), hi(F.col("y1"), F.col("y2")))))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    turn = lambda ax, ay, bx, by, cx, cy: F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))

    def near(e: Column) -> Column:
        crosses = (turn(x1, y1, x2, y2, e["x1"], e["y1"]) * turn(x1, y1, x2, y2, e["x2"], e["y2"]) < 0) & (turn(e["x1"], e["y1"], e["x2"], e["y2"], x1, y1) * turn(e["x1"], e["y1"], e["x2"], e["y2"], x2, y2) < 0)
        ends = [to_segment_m(px, py, e["x1"], e["y1"], e["x2"], e["y2"]) for px, py in ((x1, y1), (x2, y2))] + [to_segment_m(e[f"x{k}"], e[f"y{k}"], x1, y1, x2, y2) for k in (1, 2)]
        return crosses | (F.least(*ends) <= width)

    met = s.join(boxed, ["_cx", "_cy"]).filter(F.exists("_edges", near) | contains(F.col("_edges"), x1, y1))
    return met.select(route_id, code).distinct()


def assess_routes(routes: DataFrame, met: DataFrame, warnings: DataFrame, events: DataFrame, route_id: str, code: str) -> DataFrame:
    """Routes with what their corridors meet: warnings by stage, places of a baseline score from 80, events, and the status that follows.

    ``met`` is (route, code) of polygons, ``warnings`` has code, stage and score, ``events`` is (route, event). A place
    without a warning counts for nothing.
    """
    hit = met.join(warnings.select(code, "stage", "score"), code)
    n = lambda c: F.count_if(c)
    by = hit.groupBy(route_id).agg(*(n(F.col("stage") == s).alias(f"n_{s}") for s in ("red", "orange", "yellow")), n(F.col("score") >= 80).alias("n_high"))
    seen = events.groupBy(route_id).agg(F.count("*").alias("n_events"))
    counts = ["n_red", "n_orange", "n_yellow", "n_high", "n_events"]
    out = routes.join(by, route_id, "left").join(seen, route_id, "left").fillna(0, counts)
    listed = F.col("n_orange") + F.col("n_yellow") + F.col("n_high") + F.col("n_events")
    return out.withColumn("status", F.when(F.col("n_red") > 0, "high_risk").when(listed > 0, "caution").otherwise("preferred"))


def feature_collection(features: DataFrame, column: str = "value", most: int = 10_000) -> DataFrame:
    """One row with a GeoJSON collection of the features' JSON texts in sorted order; refused beyond ``most`` of them."""
    few = features.select(column).limit(most + 1)
    if few.count() > most:
        raise ValueError(f"more than {most} features: write them as lines")
    return few.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list(column)), ","), F.lit("]}")).alias(column))
