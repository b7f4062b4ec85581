"""Points, polygons and routes: containment, nearest places, exposure.

A polygon is ``parts``: an array of structs with ``shell`` and ``holes``, whose rings are arrays of
structs of x and y. Polygons and points meet in an equal join on grid cells of the polygon's bounding
box, and only then are rings looked at, in expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slopeworks.functions.scalar import EARTH_KM, haversine_km
from slopeworks.runtime import by_key, settled

RING = "array<struct<x:double,y:double>>"
PARTS = f"array<struct<shell:{RING},holes:array<{RING}>>>"


def edges(parts: Column) -> Column:
    """All edges of all rings, as an array of structs of their ends."""
    ring_edges = lambda ring: F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    rings = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p["shell"]), F.coalesce(p["holes"], F.array().cast(f"array<{RING}>")))))
    return F.flatten(F.transform(rings, ring_edges))


def crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right of the point crosses the edge."""
    at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
    return ((e["y1"] > y) != (e["y2"] > y)) & F.coalesce(x < at, F.lit(False))


def on_edge(e: Column, x: Column, y: Column) -> Column:
    side = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (side == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def touches(ring_edges: Column, x: Column, y: Column) -> Column:
    return F.exists(ring_edges, lambda e: on_edge(e, x, y))


def contains(ring_edges: Column, x: Column, y: Column) -> Column:
    """Strictly inside, by the parity of crossings, which holes flip."""
    odd = F.size(F.filter(ring_edges, lambda e: crosses(e, x, y))) % 2 == 1
    return odd & ~touches(ring_edges, x, y)


def with_box(polygons: DataFrame, parts: str = "parts") -> DataFrame:
    e = F.col("_edges")
    low = lambda a, b: F.array_min(F.transform(e, lambda s: F.least(s[a], s[b])))
    high = lambda a, b: F.array_max(F.transform(e, lambda s: F.greatest(s[a], s[b])))
    return polygons.withColumn("_edges", edges(F.col(parts))).withColumns({"_x1": low("x1", "x2"), "_x2": high("x1", "x2"), "_y1": low("y1", "y2"), "_y2": high("y1", "y2")})


def by_cell(polygons: DataFrame, cell: float) -> DataFrame:
    """A row for each grid cell that a polygon's bounding box meets."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    return polygons.withColumn("_cx", span("_x1", "_x2")).withColumn("_cy", span("_y1", "_y2"))


def link_points(points: DataFrame, polygons: DataFrame, point_id: str, code: str, cell: float = 1.0) -> DataFrame:
    """Every point (columns x, y) with EXACT and the polygon's code, AMBIGUOUS, or NO_MATCH.

    EXACT is inside of just one polygon and on the border of none; AMBIGUOUS is inside of more, or on a border.
    """
    boxed = by_cell(with_box(polygons).select(code, "_edges", "_x1", "_x2", "_y1", "_y2"), cell)
    placed = points.select(point_id, "x", "y").withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    x, y = F.col("x"), F.col("y")
    near = placed.join(boxed, ["_cx", "_cy"]).filter(x.between(F.col("_x1"), F.col("_x2")) & y.between(F.col("_y1"), F.col("_y2")))
    tested = near.withColumns({"_in": contains(F.col("_edges"), x, y), "_on": touches(F.col("_edges"), x, y)}).filter("_in or _on")
    found = tested.groupBy(point_id).agg(F.count_if("_in").alias("n_contains"), F.count_if("_on").alias("n_touches"), F.min(F.when(F.col("_in"), F.col(code))).alias("_code"))
    status = F.when((F.col("n_contains") == 1) & (F.col("n_touches") == 0), "EXACT").when((F.col("n_contains") > 0) | (F.col("n_touches") > 0), "AMBIGUOUS").otherwise("NO_MATCH")
    return points.join(found, point_id, "left").withColumn("match_status", status).withColumn(code, F.when(status == "EXACT", F.col("_code"))).drop("n_contains", "n_touches", "_code")


def exact_code_polygons(polygons: DataFrame, villages: DataFrame) -> DataFrame:
    """Polygons whose village, district and sub-district codes (vlcode, dtcode, sdcode) are those of one village, for ``link_points``."""
    keys = villages.select(F.col("village_lgd_code").alias("vlcode"), F.col("district_lgd_code").alias("dtcode"), F.col("taluk_lgd_code").alias("sdcode"))
    return polygons.join(keys, ["vlcode", "dtcode", "sdcode"], "left_semi")


def geometry_summary(polygons: DataFrame, valid: Column, parts: str = "parts") -> DataFrame:
    """One row: records, valid and invalid ones, those of several parts, and parts. ``valid`` is the source's flag; no geometry is invalid."""
    good = F.col(parts).isNotNull() & F.coalesce(valid, F.lit(False))
    size = F.coalesce(F.array_size(parts), F.lit(0))
    return polygons.agg(
        F.count("*").alias("records"), F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid"), F.count_if(size > 1).alias("multipart"), F.coalesce(F.sum(size), F.lit(0)).alias("polygon_parts")
    )


def zonal(cells: DataFrame, polygons: DataFrame, code: str, values: list[str], cell: float = 8.0) -> DataFrame:
    """Count, mean, least and greatest of raster values over the cells (centres x, y) inside of each polygon."""
    boxed = by_cell(with_box(polygons).select(code, "_edges", "_x1", "_x2", "_y1", "_y2"), cell)
    placed = cells.select("x", "y", *values).withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    inside = placed.join(boxed, ["_cx", "_cy"]).filter(contains(F.col("_edges"), F.col("x"), F.col("y")))
    stats = [f(v).alias(f"{name}_{v}") for v in values for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return polygons.select(code).join(inside.groupBy(code).agg(F.count("*").alias("n_cells"), *stats), code, "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))


def nearest_axis(value: Column, axis: list[float]) -> Column:
    """The nearest of a short list of coordinates, ties to the larger."""
    steps = F.transform(F.array(*(F.lit(float(a)) for a in axis)), lambda a: F.struct(F.abs(a - value).alias("d"), (-a).alias("n")))
    return -F.array_min(steps)["n"]


def _unit(lat: Column, lon: Column) -> list[Column]:
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def _cubes(lat: str, lon: str, width: float, names: tuple[str, str, str] = ("_i", "_j", "_k")) -> dict[str, Column]:
    """The cube of the unit sphere's space that a place is in."""
    return {n: F.floor(c / width) for n, c in zip(names, _unit(F.col(lat), F.col(lon)))}


#: Widths of cubes in radii are powers of two from 100 metres to the whole sphere, and the most places in one to begin with (fixed values).
_FINEST, _WIDEST, _CROWD = -16, 1, 8


def _uncrowded(places: DataFrame) -> int:
    """The power of two of the widest cubes of which none holds more than a few places (_slat, _slon)."""
    fine = places.groupBy(*(c.alias(n) for n, c in _cubes("_slat", "_slon", 2.0**_FINEST).items())).agg(F.count("*").alias("n"))
    levels = fine.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(_WIDEST - _FINEST))))
    wider = levels.groupBy("up", *(F.expr(f"shiftright({n}, up)").alias(n) for n in ("_i", "_j", "_k"))).agg(F.sum("n").alias("n"))
    most = wider.groupBy("up").agg(F.max("n").alias("most")).filter(F.col("most") <= _CROWD).agg(F.max("up").alias("up")).first()["up"]
    return _FINEST + (most or 0)


def nearest_sites(points: DataFrame, sites: DataFrame, point_id: str, site_id: str, exclude_same: bool = False) -> DataFrame:
    """The nearest site of each point by great-circle distance, ties to the smaller site id.

    Points and sites are put into cubes on the unit sphere, and a point meets the sites of its own and the
    26 cubes around it. What it finds within one cube's width cannot be beaten from outside, and nothing else is kept; points that
    find nothing so near go on to cubes twice as wide, until one cube holds the sphere. The first cubes are so narrow that none
    is crowded.
    """
    names = ("_i", "_j", "_k")
    p = points.select(F.col(point_id).alias("_pid"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    s = sites.select(F.col(site_id).alias("_sid"), F.col("lat").alias("_slat"), F.col("lon").alias("_slon"))
    # of sites at one place the smallest id is nearest, or the next if that is the point itself
    nth = F.row_number().over(Window.partitionBy("_slat", "_slon").orderBy("_sid"))
    s = settled(s.withColumn("_nth", nth).filter(F.col("_nth") <= (2 if exclude_same else 1)).drop("_nth"))
    power, found = _uncrowded(s), None
    while True:
        width = 2.0**power
        spread = s.withColumns(_cubes("_slat", "_slon", width))
        for n in names:
            spread = spread.withColumn(n, F.explode(F.array(*(F.col(n) + d for d in (-1, 0, 1)))))
        met = p.withColumns(_cubes("_plat", "_plon", width)).join(by_key(spread), list(names))
        if exclude_same:
            met = met.filter(F.col("_pid") != F.col("_sid"))
        # a little less than a width, for what rounding moves across a cube's side
        sure = 2 * EARTH_KM * math.asin(width / 2 * (1 - 1e-9)) if power < _WIDEST else float("inf")
        near = met.select("_pid", haversine_km(F.col("_plat"), F.col("_plon"), F.col("_slat"), F.col("_slon")).alias("km"), "_sid").filter(F.col("km") <= sure)
        done = settled(near.groupBy("_pid").agg(F.min(F.struct("km", "_sid")).alias("_best")))
        found = done if found is None else found.union(done)
        p = settled(p.join(by_key(done), "_pid", "left_anti"))
        if power >= _WIDEST or p.isEmpty():
            return found.select(F.col("_pid").alias(point_id), F.col("_best._sid").alias("nearest_id"), F.col("_best.km").alias("distance_km"))
        power += 1


def utm(lat: Column, lon: Column, zone: int = 43) -> tuple[Column, Column]:
    """Easting and northing of WGS84 coordinates in a northern UTM zone, by the usual series (to millimetres)."""
    a, e2 = 6378137.0, 0.00669437999014  # of the WGS84 ellipsoid
    k0, ep2, lon0 = 0.9996, e2 / (1 - e2), (zone - 1) * 6 - 177
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    s, c, t2 = F.sin(phi), F.cos(phi), F.pow(F.tan(phi), 2)
    n, c2, q = a / F.sqrt(1 - e2 * s * s), ep2 * c * c, c * lam
    arc = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (q + (1 - t2 + c2) * F.pow(q, 3) / 6 + (5 - 18 * t2 + t2 * t2 + 72 * c2 - 58 * ep2) * F.pow(q, 5) / 120) + 500000
    north = k0 * (arc + n * F.tan(phi) * (q * q / 2 + (5 - t2 + 9 * c2 + 4 * c2 * c2) * F.pow(q, 4) / 24 + (61 - 58 * t2 + t2 * t2 + 600 * c2 - 330 * ep2) * F.pow(q, 6) / 720))
    return east, north


def _to_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The step from a segment's nearest point to a point in the plane."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / F.nullif(length, F.lit(0.0)))))
    return x - (x1 + t * dx), y - (y1 + t * dy)


def to_segment_m(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The distance from a point to a segment in the plane."""
    return F.hypot(*_to_segment(x, y, x1, y1, x2, y2))


def _within(width: float):
    """Whether steps are at most ``width`` long. At just that length rounding decides, and the C library's squares do, as in SQL elsewhere."""

    @F.pandas_udf("boolean")
    def within(across: pd.Series, up: pd.Series) -> pd.Series:
        away = np.hypot(across.to_numpy(), up.to_numpy())
        near = away <= width
        for k in np.flatnonzero(np.abs(away - width) <= 1e-9 * width):
            near[k] = math.sqrt(math.pow(across.iat[k], 2.0) + math.pow(up.iat[k], 2.0)) <= width
        return pd.Series(near)

    return within


def near_routes(points: DataFrame, segments: DataFrame, point_id: str, route_id: str, width: float) -> DataFrame:
    """(route, point) for points (x, y in metres) within ``width`` of a route's segments (x1, y1, x2, y2), by grid cells of that width."""
    cell = F.lit(float(width) * 8)
    lo, hi = (lambda a, b: F.floor((F.least(a, b) - width) / cell)), (lambda a, b: F.floor((F.greatest(a, b) + width) / cell))
    s = segments.withColumn("_cx", F.explode(F.sequence(lo(F.col("x1"), F.col("x2")), hi(F.col("x1"), F.col("x2")))))
    s = s.withColumn("_cy", F.explode(F.sequence(lo(F.col("y1"), F.col("y2")), hi(F.col("y1"), F.col("y2")))))
    p = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    step = _to_segment(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    # only what is near at all is handed to Python
    near = p.join(s, ["_cx", "_cy"]).filter(F.hypot(*step) <= width * (1 + 1e-9)).filter(_within(float(width))(*step))
    return near.select(route_id, point_id).distinct()


def exposure_status(red: Column, listed: Column) -> Column:
    return F.when(red > 0, "high_risk").when(listed > 0, "caution").otherwise("preferred")


def geojson(features: DataFrame, properties: list[str], coordinates: str, kind: str = "MultiLineString", places: int = 5) -> DataFrame:
    """One JSON text per row: a GeoJSON feature with rounded coordinates."""
    rounded = F.transform(F.col(coordinates), lambda line: F.transform(line, lambda v: F.transform(v, lambda c: F.round(c, places))))
    geometry = F.struct(F.lit(kind).alias("type"), rounded.alias("coordinates"))
    return features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def _area_above(e: Column, x1: Column, x2: Column) -> tuple[Column, Column]:
    """Heights of an edge at both sides of a strip that lies within its span."""
    slope = (e["y2"] - e["y1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0))
    return e["y1"] + (x1 - e["x1"]) * slope, e["y1"] + (x2 - e["x1"]) * slope


def overlaps(polygons: DataFrame, code: str, cell: float = 1.0) -> DataFrame:
    """(a, b, area) of pairs of polygons, a before b, whose insides overlap; a shared border is no overlap.

    Both polygons are cut into strips at all their corners and at all crossings of their edges. Within a strip
    edges do not cross, so the polygons are stacks of trapezoids, and what both cover is summed by intervals
    of their heights at the strip's middle. Pairs meet on grid cells of their bounding boxes.
    """
    boxed = with_box(polygons).select(F.col(code).alias("code"), "_edges", "_x1", "_x2", "_y1", "_y2")
    left, right = (boxed.select(*(F.col(c).alias(f"{s}{c}") for c in boxed.columns)) for s in ("l", "r"))
    span = lambda s, a, b: F.explode(F.sequence(F.floor(F.col(f"{s}{a}") / cell), F.floor(F.col(f"{s}{b}") / cell)))
    cells = lambda df, s: df.withColumn("cx", span(s, "_x1", "_x2")).withColumn("cy", span(s, "_y1", "_y2")).select(f"{s}code", "cx", "cy")
    near = cells(left, "l").join(cells(right, "r"), ["cx", "cy"]).filter("lcode < rcode").select("lcode", "rcode").distinct()
    pairs = near.join(left, "lcode").join(right, "rcode").filter("l_x1 < r_x2 and r_x1 < l_x2 and l_y1 < r_y2 and r_y1 < l_y2")
    both = F.concat("l_edges", "r_edges")

    def crossing(e: Column, f: Column) -> Column:
        """The x at which two edges cross, null if they do not or are parallel."""
        dx1, dy1, dx2, dy2 = e["x2"] - e["x1"], e["y2"] - e["y1"], f["x2"] - f["x1"], f["y2"] - f["y1"]
        det = F.nullif(dx1 * dy2 - dy1 * dx2, F.lit(0.0))
        t = ((f["x1"] - e["x1"]) * dy2 - (f["y1"] - e["y1"]) * dx2) / det
        u = ((f["x1"] - e["x1"]) * dy1 - (f["y1"] - e["y1"]) * dx1) / det
        return F.when(t.between(0, 1) & u.between(0, 1), e["x1"] + t * dx1)

    met = F.flatten(F.transform("l_edges", lambda e: F.transform("r_edges", lambda f: crossing(e, f))))
    cuts = F.array_sort(F.array_distinct(F.concat(F.transform(both, lambda e: e["x1"]), F.array_compact(met))))
    strips = pairs.withColumn("cuts", cuts).select("lcode", "rcode", "l_edges", "r_edges", F.explode(F.zip_with(F.slice("cuts", 1, F.size("cuts") - 1), F.slice("cuts", 2, F.size("cuts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("s"))
    middle = (F.col("s.a") + F.col("s.b")) / 2

    def heights(name: str) -> Column:
        """Sorted heights at the strip's middle of the edges that span it; inside is between odd and even ones."""
        spanning = F.filter(name, lambda e: (F.least(e["x1"], e["x2"]) <= F.col("s.a")) & (F.greatest(e["x1"], e["x2"]) >= F.col("s.b")) & (e["x1"] != e["x2"]))
        return F.array_sort(F.transform(spanning, lambda e: _area_above(e, middle, middle)[0]))

    inside = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 2, F.lit(2)), lambda k: F.struct(F.get(h, k).alias("lo"), F.get(h, k + 1).alias("hi")))
    tall = strips.withColumn("p", heights("l_edges")).withColumn("q", heights("r_edges")).filter("size(p) >= 2 and size(q) >= 2").withColumn("p", inside(F.col("p"))).withColumn("q", inside(F.col("q")))
    shared = F.flatten(F.transform("p", lambda x: F.transform("q", lambda y: F.greatest(F.lit(0.0), F.least(x["hi"], y["hi"]) - F.greatest(x["lo"], y["lo"])))))
    areas = tall.withColumn("area", (F.col("s.b") - F.col("s.a")) * F.aggregate(shared, F.lit(0.0), lambda t, v: t + v))
    return areas.groupBy(F.col("lcode").alias("a"), F.col("rcode").alias("b")).agg(F.sum("area").alias("area")).filter("area > 0")
