"""Lines: simplification by Douglas and Peucker, routes of two providers in one shape, and how far routes end from where they should."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.runtime import on_workers

POINTS = "array<struct<x:double,y:double>>"


def kept(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay: both ends, and of each stretch the farthest from its chord, if farther than the tolerance; the first on ties."""
    stay = np.zeros(len(points), bool)
    if len(points):
        stay[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        first, last = todo.pop()
        if last - first < 2:
            continue
        a, b, between = points[first], points[last], points[first + 1 : last]
        chord = b - a
        length = chord @ chord
        along = np.clip((between - a) @ chord / length, 0, 1) if length > 0 else np.zeros(len(between))
        away = np.hypot(*(between - (a + along[:, None] * chord)).T)
        k = int(away.argmax())
        if away[k] > tolerance:
            middle = first + 1 + k
            stay[middle] = True
            todo += [(first, middle), (middle, last)]
    return stay


def simplified(lines: DataFrame, tolerance: float, points: str = "points") -> DataFrame:
    """Lines without the points (structs of x and y) that lie within the tolerance of what is left; null and empty lines stay as they are."""
    on_workers(lines.sparkSession)
    at = lines.columns.index(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            out = []
            for line in column.to_pylist():
                found = None if line is None else np.array([(p["x"], p["y"]) for p in line], float).reshape(-1, 2)
                out.append(None if line is None else [p for p, k in zip(line, kept(found, tolerance)) if k])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, column.type))

    return lines.mapInArrow(run, lines.schema)


_GEOMETRY = "geometry:struct<type:string,coordinates:array<array<double>>>"
#: What the two providers answer, as far as it is used.
_PLAIN = f"code string, routes array<struct<{_GEOMETRY},distance:double,duration:double>>, waypoints array<struct<location:array<double>>>"
_FEATURES = f"features array<struct<{_GEOMETRY},properties:struct<summary:struct<distance:double,duration:double>>>>"
PROVIDERS = {"osrm": "OSRM / OpenStreetMap", "ors": "OpenRouteService / OpenStreetMap"}


def routes(answers: DataFrame, provider: str, body: str = "body") -> DataFrame:
    """Routes of the providers' JSON answers in one shape, a row each: the answer's other columns, ``route_no``, ``points``, ``distance_m``,
    ``duration_s``, ``provider``, ``snapped_origin``, ``snapped_destination``, and ``reason`` (null: good).

    An answer without a route is one row with the reason ``no_route``.
    """
    name = F.when(F.col(provider) == "osrm", PROVIDERS["osrm"]).when(F.col(provider) == "ors", PROVIDERS["ors"])
    rows = answers.withColumns({"_plain": F.from_json(body, _PLAIN), "_features": F.from_json(body, _FEATURES), "_provider": name})
    one = lambda g, distance, duration: F.struct(g["type"].alias("type"), g["coordinates"].alias("coordinates"), distance.alias("distance_m"), duration.alias("duration_s"))
    plain = F.when(F.col("_plain.code") == "Ok", F.transform("_plain.routes", lambda r: one(r["geometry"], r["distance"], r["duration"])))
    summary = lambda f: f["properties"]["summary"]
    features = F.transform("_features.features", lambda f: one(f["geometry"], summary(f)["distance"], summary(f)["duration"]))
    found = F.when(F.col(provider) == "osrm", plain).otherwise(features)
    snapped = lambda k: F.when(F.col(provider) == "osrm", F.get("_plain.waypoints", F.lit(k))["location"])
    others = [c for c in answers.columns if c != body]
    rows = rows.select(*others, F.col("_provider").alias("_name"), snapped(0).alias("snapped_origin"), snapped(1).alias("snapped_destination"), F.posexplode_outer(F.when(F.size(found) > 0, found)).alias("route_no", "r"))
    coordinates = F.col("r.coordinates")
    inside = lambda p: F.coalesce((F.size(p) >= 2) & F.get(p, F.lit(0)).between(-180, 180) & F.get(p, F.lit(1)).between(-90, 90), F.lit(False))
    reason = (
        F.when(F.col("_name").isNull(), "unknown_provider").when(F.col("r").isNull(), "no_route").when(~F.col("r.type").eqNullSafe("LineString"), "not_a_line")
        .when(coordinates.isNull() | (F.size(coordinates) < 2), "too_few_points").when(~F.forall(coordinates, inside), "coordinate_out_of_range")
        .when(F.col("r.distance_m").isNull() | F.col("r.duration_s").isNull(), "no_distance_or_time").when(~((F.col("r.distance_m") > 0) & (F.col("r.duration_s") > 0)), "not_positive")
    )
    points = F.transform(coordinates, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return rows.select(*others, "route_no", points.alias("points"), "r.distance_m", "r.duration_s", F.col("_name").alias("_p"), "snapped_origin", "snapped_destination", reason.alias("reason")).withColumnRenamed("_p", "provider_name")


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on the mean sphere."""
    lat1, lon1, lat2, lon2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * 6_371_008.8 * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


def line_length(points: Column) -> Column:
    """Metres along a line of longitudes x and latitudes y."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: metres(a["y"], a["x"], b["y"], b["x"]))
    return F.aggregate(steps, F.lit(0.0), lambda total, m: total + m)


def end_gaps(points: Column, origin: tuple[Column, Column], destination: tuple[Column, Column]) -> tuple[Column, Column]:
    """Metres from a line's first point to the origin (latitude, longitude), and from its last to the destination."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    return metres(first["y"], first["x"], *origin), metres(last["y"], last["x"], *destination)
