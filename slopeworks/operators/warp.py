"""A geographic raster on a projected grid: the inverse projection, target grids, and a warp that reads only what it needs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.operators.places import bilinear

#: The WGS84 ellipsoid and the scale and false easting of UTM (fixed values).
_A, _F, _K0, _EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0
_N = _F / (2 - _F)
#: Krueger's series in the third flattening, to its fourth power: the rectifying radius, plane to sphere, sphere to ellipsoid.
RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def from_utm(east: Column, north: Column, zone: int = 43) -> tuple[Column, Column]:
    """Latitude and longitude of a point in a northern UTM zone, within nanometres of the exact inverse."""
    xi, eta = north / (_K0 * RADIUS), (east - _EAST) / (_K0 * RADIUS)
    x, e = xi, eta
    for j, b in enumerate(BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), (zone - 1) * 6 - 177 + F.degrees(F.atan2(F.sinh(e), F.cos(x)))


def grid(spark: SparkSession, west: float, south: float, east: float, north: float, res: float) -> tuple[DataFrame, float, float]:
    """Cells (row, col, east, north of their centres) of a grid whose edges are multiples of ``res``, with its west and north edge."""
    left, top = math.floor(west / res) * res, math.ceil(north / res) * res
    cols, rows = round((math.ceil(east / res) * res - left) / res), round((top - math.floor(south / res) * res) / res)
    k = F.col("id")
    row, col = F.floor(k / cols).cast("int"), (k % cols).cast("int")
    cells = spark.range(rows * cols).select(row.alias("row"), col.alias("col"), (left + (col + 0.5) * res).alias("east"), (top - (row + 0.5) * res).alias("north"))
    return cells, left, top


def needed(target: DataFrame, west: float, north: float, res: float) -> tuple[int, int, int, int]:
    """First and last row and column of the source that the points (x, y) of a target reach.

    The rim of a grid's cells reaches as far as all of them, so the rim is enough.
    """
    col, row = (F.col("x") - west) / res - 0.5, (north - F.col("y")) / res - 0.5
    low, high = lambda c: F.floor(F.min(c)), lambda c: F.floor(F.max(c)) + 1
    found = target.agg(low(row), high(row), low(col), high(col)).first()
    return tuple(found) if found[0] is not None else (0, -1, 0, -1)


def warped(source: DataFrame, target: DataFrame, west: float, north: float, res: float, zone: int = 43, value: str = "z") -> DataFrame:
    """``target`` (row, col, east, north) with the source's value by bilinear weights, null where it has none.

    ``source`` has row, col and the value on a geographic grid. It is asked only for the rows and columns that the target
    reaches; a file source reads no other blocks.
    """
    lat, lon = from_utm(F.col("east"), F.col("north"), zone)
    points = target.select("row", "col", "east", "north", lon.alias("x"), lat.alias("y"))
    rim = target.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("row", "col") for f in (F.min, F.max))).first()
    at_rim = F.col("row").isin(rim["min_row"], rim["max_row"]) | F.col("col").isin(rim["min_col"], rim["max_col"]) if rim["min_row"] is not None else F.lit(False)
    top, bottom, left, right = needed(points.filter(at_rim), west, north, res)
    part = source.filter(F.col("row").between(top, bottom) & F.col("col").between(left, right))
    renamed = points.withColumnsRenamed({"row": "t_row", "col": "t_col"})
    out = bilinear(renamed, part, west, north, res, value)
    return out.select(F.col("t_row").alias("row"), F.col("t_col").alias("col"), "east", "north", value)
