"""What the plans of joins do with tables that are small as files and large once read."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from slopeworks.operators import geometry, raster, validity
from slopeworks.plans import registry


def broadcast(df) -> list[str]:
    """What a plan's joins broadcast of files' rows; tables made from fixed rows, nations and one row of sums are nothing of the kind."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [re.search(r"[A-Za-z*(]|$", line).start() for line in plan]
    found = []
    for n, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = plan[n + 1 : next((m for m in range(n + 1, len(plan)) if depth[m] <= depth[n]), len(plan))]
            if any("FileScan" in x and "n_nationkey" not in x for x in below) and not any("Aggregate(keys=[]" in x for x in below):
                found.append(below[0].strip(" :+-"))
    return found


@pytest.fixture
def cells(spark, tmp_path):
    """A raster that falls to the east, in a file that is far below any limit of broadcasts."""
    k = F.col("id")
    spark.range(30).select((k / 6).cast("int").alias("row"), (k % 6).cast("int").alias("col"), (10.0 - k % 6).alias("z")).write.parquet(f"{tmp_path}/cells")
    return spark.read.parquet(f"{tmp_path}/cells")


def test_directions_broadcast_no_cells(cells):
    directed = raster.d8_direction(cells)
    assert broadcast(directed) == []
    assert {(r["col"], r["direction"]) for r in directed.collect()} == {(c, 1) for c in range(5)} | {(5, 0)}


@pytest.fixture
def settled_plans(monkeypatch):
    """What the plans of tables that are settled on the way broadcast."""
    found = []

    def watch(module):
        keep = module.settled
        monkeypatch.setattr(module, "settled", lambda df: found.extend(broadcast(df)) or keep(df))

    watch.found = found
    return watch


@pytest.mark.parametrize("name", ["flow_reached", "stream_cells", "zonal_hydrology", "stream_segments"])
def test_flow_broadcasts_no_cells(spark, sf_dir, name, settled_plans):
    settled_plans(raster)
    rows = registry.QUERIES[name](spark, sf_dir)
    assert settled_plans.found + broadcast(rows) == []


def test_sums_along_pointers_of_nodes_that_end_and_go_on(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, None), (5, 3)], "node int, down int")
    assert {tuple(r) for r in raster.accumulate(nodes).collect()} == {(1, 1), (2, 2), (3, 4), (4, 1), (5, 1)}


@pytest.mark.parametrize("name", ["polygon_validity", "geometry_summary", "merged_polygons"])
def test_validity_broadcasts_no_polygons(spark, sf_dir, name, settled_plans):
    settled_plans(validity)
    rows = registry.QUERIES[name](spark, sf_dir)
    assert settled_plans.found + broadcast(rows) == []


def test_nearest_sites_of_a_small_region_are_few_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    points, sites = ([(k, rnd.uniform(11, 12), rnd.uniform(76, 77)) for k in range(n)] for n in (200, 600))
    met, exact = spark.sparkContext.accumulator(0), geometry.haversine_km
    seen = F.udf(lambda x: met.add(1) or 0.0, "double")
    monkeypatch.setattr(geometry, "haversine_km", lambda *c: exact(*c) + seen(c[0]))
    got = {r["p"]: r["nearest_id"] for r in geometry.nearest_sites(spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(sites, "s int, lat double, lon double"), "p", "s").collect()}
    km = lambda a, b: math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    assert got == {p[0]: min(sites, key=lambda s: km(p, s))[0] for p in points}
    assert 0 < met.value < len(points) * len(sites) / 4


def test_nearest_of_many_sites_at_one_place_and_of_one_far_off(spark):
    sites = spark.createDataFrame([(k, 11.0, 76.0) for k in range(50, 10, -1)] + [(7, -60.0, -100.0)], "s int, lat double, lon double")
    points = spark.createDataFrame([(11, 11.0, 76.0), (12, 11.0, 76.0), (7, -60.0, -100.0), (1, 11.0005, 76.0), (2, 40.0, 76.0)], "p int, lat double, lon double")
    found = lambda **how: {r["p"]: r["nearest_id"] for r in geometry.nearest_sites(points, sites, "p", "s", **how).collect()}
    assert found() == {11: 11, 12: 11, 7: 7, 1: 11, 2: 11}
    other = found(exclude_same=True)
    assert (other[11], other[12], other[1], other[2]) == (12, 11, 11, 11) and other[7] == 11
    assert geometry.nearest_sites(points, sites.limit(0), "p", "s").count() == 0
