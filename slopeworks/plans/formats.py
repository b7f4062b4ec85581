"""Queries over files: tables written in a format and read back through the same source that reads files of others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.operators import raster
from slopeworks.plans.hazard import _GRID, _cells, query
from slopeworks.plans.regions import _BOXES, _boxes
from slopeworks.runtime import shared_folder, table
from slopeworks.sources import files, geotiff, placemarks, readers, sheets


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(f"with {_BOXES} select cast(k as varchar) as code, 1 as n_parts, 5 as n_points, x1 as west, x2 as east, y1 as south, y2 as north from b where k % 3 <> 1")
def placemark_files(spark, sf_dir):
    """Boxes as placemarks of three districts, in as many KMZ files as partitions; those of two districts come back."""
    files.register(spark, placemarks.Placemarks)
    folder, k = _folder(spark), F.col("k").cast("string")
    district = F.element_at(F.array(F.lit(" North "), F.lit("South"), F.lit("EAST")), (F.col("k") % 3 + 1).cast("int"))
    marks = _boxes(spark, sf_dir).select(F.create_map(F.lit("vlcode"), k, F.lit("district"), district).alias("attributes"), "parts")
    marks.write.format("placemarks").mode("append").save(folder)
    rows = readers.of_district(spark.read.format("placemarks").load(folder), ["north", "East"])
    shell = F.col("parts")[0]["shell"]
    x, y = F.transform(shell, lambda p: p["x"]), F.transform(shell, lambda p: p["y"])
    extent = [F.array_min(x).alias("west"), F.array_max(x).alias("east"), F.array_min(y).alias("south"), F.array_max(y).alias("north")]
    return rows.select(F.col("attributes")["vlcode"].alias("code"), F.size("parts").alias("n_parts"), F.size(shell).alias("n_points"), *extent)


def _raster_files(spark: SparkSession, cells: DataFrame, size: int) -> DataFrame:
    folder = _folder(spark)
    geotiff.write(cells.select("row", "col", F.col("z").alias("value")), folder, west=76.0, north=12.0, res=0.25, dtype="float64", size=size)
    return geotiff.read(spark, folder)


@query(f'with {_GRID} select "row", col, 76 + (col + 0.5) * 0.25 as x, 12 - ("row" + 0.5) * 0.25 as y, z as value from cells where "row" between 3 and 20 and col < 30 and z <> 13')
def raster_files(spark, sf_dir):
    """Cells in GeoTIFF files of 16 by 16, some masked, read back by their place."""
    cells = _cells(spark, sf_dir).withColumn("z", F.when(F.col("z") != 13, F.col("z")))
    back = geotiff.on_grid(_raster_files(spark, cells, 16), 76.0, 12.0, 0.25).filter("row between 3 and 20 and col < 30 and z is not null")
    return back.select("row", "col", (76 + (F.col("col") + 0.5) * 0.25).alias("x"), (12 - (F.col("row") + 0.5) * 0.25).alias("y"), F.col("z").alias("value"))


@query(f'with {_GRID} select count(*) as n_files, cast(sum(n) as bigint) as n_cells, cast(sum(total) as double) as total from (select "row" // 16 as r, col // 16 as c, count(*) as n, sum(z) as total from cells group by 1, 2)')
def raster_mosaic_files(spark, sf_dir):
    """Files of a raster that overlap files of the same raster raised: the first file's value counts, which is the lower one's."""
    folder, cells = _folder(spark), _cells(spark, sf_dir).select("row", "col", F.col("z").alias("value"))
    geotiff.write(cells, f"{folder}/a", west=76.0, north=12.0, res=0.25, size=16)
    raised = cells.filter("col >= 8").withColumns({"col": F.col("col") - 8, "value": F.col("value") + 100})
    geotiff.write(raised, f"{folder}/b", west=78.0, north=12.0, res=0.25, size=16)
    merged = raster.mosaic(geotiff.on_grid(geotiff.read(spark, folder), 76.0, 12.0, 0.25)).filter("z is not null")
    n_files = spark.read.format("geotiff_info").load(f"{folder}/a").agg(F.count("*").alias("n_files"))
    return n_files.crossJoin(merged.agg(F.count("*").alias("n_cells"), F.sum("z").alias("total")))


@query("select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey, case when c_custkey % 5 <> 0 then c_mktsegment end as c_mktsegment from customer")
def sheet_files(spark, sf_dir):
    """Customers as workbooks, read back as text with the cells that are not there null."""
    files.register(spark, sheets.Sheet)
    folder = _folder(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    rows.write.format("sheet").option("sheet", "Master").mode("append").save(folder)
    return spark.read.format("sheet").option("sheet", "Master").load(folder)
