"""Readers of the domain's files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeworks.functions.scalar import last_coordinates

#: No file holds this, so "NA" and "" stay what they are.
_NEVER = "\x00never\x00"


def csv_text(spark: SparkSession, path: str, keep_literals: bool = True) -> DataFrame:
    """All columns as text; a byte-order mark goes from the first name, and NA and blanks stay as they are."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("inferSchema", False)
    if keep_literals:
        reader = reader.option("nullValue", _NEVER).option("emptyValue", "")
    df = reader.csv(path)
    df = df.na.fill("") if keep_literals else df  # a blank cell is read as null whatever the options say
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def csv_typed(spark: SparkSession, path: str, schema: T.StructType | str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Declared types; a value that does not parse fails the read rather than turning null."""
    return spark.read.option("header", True).option("mode", "FAILFAST").option("dateFormat", date_format).option("enforceSchema", False).schema(schema).csv(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, content) of a folder's files by a glob, sorted by path; an error if there is none."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    if df.select("path").isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return df.select("path", "content").orderBy("path")


def rainfall_cube_checks(cube: DataFrame, year: int, unit: str | None = None) -> DataFrame:
    """One row of structural checks on a long rainfall table (date, lat, lon, mm) of a source year, whose unit has to be mm."""
    wanted = F.dayofyear(F.make_date(F.lit(year), F.lit(12), F.lit(31)))
    inside = F.year("date") == year
    return cube.agg(
        (F.count_distinct(F.when(inside, F.col("date"))) == wanted).alias("covers_year"),
        (F.count("*") == F.count_distinct("date", "lat", "lon")).alias("unique_cells"),
        (F.count("*") == F.count_distinct("date") * F.count_distinct("lat", "lon")).alias("dense"),
        F.coalesce(F.bool_and(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)), F.lit(False)).alias("axes_in_range"),
        F.lit(unit == "mm").alias("unit_is_mm"),
    )


def axis_faults(axes: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """(axis, position, fault) of a cube's axes (axis, position, value): a value that is no number, out of its limits, or not above the one before."""
    from pyspark.sql.window import Window

    value = F.col("value").cast("double")
    before = F.last(F.when(~F.isnan(value), value), ignorenulls=True).over(Window.partitionBy("axis").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    low, high = (F.create_map(*(F.lit(x) for name, ends in limits.items() for x in (name, float(ends[k]))))[F.col("axis")] for k in (0, 1))
    fault = F.when(value.isNull() | F.isnan(value), "no_number").when(~value.between(low, high), "out_of_limits").when(value <= before, "not_rising")
    return axes.select("axis", "position", fault.alias("fault")).filter("fault is not null")


def of_district(marks: DataFrame, names: list[str], attribute: str = "district") -> DataFrame:
    """Placemarks of the districts, matched trimmed and in any case."""
    return marks.filter(F.lower(F.trim(F.col("attributes")[attribute])).isin([n.strip().lower() for n in names]))


def anchored(lines: DataFrame, state: str, columns: list[tuple[str, int, int]], text: str = "value") -> DataFrame:
    """Cells of fixed-width lines whose columns are counted from where the state's name begins in each line, with the last coordinates.

    Lines without the state's name have null cells.
    """
    at = F.nullif(F.instr(text, state), F.lit(0))
    cell = lambda start, width: F.when(at.isNotNull(), F.nullif(F.trim(F.substring(F.col(text), F.greatest(F.lit(1), at + start), F.lit(width))), F.lit("")))
    return lines.select("*", *(cell(start, width).alias(name) for name, start, width in columns), last_coordinates(F.col(text)).alias("place"))


def inventory_rows(lines: DataFrame, text: str = "value", pages: tuple[int, int] | None = None) -> DataFrame:
    """Rows of a text table that begin with a serial number, with continuation lines joined to them.

    ``lines`` has page, line and the text. Each line takes the serial of the last one that began with one, on its page. Only
    pages from the first to the last of ``pages`` are read.
    """
    from pyspark.sql.window import Window

    lines = lines.filter(F.col("page").between(*pages)) if pages else lines
    along = Window.partitionBy("page").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    serial = F.nullif(F.regexp_extract(text, r"^\s{0,8}(\d{1,4})\s", 1), F.lit("")).cast("int")
    rows = lines.withColumn("serial", F.last(serial, ignorenulls=True).over(along)).filter("serial is not null")
    joined = rows.groupBy("page", "serial").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("row_text"))
    return joined
