"""Writers with the domain's rules: stage first, never overwrite by chance, never publish a regression."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.operators.joins import enforce, regression_differences


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_text(df: DataFrame, path: str) -> None:
    df.write.text(path)


def write_provenance(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON document with sorted keys, through Spark's file system."""
    fs, target = _fs(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(json.dumps(record, sort_keys=True, indent=2).encode()))
    finally:
        out.close()


def refuse_overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def publish(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes all tables as one release and only then makes it the current one, by one rename over a pointer file.

    Readers (``read_published``) find either all tables of the old release or all of the new one, whenever a writer stops.
    """
    spark = next(iter(tables.values())).sparkSession
    release = f"releases/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{release}/{name}")
    fs, fresh = _fs(spark, f"{folder}/{release}/pointer")
    out = fs.create(fresh, False)
    try:
        out.write(bytearray(release.encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, _fs(spark, f"{folder}/current")[1], over)


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the current release."""
    release = spark.read.text(f"{folder}/current").first()[0]
    return spark.read.parquet(f"{folder}/{release}/{name}")


def publish_if_unchanged(df: DataFrame, prior: DataFrame, path: str, keys: list[str], numbers: list[str]) -> None:
    """Refuses to write when a number of an earlier release changed."""
    kept = df.join(prior.select(*keys).distinct(), keys, "left_semi")
    enforce(regression_differences(kept, prior, keys, numbers), "values differ from the earlier release")
    df.write.parquet(path)


def purge(df: DataFrame, flag: str, path: str) -> None:
    """Rewrites a table without its test rows; the target is another folder than the source."""
    df.filter(~F.coalesce(F.col(flag), F.lit(False))).write.parquet(path)


def markdown_report(title: str, counts: DataFrame) -> str:
    """A report from one row of counts."""
    row = counts.first().asDict()
    return "\n".join([f"# {title}", "", "| measure | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in row.items())]) + "\n"


def preview_rgba(cells: DataFrame, threshold: float, top: float) -> DataFrame:
    """Colour of a log-scaled preview: opacity from 75 at the threshold to 240 at ``top``."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10(F.col("accumulation") / threshold) / F.log10(F.lit(top / threshold))))
    return cells.withColumn("alpha", F.when(F.col("accumulation") >= threshold, F.rint(75 + 165 * t).cast("int")).otherwise(0))
