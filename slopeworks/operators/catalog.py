"""What there is: sources, their coverage and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source_id string, name string, data_type string, planned boolean, artifacts array<string>"


def catalog(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    return spark.createDataFrame(entries, SCHEMA)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that Spark reads it with."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def availability(sources: DataFrame, paths: set[str], has_sensor: bool = False, eligible_shelters: int = 0) -> DataFrame:
    """Each source with its status: planned, or available if what it depends on is there."""
    there = F.array(*(F.lit(p) for p in sorted(paths))).cast("array<string>")
    by_files = (F.size("artifacts") > 0) & F.forall("artifacts", lambda a: F.array_contains(there, a))
    ready = F.when(F.col("source_id") == "soil_moisture", F.lit(has_sensor)).when(F.col("source_id") == "shelters", F.lit(eligible_shelters > 0)).otherwise(by_files)
    return sources.withColumn("status", F.when(F.col("planned"), "planned").when(ready, "available").otherwise("unavailable"))


def coverage_snapshot(counts: dict[str, DataFrame], total: str) -> DataFrame:
    """One row: the rows of each table, and each one's share of ``total`` in percent to one place."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias(f"n_{name}"))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    share = {f"pct_{n}": F.rint(1000.0 * F.col(f"n_{n}") / F.nullif(F.col(f"n_{total}"), F.lit(0))) / 10 for n in counts}
    return out.withColumns(share)


def readiness(counts: DataFrame, needs: dict[str, list[str]]) -> DataFrame:
    """The snapshot with ``ready_<name>``: whether all tables that it needs have rows, and ``ready`` if all are."""
    flags = {f"ready_{name}": F.least(*(F.col(f"n_{t}") > 0 for t in tables), F.lit(True)) for name, tables in needs.items()}
    return counts.withColumns(flags).withColumn("ready", F.least(*(F.col(f) for f in flags), F.lit(True)))


def with_lineage(df: DataFrame, constants: dict[str, str], templates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``df`` with constant columns, and with columns whose text is a format that takes one column's value."""
    return df.withColumns({n: F.lit(v) for n, v in constants.items()} | {n: F.format_string(text, F.col(c)) for n, (text, c) in (templates or {}).items()})


def source_provenance(rows: DataFrame, group: str, files: DataFrame, content: str, date: str, lat: str, lon: str) -> DataFrame:
    """Per source: the SHA-256 of each of its files, distinct coordinates and dates, their ranges, rows, and the rows of all sources.

    ``files`` has the group and the content, as from the binaryFile reader; digests are in order, a source without a file has none.
    """
    out = rows.groupBy(group).agg(
        F.count_distinct(lat).alias("n_lat"), F.count_distinct(lon).alias("n_lon"), F.count_distinct(date).alias("n_dates"), F.min(date).alias("first_date"),
        F.max(date).alias("last_date"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"), F.count("*").alias("n_rows"),
    )
    digests = provenance(files, group, content)
    out = out.join(digests, group, "left").withColumns({"n_files": F.coalesce("n_files", F.lit(0)), "sha256s": F.coalesce("sha256s", F.array().cast("array<string>"))})
    return out.crossJoin(F.broadcast(out.agg(F.sum("n_rows").alias("n_total"))))


def map_payload(metadata: DataFrame, complete: bool, layers: list[str]) -> DataFrame:
    """One row: the metadata with an overlay's address for each layer, all null while the source is incomplete."""
    url = lambda n: F.when(F.lit(complete), F.concat(F.lit("/overlays/"), F.lit(n), F.lit(".png"))).alias(f"{n}_url")
    return metadata.select(F.lit("available" if complete else "unavailable").alias("status"), *(F.when(F.lit(complete), F.col(c)).alias(c) for c in metadata.columns), *(url(n) for n in layers))


def provenance(files: DataFrame, group: str, content: str) -> DataFrame:
    """(group, n_files, sha256s) of file contents as from the binaryFile reader."""
    return files.groupBy(group).agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list(F.sha2(F.col(content), 256))).alias("sha256s"))
