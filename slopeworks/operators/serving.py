"""Filters, rankings and assembled documents that answer a user's question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slopeworks.runtime import settled


def search(df: DataFrame, text: str, names: list[str], codes: list[str]) -> DataFrame:
    """Rows of which a name contains the text in any case, or a code contains it as it is."""
    low = text.strip().lower()
    hit = F.lit(low == "")
    for c in names:
        hit = hit | F.coalesce(F.lower(c).contains(low), F.lit(False))
    for c in codes:
        hit = hit | F.coalesce(F.col(c).contains(text.strip()), F.lit(False))
    return df.filter(hit)


def with_tier(df: DataFrame, column: str, wanted: str | None) -> DataFrame:
    """Rows of one tier, or all if none is asked for."""
    return df.filter(F.col(column) == wanted.upper()) if wanted else df


def by_name(name: str) -> list[Column]:
    """Names in any case; those that are the same but for case go by their letters."""
    return [F.asc_nulls_last(F.lower(name)), F.asc_nulls_last(name)]


def order_by_score(score: str, descending: bool = True, tie: str | None = None) -> list[Column]:
    """Rows without a score come last in either direction."""
    first = F.desc_nulls_last(score) if descending else F.asc_nulls_last(score)
    return [first] + ([F.asc(tie)] if tie else [])


def ranked(df: DataFrame, order: list[Column], keys: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Rows with their position from 1 within their keys; a limit prunes rows before they are shuffled.

    Without keys the whole table is ranked in ranges of its order, each counted, so that no task has all rows.
    """
    if not keys and not top:
        return _numbered(df, order)
    rows = df if keys else df.orderBy(*order).limit(top)
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)))
    return rows.filter(F.col("position") <= top) if top else rows


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select(F.col("_range"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(before), "_range").withColumn("position", (place + F.col("_before")).cast("int")).select(*df.columns, "position")


def newest(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The newest rows with their position, 1 to 500 of them whatever is asked; every task sends its own newest only."""
    wanted = max(1, min(500, limit))
    return ranked(df.orderBy(*(F.desc(c) for c in order)).limit(wanted), [F.desc(c) for c in order])


def route_order() -> list[Column]:
    """Routes by status (an unknown one last), then warnings, susceptibility, events, length and time."""
    place = F.array_position(F.array(F.lit("preferred"), F.lit("caution"), F.lit("high_risk")), F.col("status"))
    status = F.when(place > 0, place).otherwise(4)
    return [status.asc(), *(F.asc(c) for c in ("n_red", "n_orange", "n_high", "n_events", "distance_m", "duration_s"))]


def histogram(df: DataFrame, column: str, domain: list) -> DataFrame:
    """(value, n) over a whole domain, with zeros for values that do not occur."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in domain], f"`{column}` {df.schema[column].dataType.simpleString()}")
    return wanted.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def year_slice(df: DataFrame, date: str, year: int) -> DataFrame:
    """A half-open range of dates, which a scan can prune by."""
    return df.filter((F.col(date) >= F.lit(f"{year}-01-01").cast("date")) & (F.col(date) < F.lit(f"{year + 1}-01-01").cast("date")))


def assemble(base: DataFrame, key: str, parts: dict[str, DataFrame | None]) -> DataFrame:
    """A struct per source for each key: its values and a status.

    A source that is not there at all (None) is unavailable; one without a row for a key is missing.
    """
    out = base
    for name, rows in parts.items():
        if rows is None:
            out = out.withColumn(name, F.struct(F.lit("unavailable").alias("status")))
            continue
        values = [c for c in rows.columns if c != key]
        packed = rows.select(key, F.struct(F.lit("available").alias("status"), *values).alias(name))
        empty = F.struct(F.lit("missing").alias("status"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in values))
        out = out.join(packed, key, "left").withColumn(name, F.coalesce(name, empty))
    return out


def outcome(known: Column, source_complete: bool, has_row: Column) -> Column:
    """unknown_place, source_unavailable, no_row or available."""
    return F.when(~known, "unknown_place").when(F.lit(not source_complete), "source_unavailable").when(~has_row, "no_row").otherwise("available")
