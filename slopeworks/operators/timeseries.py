"""Calendar windows, percentiles and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slopeworks.functions.scalar import finite


def densify(df: DataFrame, keys: list[str], date: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """A row for each key and each day from ``start`` to ``end`` (of each key, if not given); other columns are null where a day was missing."""
    spans = df.groupBy(*keys).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    days = F.explode(F.sequence(start if start is not None else F.col("_first"), end if end is not None else F.col("_last"))).alias(date)
    return spans.select(*keys, days).join(df, [*keys, date], "left")


def trailing_sum(value: str, keys: list[str], order: str, n: int) -> Column:
    """The sum of the last n rows; null unless all n are there and not null. NaN counts as null."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(v).over(w) == n, F.sum(v).over(w))


def antecedent(df: DataFrame, keys: list[str], date: str, value: str, spans: tuple[int, ...] = (3, 7)) -> DataFrame:
    """``df`` with the complete trailing sums; all of them share one sort."""
    return df.withColumns({f"sum_{n}d": trailing_sum(value, keys, date, n) for n in spans})


def climatology(df: DataFrame, keys: list[str], value: str, years: int = 5) -> DataFrame:
    """Per key: exact 95th percentiles of the antecedent sums, the daily maximum, and the yearly mean."""
    return df.groupBy(*keys).agg(
        F.percentile("sum_7d", 0.95).alias("p95_7d"), F.percentile("sum_3d", 0.95).alias("p95_3d"),
        F.max(value).alias("max_1d"), (F.sum(value) / F.lit(float(years))).alias("annual_mean"),
    )


def min_max(df: DataFrame, columns: list[str], suffix: str = "_norm", strict: bool = True) -> DataFrame:
    """Columns scaled to 0..1 by their extremes over the whole table, which are one broadcast row.

    A column that is constant or holds a value that is not finite is an error; unless ``strict``, all its scaled values are null where
    all values are alike.
    """
    ends = df.agg(*(f(c).alias(f"_{f.__name__}_{c}") for c in columns for f in (F.min, F.max)), *(F.bool_and(finite(F.col(c)).isNotNull()).alias(f"_finite_{c}") for c in columns))
    if strict:
        for c in columns:
            good = F.col(f"_finite_{c}") & (F.col(f"_max_{c}") > F.col(f"_min_{c}"))
            ends = ends.withColumn(f"_max_{c}", F.when(good | F.col(f"_finite_{c}").isNull(), F.col(f"_max_{c}")).otherwise(F.raise_error(F.lit(f"{c} is constant or not finite"))))
    joined = df.crossJoin(F.broadcast(ends))
    scaled = {f"{c}{suffix}": F.when(F.col(f"_max_{c}") > F.col(f"_min_{c}"), (F.col(c) - F.col(f"_min_{c}")) / (F.col(f"_max_{c}") - F.col(f"_min_{c}"))) for c in columns}
    return joined.withColumns(scaled).select(*df.columns, *scaled)


def composite_index(terrain: Column, rain: Column, history: Column, weights: tuple[float, float, float] = (0.35, 0.40, 0.25)) -> Column:
    return 100.0 * (weights[0] * terrain + weights[1] * rain + weights[2] * history)


def rolling_audit(df: DataFrame, keys: list[str], date: str, one: str, three: str, seven: str) -> DataFrame:
    """Per key and year: days, days that the calendar lacks, days without a value, and nulls of the two sums.

    A complete year has none of the first three kinds, and 2 and 6 nulls of sums that start afresh each year.
    """
    year = F.year(date)
    days = F.dayofyear(F.make_date(F.col("year"), F.lit(12), F.lit(31)))
    by = df.groupBy(*keys, year.alias("year")).agg(
        F.count("*").alias("n_rows"), F.count_distinct(date).alias("n_days"), F.count_if(F.col(one).isNull()).alias("n_null_1d"),
        F.count_if(F.col(three).isNull()).alias("n_null_3d"), F.count_if(F.col(seven).isNull()).alias("n_null_7d"),
    )
    whole = (F.col("n_rows") == F.col("n_days")) & (F.col("n_days") == days) & (F.col("n_null_1d") == 0) & (F.col("n_null_3d") == 2) & (F.col("n_null_7d") == 6)
    return by.withColumn("n_missing", (days - F.col("n_days")).cast("long")).withColumn("complete", whole)


def missing_days(df: DataFrame, keys: list[str], date: str, start: Column, end: Column) -> DataFrame:
    """(keys, date) of the days of a calendar that the table lacks."""
    wanted = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(start, end)).alias(date))
    return wanted.join(df.select(*keys, date), [*keys, date], "left_anti")


def year_audit(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n_rows"), F.count_distinct(F.to_date(date)).alias("n_dates"))


def explicit_date(text: Column) -> Column:
    """The date of text as year-month-day; null for anything else."""
    raw = F.trim(text.cast("string"))
    return F.try_to_timestamp(F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), raw), F.lit("yyyy-M-d")).cast("date")


def temporal_status(events: DataFrame, rainfall_dates: DataFrame, reported: str = "reported_history_date", date: str = "date") -> DataFrame:
    """Every event with its year, whether there is rainfall of that year, and whether there is of that date; no date is inferred."""
    days = rainfall_dates.select(F.to_date(date).alias("_date")).filter("_date is not null").distinct().withColumn("_day", F.lit(True))
    years = days.select(F.year("_date").alias("event_year")).distinct().withColumn("_year", F.lit(True))
    rows = events.withColumn("_date", explicit_date(F.col(reported))).withColumn("event_year", F.year("_date"))
    rows = rows.join(days, "_date", "left").join(years, "event_year", "left")
    status = F.when(F.col("_date").isNull(), "EVENT_DATE_UNKNOWN").when(F.col("_day"), "RAINFALL_DATE_AVAILABLE").otherwise("RAINFALL_DATE_NOT_AVAILABLE")
    return rows.select(*events.columns, "event_year", F.coalesce("_year", F.lit(False)).alias("rainfall_year_available"), status.alias("temporal_status"))
