"""Latest values, freshness, change-only histories and transitions, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slopeworks.functions import scalar


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key; pre-aggregated before its shuffle, so a hot key costs no more than its maps' maxima."""
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def latest_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n latest rows of each key, with their position from 1."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def with_freshness(df: DataFrame, received: str, as_of: Column) -> DataFrame:
    return df.withColumn("age_s", scalar.age_seconds(F.col(received), as_of)).withColumn("freshness", scalar.freshness(F.col(received), as_of))


def changes(df: DataFrame, keys: list[str], order: list[str], signature: list[str]) -> DataFrame:
    """Rows whose signature differs from the row before of the same key, and each key's first; nulls equal each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*signature)
    before = F.lag(now).over(w)
    return df.withColumn("_before", before).withColumn("_now", now).filter(F.col("_before").isNull() | ~F.col("_now").eqNullSafe(F.col("_before"))).drop("_before", "_now")


def transitions(df: DataFrame, keys: list[str], order: list[str], state: Column, last: int = 12) -> DataFrame:
    """The last changes of a state, newest first; rows without a state are skipped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("state", state).filter(F.col("state").isNotNull()).withColumn("before", F.lag("state").over(w))
    return latest_n(rows.filter(F.col("before").isNull() | (F.col("state") != F.col("before"))), keys, order, last)


def without_tests(df: DataFrame, flag: str = "is_test") -> DataFrame:
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def record_class(village: Column, is_test: Column) -> Column:
    return F.when(is_test & village.isNull(), "BENCH").when(is_test, "TEST").otherwise("PRODUCTION")
