"""Joins with a stated cardinality: nothing is dropped or filled in silently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.runtime import settled


class CardinalityError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def enforce(violations: DataFrame, message: str, shown: int = 20) -> None:
    """Raises with the first offenders if there are any."""
    rows = violations.limit(shown).collect()
    if rows:
        raise CardinalityError(f"{message}: {', '.join(str(tuple(r)) for r in rows)}")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], require_match: bool = True) -> DataFrame:
    """Left join that fails on duplicate right keys and, if required, on left keys without a match; one job checks both."""
    found = duplicate_keys(right, keys).select(F.lit("duplicate keys on the right side").alias("fault"), *keys)
    if require_match:
        found = found.unionByName(unmatched(left, right, keys).select(F.lit("unmatched keys").alias("fault"), *keys))
    enforce(found.orderBy("fault", *keys), "the join's keys are at fault")
    return left.join(right, keys, "left")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    enforce(duplicate_keys(left, keys), "duplicate keys on the left side")
    return many_to_one(left, right, keys)


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on the left, matched, left only, and right only."""
    l = left.select(F.col(key).alias("k")).distinct().withColumn("l", F.lit(1))  # noqa: E741
    r = right.select(F.col(key).alias("k")).distinct().withColumn("r", F.lit(1))
    return l.join(r, "k", "full_outer").agg(
        F.count("l").alias("n_left"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_matched"),
        F.count_if(F.col("r").isNull()).alias("n_left_only"), F.count_if(F.col("l").isNull()).alias("n_right_only"),
    )


def coverage_report(left: DataFrame, right: DataFrame, key: str, features: list[str], shown: int = 1000) -> DataFrame:
    """One row: counts of both sides' keys, the sorted keys that the right side lacks and those it has besides, and keys with a null feature.

    Each list holds at most ``shown`` keys, the smallest ones; the counts are of all.
    """
    l = left.select(F.col(key).alias("k")).distinct().withColumn("l", F.lit(1))  # noqa: E741
    null = F.greatest(*(F.col(c).isNull() for c in features), F.lit(False))
    r = right.select(F.col(key).alias("k"), null.alias("r")).groupBy("k").agg(F.max("r").alias("r"))
    rows = l.join(r, "k", "full_outer")
    kinds = {"unmatched": F.col("r").isNull(), "right_only": F.col("l").isNull(), "null_features": F.col("l").isNotNull() & F.col("r")}
    out = rows.agg(F.count("l").alias("n_population"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_matched"), *(F.count_if(c).alias(f"n_{k}") for k, c in kinds.items()))
    for kind, holds in kinds.items():
        least = rows.filter(holds).select("k").orderBy("k").limit(shown).agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias(kind))
        out = out.crossJoin(F.broadcast(least))
    return out


def require_coverage(left: DataFrame, right: DataFrame, key: str, features: list[str]) -> DataFrame:
    """The one-to-one join, refused with the keys that lack a row or a feature; nothing is dropped or filled in."""
    joined = settled(one_to_one(left, right.select(key, *features), [key]))
    enforce(joined.filter(F.greatest(*(F.col(c).isNull() for c in features), F.lit(False))).select(key).orderBy(key), "features are null")
    return joined


def lookup(left: DataFrame, right: DataFrame, keys: list[str], value: str, default: object) -> DataFrame:
    """Left join on unique keys of one value, with a default where there is none."""
    return left.join(right.select(*keys, value), keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def identity_differences(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one side that the other lacks, with the side."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def regression_differences(new: DataFrame, old: DataFrame, keys: list[str], numbers: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Keys on one side only, or with a number that differs by more than the tolerance; nulls and NaN equal each other."""
    a, b = new.select(*keys, *numbers, F.lit(True).alias("_a")), old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in numbers), F.lit(True).alias("_b"))
    differs = F.col("_a").isNull() | F.col("_b").isNull()
    for c in numbers:
        x, y = F.nanvl(F.col(c).cast("double"), F.lit(None)), F.nanvl(F.col(f"_old_{c}").cast("double"), F.lit(None))
        differs = differs | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
    return a.join(b, keys, "full_outer").filter(differs).select(*keys)
