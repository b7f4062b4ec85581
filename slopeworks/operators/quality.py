"""Data-quality rules: each gives its violations; ``enforce`` raises at a boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.functions.scalar import blank_to_null, coordinate_status, finite
from slopeworks.operators.joins import duplicate_keys, enforce

__all__ = ["Rule", "check", "duplicate_keys", "enforce", "enforce_rules", "outside", "profile", "report"]


class Rule:
    """A name and the condition that a good row meets; null counts as not met."""

    def __init__(self, name: str, good: Column):
        self.name, self.bad = name, ~F.coalesce(good, F.lit(False))


def not_blank(column: str) -> Rule:
    c = F.col(column).cast("string")
    return Rule(f"{column}_not_blank", blank_to_null(c).isNotNull() & (c == F.trim(c)))


def is_finite(column: str) -> Rule:
    return Rule(f"{column}_finite", finite(F.col(column)).isNotNull())


def in_range(column: str, low: float, high: float) -> Rule:
    return Rule(f"{column}_in_range", finite(F.col(column)).between(low, high))


def null_or_finite(column: str) -> Rule:
    return Rule(f"{column}_null_or_finite", F.col(column).isNull() | finite(F.col(column)).isNotNull())


def one_of(column: str, values: list[str]) -> Rule:
    return Rule(f"{column}_known", F.col(column).isin(values))


def settlement_rules() -> list[Rule]:
    return [not_blank("settlement_id"), not_blank("settlement_name"), in_range("latitude", -90, 90), in_range("longitude", -180, 180)]


def terrain_rules() -> list[Rule]:
    return [is_finite("elevation_m"), in_range("slope_deg", 0, 90)]


def rainfall_rules() -> list[Rule]:
    """The sums over days may be null, but not infinite."""
    return [Rule("date_valid", F.col("date").isNotNull()), is_finite("rainfall_1d_mm"), null_or_finite("rainfall_3d_mm"), null_or_finite("rainfall_7d_mm")]


def outside(column: Column, low: float, high: float) -> Column:
    """Not between, with null and NaN outside."""
    return ~F.coalesce(column.between(low, high) & ~F.isnan(column.cast("double")), F.lit(False))


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that break a rule, with the names of all they break."""
    broken = F.array_compact(F.array(*(F.when(r.bad, F.lit(r.name)) for r in rules)))
    return df.withColumn("violations", broken).filter(F.size("violations") > 0)


def report(df: DataFrame, rules: list[Rule], unique: list[list[str]] | None = None) -> DataFrame:
    """(rule, n_violations), in one pass over the table but for the uniqueness rules."""
    counts = df.agg(*(F.count_if(r.bad).alias(r.name) for r in rules))
    out = counts.select(F.explode(F.map_from_arrays(F.array(*(F.lit(r.name) for r in rules)), F.array(*(F.col(r.name) for r in rules)))).alias("rule", "n_violations"))
    for keys in unique or []:
        again = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_violations"))
        out = out.unionByName(again.select(F.lit("unique_" + "_".join(keys)).alias("rule"), "n_violations"))
    return out


def enforce_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    enforce(check(df, rules).select("violations"), "rows break rules")
    return df


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_null, n_distinct, least, greatest) as text, in one pass."""
    stats = [
        F.struct(
            F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(c).alias("n_distinct"),
            F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest"),
        )
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("x")).select(F.inline("x"))


def constant_within(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys within which the columns are not constant; nulls count as a value."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*columns)).alias("n_values")).filter("n_values > 1")


def expected_count(df: DataFrame, n: int) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") != n)


VERIFICATION = ("verified", "unverified", "needs_review")
OPERATIONAL = ("operational", "not_operational", "unknown")


def shelter_coverage(shelters: DataFrame) -> DataFrame:
    """One row: shelters, those a route may lead to, those of each verification status, and the newest date they were updated."""
    counts = [F.count_if(F.col("verification_status") == s).alias(s) for s in VERIFICATION]
    newest = [F.max(blank_to_null(F.col("last_updated"))).alias("last_updated")] if "last_updated" in shelters.columns else []
    out = shelters.agg(F.count("*").alias("total_records"), F.count_if("operational").alias("route_eligible_records"), *counts, *newest)
    return out.withColumn("source_coverage", F.when(F.col("verified") > 0, "authoritative").otherwise("no_verified_shelter_records"))


def district(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of the districts, whose names are matched trimmed and in any case; an error if there is none."""
    kept = rows.filter(F.lower(F.trim(column)).isin([n.strip().lower() for n in names]))
    if kept.isEmpty():
        raise ValueError(f"no row of {names}")
    return kept


def duplicate_count(rows: DataFrame, column: str, skip_blank: bool = False) -> DataFrame:
    """One row: how many rows repeat an earlier value; null is a value, a blank one is left out if asked."""
    c = F.col(column).cast("string")
    rows = rows.filter(blank_to_null(c).isNotNull()) if skip_blank else rows
    return rows.groupBy(column).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def event_profile(rows: DataFrame, lat: str, lon: str, slide: str, extent: tuple[float, float, float, float]) -> DataFrame:
    """One row: events, missing and out-of-range coordinates (no value and NaN are out of range), repeated numbers."""
    south, west, north, east = extent
    n = rows.agg(
        F.count("*").alias("n_events"), F.count_if(finite(F.col(lat)).isNull() | finite(F.col(lon)).isNull()).alias("n_no_coordinate"),
        F.count_if(outside(F.col(lat), south, north) | outside(F.col(lon), west, east)).alias("n_out_of_range"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"),
    )
    return n.crossJoin(F.broadcast(duplicate_count(rows, slide, skip_blank=True)))


def index_faults(rows: DataFrame, normalised: list[str], index: str, parts: tuple[str, str, str], weights: tuple[float, float, float] = (0.35, 0.40, 0.25), tolerance: float = 1e-12) -> DataFrame:
    """Rows of a composite index that break its gate: a value that is not finite, a part outside 0..1, an index outside 0..100 or not the formula's."""
    columns = [*normalised, index]
    formula = 100.0 * (weights[0] * F.col(parts[0]) + weights[1] * F.col(parts[1]) + weights[2] * F.col(parts[2]))
    fault = F.when(F.greatest(*(finite(F.col(c)).isNull() for c in columns)), "not_finite")
    fault = fault.when(F.greatest(*(~F.col(c).between(0, 1) for c in normalised), F.lit(False)), "part_out_of_range").when(~F.col(index).between(0, 100), "index_out_of_range")
    return rows.withColumn("fault", fault.when(F.abs(F.col(index) - formula) > tolerance, "formula")).filter("fault is not null")


def incompatible_tiles(tiles: DataFrame, order: str, attributes: list[str]) -> DataFrame:
    """Tiles that differ from the first one in an attribute, with the attributes' names; nulls equal each other."""
    first = tiles.select(F.min_by(F.struct(*attributes), order).alias("_first"))
    named = F.array_compact(F.array(*(F.when(~F.col(a).eqNullSafe(F.col(f"_first.{a}")), F.lit(a)) for a in attributes)))
    return tiles.crossJoin(F.broadcast(first)).withColumn("differs", F.array_join(named, ",")).drop("_first").filter("differs <> ''")


def outside_axes(points: DataFrame, grid: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Points outside of the extent of a grid's axes (lat, lon), with the axis, before any nearest cell is chosen."""
    ends = grid.agg(F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min("lon").alias("_w"), F.max("lon").alias("_e"))
    joined = points.crossJoin(F.broadcast(ends))
    axis = F.when(outside(F.col(lat), F.col("_s"), F.col("_n")), "latitude").when(outside(F.col(lon), F.col("_w"), F.col("_e")), "longitude")
    return joined.withColumn("axis", axis).filter("axis is not null").drop("_s", "_n", "_w", "_e")


def raster_covers(raster: DataFrame, wanted: DataFrame, cells: DataFrame, least: int = 100) -> DataFrame:
    """One row: whether a raster's extent (west, south, east, north) holds the wanted one, its valid cells, and whether both suffice."""
    n = cells.agg(F.count_if(F.coalesce(~F.isnan(F.col("z").cast("double")), F.lit(False))).alias("n_valid"))
    both = raster.select(*(F.col(c).alias(f"r_{c}") for c in ("west", "south", "east", "north"))).crossJoin(F.broadcast(wanted)).crossJoin(F.broadcast(n))
    covers = (F.col("r_west") <= F.col("west")) & (F.col("r_south") <= F.col("south")) & (F.col("r_east") >= F.col("east")) & (F.col("r_north") >= F.col("north"))
    return both.select(covers.alias("covers"), "n_valid", (covers & (F.col("n_valid") >= least)).alias("accepted"))


def all_reached(cells: DataFrame, accumulated: DataFrame) -> DataFrame:
    """One row: valid cells, cells that the flow order reached, and whether these are as many (they are fewer if there is a cycle)."""
    valid = cells.filter(F.coalesce(~F.isnan(F.col("z").cast("double")), F.lit(False))).agg(F.count("*").alias("n_valid"))
    return valid.crossJoin(F.broadcast(accumulated.agg(F.count("*").alias("n_processed")))).withColumn("complete", F.col("n_valid") == F.col("n_processed"))


def shelters(rows: DataFrame, villages: DataFrame, extent: tuple[float, float, float, float] | None) -> DataFrame:
    """Shelter rows (all text) checked and typed; fails on a missing or repeated id, an unknown status or text that is no number.

    A verified shelter without source, date, or a coordinate within the extent (south, west, north, east) is one to review.
    """
    text = {c: blank_to_null(F.col(c)) for c in rows.columns}
    status = {"verification_status": "needs_review", "operational_status": "unknown"}
    r = rows.select(*(F.lower(F.coalesce(c, F.lit(status[n]))).alias(n) if n in status else c.alias(n) for n, c in text.items()))
    no_number = lambda c, kind: F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()
    bad = (
        F.when(F.col("shelter_id").isNull(), "id_missing").when(~F.col("verification_status").isin(*VERIFICATION), "verification_status")
        .when(~F.col("operational_status").isin(*OPERATIONAL), "operational_status")
        .when(no_number("latitude", "double") | no_number("longitude", "double") | no_number("capacity", "int"), "no_number")
    )
    enforce(r.select("shelter_id", bad.alias("reason")).filter("reason is not null"), "shelters break a rule")
    enforce(duplicate_keys(r, ["shelter_id"]), "shelters share an id")
    place = coordinate_status(F.col("latitude"), F.col("longitude"), extent) if extent else F.lit("needs_review")
    sure = F.col("source").isNotNull() & F.col("verified_at").isNotNull() & (place == "valid")
    r = r.withColumn("coordinate_status", place).withColumn("verification_status", F.when((F.col("verification_status") == "verified") & ~sure, "needs_review").otherwise(F.col("verification_status")))
    r = r.withColumns({"latitude": F.col("latitude").cast("double"), "longitude": F.col("longitude").cast("double"), "capacity": F.col("capacity").cast("int")})
    r = r.withColumn("operational", (F.col("verification_status") == "verified") & (F.col("operational_status") == "operational"))
    named = villages.select("village_lgd_code", F.col("village_name_en").alias("village"), F.col("taluk_name_en").alias("_taluk"))
    return r.join(named, "village_lgd_code", "left").withColumn("taluk", F.coalesce("taluk", "_taluk")).drop("_taluk")
