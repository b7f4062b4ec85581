"""Scalar functions of the hazard domain as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def finite(c: Column) -> Column:
    """A number that is neither null, NaN nor infinite; otherwise null. Text that is no number is null too."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def rint_at(c: Column, places: int) -> Column:
    """Rounding half to even of the scaled value, as numpy does."""
    return F.rint(c * F.lit(float(10**places))) / F.lit(float(10**places))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def canonical_code(c: Column) -> Column:
    """Integral non-negative numeric text as an integer in text (587.0 is 587); null for anything else."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when((x >= 0) & (x == F.floor(x)), x.cast("bigint").cast("string"))


def tier(score: Column, high: float = 60.0, medium: float = 30.0) -> Column:
    return F.when(score.isNull(), None).when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def moisture_band(percent: Column) -> Column:
    return F.when(percent.isNull(), None).when(percent >= 80, "very_wet").when(percent >= 60, "wet").otherwise("below")


def moisture_alert(percent: Column, freshness: Column | None = None) -> Column:
    """normal, elevated or high for a valid percentage, only while the sensor is online."""
    x = percent.cast("double")
    valid = F.coalesce(x.between(0, 100) & ~F.isnan(x), F.lit(False))
    if freshness is not None:
        valid = valid & F.coalesce(freshness == "online", F.lit(False))
    return F.when(valid, F.when(x < 60, "normal").when(x < 80, "elevated").otherwise("high"))


def device_moisture(raw: Column, dry: int = 4095, wet: int = 2082) -> Column:
    """The percentage of a raw reading between its dry and wet calibration, clamped."""
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (F.lit(dry) - raw) / F.lit(dry - wet))))


def device_reading(samples: Column, dry: int = 4095, wet: int = 2082) -> Column:
    """The calibrated percentage of the mean of a reading's samples (an array), in whole units as the device has them."""
    total = F.aggregate(samples, F.lit(0).cast("long"), lambda t, x: t + x.cast("long"))
    return F.when(F.size(samples) > 0, device_moisture(F.floor(total / F.size(samples)), dry, wet))


def device_status(percent: Column) -> Column:
    return F.when(percent < 30, "DRY").when(percent < 70, "NORMAL").otherwise("WET")


def age_seconds(received: Column, now: Column) -> Column:
    """Whole seconds since the arrival, 0 for one ahead of the clock; null without an arrival."""
    return F.when(received.isNotNull(), F.greatest(F.lit(0).cast("long"), F.timestamp_diff("SECOND", received, now)))


def freshness(received: Column, now: Column, online: int = 600, stale: int = 1800) -> Column:
    age = age_seconds(received, now)
    return F.when(received.isNull(), "no_data").when(age <= online, "online").when(age <= stale, "stale").otherwise("offline")


def utc_timestamp(c: Column) -> Column:
    """ISO text with or without Z as a timestamp; without a zone it is UTC (the session's zone has to be UTC)."""
    return F.try_to_timestamp(c)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.when(a > 1, F.lit(1.0)).otherwise(F.sqrt(a)))  # not least(), which passes over a null


def history_category(raw: Column, parsed: Column) -> Column:
    """na, explicit_date, year_only or ambiguous, for the raw text of an event's date and its strict parse."""
    return F.when(raw == "NA", "na").when(F.coalesce(parsed, F.lit("")) != "", "explicit_date").when(raw.rlike(r"^\d{4}$"), "year_only").otherwise("ambiguous")


def history_category_served(raw: Column, reported: Column) -> Column:
    """The variant of the serving side: names differ, any digits are a year, and NA is matched in any case."""
    return F.when(F.coalesce(reported, F.lit("")) != "", "explicit").when(raw.rlike(r"^\d+$"), "year_only").when(F.upper(raw) == "NA", "na").otherwise("ambiguous")


_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_DAY_FIRST = rf"(?i)^\s*(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTHS})\s+(\d{{4}})(?:\s+at\b.*)?\s*$"


def strict_date(raw: Column) -> Column:
    """ISO text as it is (its shape only), or day, month name and year as ISO text; "" for all else, as for days that do not exist."""
    text = F.trim(raw)
    day, month, year = (F.regexp_extract(text, _DAY_FIRST, k) for k in (1, 2, 3))
    parsed = F.try_to_date(F.concat_ws(" ", F.lpad(day, 2, "0"), F.initcap(month), year), "dd MMMM yyyy")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.lit("")))


def fixed_width(line: Column, start: int, width: int) -> Column:
    return F.trim(F.substring(line, start + 1, width))


def join_fragments(parts: Column) -> Column:
    """Wrapped fragments of one cell: no blank after a hyphen, or between a lone lower-case letter and a lower-case start."""
    glued = lambda a, p: a.endswith("-") | (a.rlike(r"(^|\s)[a-z]$") & p.rlike("^[a-z]"))
    return F.aggregate(parts, F.lit(""), lambda a, p: F.when(a == "", p).when(p == "", a).when(glued(a, p), F.concat(a, p)).otherwise(F.concat(a, F.lit(" "), p)))


def last_coordinates(text: Column) -> Column:
    """The last pair of decimal numbers in a text, as a struct of latitude and longitude."""
    pattern = r"(\d{1,3}\.\d+)\s+(\d{1,3}\.\d+)"
    lat, lon = (F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)), F.lit(-1)) for k in (1, 2))
    return F.struct(lat.try_cast("double").alias("latitude"), lon.try_cast("double").alias("longitude"))


def split_wide(text: Column) -> Column:
    """Three parts at runs of two or more blanks, or null if there are not exactly three."""
    parts = F.split(text, r"\s{2,}", 3)
    return F.when(F.size(parts) == 3, parts)


def elapsed_text(seconds: Column) -> Column:
    unit = lambda n, word: F.concat(F.floor(seconds / n).cast("string"), F.lit(f" {word} ago"))
    return F.when(seconds < 60, unit(1, "sec")).when(seconds < 3600, unit(60, "min")).when(seconds < 86400, unit(3600, "hr")).otherwise(unit(86400, "days"))


def merged_lines(lines: Column, start: int, width: int) -> Column:
    """One cell's slices of several fixed-width lines, blanks left out, joined by one blank."""
    parts = F.filter(F.transform(lines, lambda line: collapse_spaces(fixed_width(line, start, width))), lambda p: p != "")
    return F.array_join(parts, " ")


def delta_class(delta: Column) -> Column:
    return F.when(delta.isNull(), None).when(F.abs(delta) < 0.05, "zero").when(delta > 0, "up").otherwise("down")


def delta_text(delta: Column) -> Column:
    return F.when(F.abs(delta) < 0.05, "0.0").when(delta > 0, F.concat(F.lit("+"), F.format_string("%.1f", delta))).otherwise(F.format_string("%.1f", delta))


#: Ranges of weather codes and their labels (fixed values).
WEATHER = ((0, 0, "Clear"), (1, 3, "Cloudy"), (45, 48, "Fog"), (51, 57, "Drizzle"), (61, 67, "Rain"), (71, 77, "Snow"), (80, 82, "Showers"), (95, 99, "Thunderstorm"))


def weather_label(code: Column) -> Column:
    return reduce(lambda c, x: c.when(code.between(x[0], x[1]), x[2]), WEATHER, F.when(code.isNull(), None)).otherwise("Unknown")


#: Presets of the rainfall scenario and their factors (fixed values).
PRESETS = {"moderate": 0.7, "baseline": 1.0, "heavy": 1.5, "extreme": 2.2}


def preset_name(factor: Column) -> Column:
    return reduce(lambda c, x: c.when(F.abs(factor - x[1]) < 0.05, x[0]), PRESETS.items(), F.when(factor.isNull(), None)).otherwise("custom")


def chosen_score(scenario: Column, baseline: Column, model: Column) -> Column:
    """The scenario's score, else the baseline's, else the model's; an empty text counts as none."""
    text = [F.nullif(c.cast("string"), F.lit("")).try_cast("double") for c in (scenario, baseline, model)]
    return F.coalesce(*text)


def coordinate_status(lat: Column, lon: Column, extent: tuple[float, float, float, float]) -> Column:
    """missing, invalid, needs_review (0, 0), valid, or outside_study_extent (south, west, north, east)."""
    south, west, north, east = extent
    y, x = finite(lat), finite(lon)
    missing = blank_to_null(lat.cast("string")).isNull() | blank_to_null(lon.cast("string")).isNull()
    wrong = y.isNull() | x.isNull() | ~y.between(-90, 90) | ~x.between(-180, 180)
    return (
        F.when(missing, "missing").when(wrong, "invalid").when((y == 0) & (x == 0), "needs_review")
        .when(y.between(south, north) & x.between(west, east), "valid").otherwise("outside_study_extent")
    )


def year_days(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def snap(c: Column, step: float) -> Column:
    """The nearest multiple of a step, ties to the larger."""
    return F.floor(c / step + 0.5) * step


def route_valid(coords: Column, distance: Column, start_gap_m: Column, end_gap_m: Column) -> Column:
    """At least two points in range, a positive length, and both ends within 50 m of what was asked."""
    inside = lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90)
    return F.coalesce((F.size(coords) >= 2) & F.forall(coords, inside) & (distance > 0) & (start_gap_m <= 50) & (end_gap_m <= 50), F.lit(False))
