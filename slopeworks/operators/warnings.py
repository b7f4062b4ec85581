"""The warning cascade as one expression per output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the rules, the order of stages, and the ids and texts that results are compared by.
RULE_VERSION = "1.0.0"
HIGH, MEDIUM = 80.0, 60.0
EXTREME, HEAVY = 2.0, 1.5
VERY_WET, WET = 80.0, 60.0
STAGES = ("green", "yellow", "orange", "red")
LABELS = {"green": "Normal", "yellow": "Watch", "orange": "Prepare", "red": "Warning"}
MODES = ("current_conditions", "scenario")
RULES = {
    "extreme": "high_susceptibility_and_prepare_rainfall",
    "heavy_wet": "high_susceptibility_watch_rainfall_and_very_wet_online_sensor",
    "support": "watch_susceptibility_with_rainfall_or_online_wet_sensor",
    "single": "single_watch_signal",
    "none": "no_configured_watch_signal",
}
MISSING = {
    "score": "modeled susceptibility",
    "rainfall": "validated current rainfall",
    "multiplier": "rainfall scenario multiplier",
    "moisture": "fresh soil-moisture observation",
    "stale": "fresh soil-moisture observation (last reading is stale)",
    "offline": "fresh soil-moisture observation (sensor is offline)",
    "hydrology": "terrain-derived hydrological context",
    "coverage": "validated model and hydrology coverage",
}
REASONS = {
    "score": "High baseline modeled susceptibility",
    "rain": "Rainfall scenario %.2f× historical baseline",
    "wet": "Online soil-moisture observation %.1f%% used as supporting evidence",
    "old": "Soil-moisture last reading %.1f%% not used as current evidence (sensor %s)",
    "hydrology": "Terrain-derived hydrological context available; not a real-time water measurement",
    "none": "No configured watch signal in the available inputs",
    "unsupported": "Insufficient model/data coverage for warning evaluation.",
}

#: Columns that ``evaluate`` reads and their types; one that is not there counts as null.
INPUTS = {
    "score": "double", "multiplier": "double", "mode": "string", "moisture": "double", "freshness": "string", "is_test": "boolean", "linked_events": "bigint",
    "hydrology_status": "string", "high_flow_area_fraction": "double", "drainage_density_km_per_km2": "double", "max_contributing_area_km2": "double", "supported": "boolean",
}
_HYDROLOGY = ("high_flow_area_fraction", "drainage_density_km_per_km2", "max_contributing_area_km2")


def _at_least(c: Column, x: float) -> Column:
    return F.coalesce(c >= x, F.lit(False))


def _conditions(score: Column, multiplier: Column, moisture: Column, freshness: Column, mode: Column) -> list[tuple[str, str, Column]]:
    """(stage, rule, condition) in order; the first that holds decides."""
    rain = F.when(mode == "scenario", multiplier)
    wet = F.when(freshness == "online", moisture)
    return [
        ("red", RULES["extreme"], _at_least(score, HIGH) & _at_least(rain, EXTREME)),
        ("red", RULES["heavy_wet"], _at_least(score, HIGH) & _at_least(rain, HEAVY) & _at_least(wet, VERY_WET)),
        ("orange", RULES["support"], _at_least(score, MEDIUM) & (_at_least(rain, HEAVY) | _at_least(wet, WET))),
        ("yellow", RULES["single"], _at_least(score, MEDIUM) | _at_least(rain, HEAVY)),
    ]


def _decided(at: int, otherwise: str, inputs: dict[str, Column]) -> Column:
    found = None
    for case in _conditions(**inputs):
        found = F.when(case[2], case[at]) if found is None else found.when(case[2], case[at])
    return found.otherwise(otherwise)


def stage(score: Column, multiplier: Column, moisture: Column, freshness: Column, mode: Column) -> Column:
    return _decided(0, "green", {"score": score, "multiplier": multiplier, "moisture": moisture, "freshness": freshness, "mode": mode})


def rule(score: Column, multiplier: Column, moisture: Column, freshness: Column, mode: Column) -> Column:
    return _decided(1, RULES["none"], {"score": score, "multiplier": multiplier, "moisture": moisture, "freshness": freshness, "mode": mode})


def _factors(c: dict[str, Column], scenario: Column, online: Column) -> Column:
    """The five factors, each with its graded status, whether it is evidence of now, and whether it can raise the stage."""

    def factor(kind: str, value: Column, status: Column, data_type: Column, evidence: Column, trigger: bool) -> Column:
        parts = (F.lit(kind).alias("type"), value.alias("value"), status.alias("status"), data_type.alias("data_type"), evidence.alias("used_as_current_evidence"), F.lit(trigger).alias("used_as_stage_trigger"))
        return F.struct(*parts)

    graded = lambda x, *steps: _graded(x, steps)
    known = lambda x: x.isNotNull()
    number = lambda x: x.cast("string")
    hydrology = F.when(F.coalesce(*(c[k] for k in _HYDROLOGY)).isNotNull(), F.to_json(F.struct(*(c[k].alias(k) for k in _HYDROLOGY))))
    events = c["linked_events"]
    return F.array(
        factor("susceptibility", number(c["score"]), graded(c["score"], (MEDIUM, "high"), (None, "below_watch")), F.lit("modeled"), known(c["score"]), True),
        factor("rainfall", number(c["multiplier"]), graded(c["multiplier"], (HEAVY, "elevated"), (None, "baseline")), F.when(scenario, "simulated").otherwise("observed"), scenario & known(c["multiplier"]), True),
        factor("soil_moisture", number(c["moisture"]), graded(c["moisture"], (VERY_WET, "very_wet"), (WET, "wet"), (None, "below_wet_support")), F.when(c["is_test"], "test").otherwise("observed"), online, True),
        factor("hydrology", hydrology, F.when(c["hydrology_status"] == "available", "available").otherwise("unavailable"), F.lit("derived"), F.lit(False), False),
        factor("historical_evidence", number(events), F.when(events > 0, "linked_records").when(events == 0, "no_linked_records").otherwise("unavailable"), F.lit("historical"), F.lit(False), False),
    )


def _graded(x: Column, steps: tuple) -> Column:
    found = F.when(x.isNull(), "unavailable")
    for least, name in steps:
        found = found.otherwise(name) if least is None else found.when(x >= least, name)
    return found


def _missing(c: dict[str, Column], scenario: Column, online: Column) -> Column:
    old = F.when(c["freshness"] == "stale", MISSING["stale"]).when(c["freshness"] == "offline", MISSING["offline"]).otherwise(MISSING["moisture"])
    return F.array_compact(F.array(
        F.when(c["score"].isNull(), MISSING["score"]), F.when(~scenario, MISSING["rainfall"]).when(c["multiplier"].isNull(), MISSING["multiplier"]),
        F.when(~online, old), F.when(~F.coalesce(c["hydrology_status"] == "available", F.lit(False)), MISSING["hydrology"]),
    ))


def _reason(c: dict[str, Column], scenario: Column, online: Column) -> Column:
    moisture = c["moisture"]
    found = F.array_compact(F.array(
        F.when(_at_least(c["score"], MEDIUM), REASONS["score"]),
        F.when(scenario & c["multiplier"].isNotNull(), F.format_string(REASONS["rain"], c["multiplier"])),
        F.when(online & _at_least(moisture, WET), F.format_string(REASONS["wet"], moisture))
        .when(c["freshness"].isin("stale", "offline") & moisture.isNotNull(), F.format_string(REASONS["old"], moisture, c["freshness"])),
        F.when(c["hydrology_status"] == "available", REASONS["hydrology"]),
    ))
    return F.concat(F.array_join(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(REASONS["none"]))), "; "), F.lit("."))


def evaluate(df: DataFrame) -> DataFrame:
    """Rows with INPUTS, with what follows from them.

    A score that is null makes the status unavailable, though a stage is still given. A place that is not
    supported is unavailable and has no stage at all. Moisture alone, hydrology and linked events never raise the stage.
    """
    c = {k: (F.col(k) if k in df.columns else F.lit(None)).cast(t) for k, t in INPUTS.items()}
    for k, t in INPUTS.items():
        if t == "double":
            c[k] = F.when(~F.isnan(c[k]) & (F.abs(c[k]) != float("inf")), c[k])
    supported = F.coalesce(c["supported"], F.lit(True))
    scenario = F.coalesce(c["mode"] == "scenario", F.lit(False))
    online = F.coalesce(c["freshness"] == "online", F.lit(False)) & c["moisture"].isNotNull()
    inputs = {k: c[k] for k in ("score", "multiplier", "moisture", "freshness", "mode")}
    only = lambda x: F.when(supported, x)
    return df.withColumns({
        "stage": only(stage(**inputs)), "rule_id": only(rule(**inputs)), "rule_version": only(F.lit(RULE_VERSION)),
        "status": F.when(c["score"].isNull() | ~supported, "unavailable").otherwise("available"),
        "rainfall_mode": F.when(scenario, MODES[1]).otherwise(MODES[0]), "rainfall_scenario_multiplier": F.when(scenario, c["multiplier"]),
        "sensor_status": c["freshness"], "soil_moisture_band": only(F.when(online, _graded(c["moisture"], ((VERY_WET, "very_wet"), (WET, "wet"), (None, "below_wet_support"))))),
        "factors": only(_factors(c, scenario, online)),
        "missing_inputs": F.when(supported, _missing(c, scenario, online)).otherwise(F.array(F.lit(MISSING["coverage"]))),
        "reason": F.when(supported, _reason(c, scenario, online)).otherwise(F.lit(REASONS["unsupported"])),
    })


#: What makes two evaluations of a place materially the same.
SIGNATURE = ("stage", "rule_version", "rainfall_mode", "rainfall_scenario_multiplier", "rule_id", "sensor_status", "soil_moisture_band", "is_test")


def signature() -> Column:
    """SIGNATURE of an evaluated row as one text, for the change-only history."""
    return F.to_json(F.struct(*SIGNATURE), {"ignoreNullFields": "false"})


def counts(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """How many rows have each value of a domain, with zeros."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in domain], f"{column} string")
    found = df.groupBy(column).agg(F.count("*").alias("n"))
    return wanted.join(found, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def highest(df: DataFrame, column: str = "stage") -> DataFrame:
    """The highest stage that occurs, and how often."""
    rank = F.array_position(F.array(*(F.lit(s) for s in STAGES)), F.col(column))
    by = df.groupBy(column).agg(F.count("*").alias("n")).withColumn("rank", rank)
    return by.agg(F.max_by(F.struct(column, "n"), "rank").alias("x")).select("x.*")
