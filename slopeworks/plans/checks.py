"""Registered queries of joins with a stated cardinality, quality rules, shelters, sources and sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.functions import scalar as S
from slopeworks.operators import catalog, geometry, joins, serving, state, timeseries, warnings
from slopeworks.operators import quality as Q
from slopeworks.plans.hazard import _GRID, _INDEX, _cells, _climatology, _flow, _readings, _sensors, query
from slopeworks.runtime import shared_folder, table
from slopeworks.sources import readers, sinks
from slopeworks.streaming import sensors

# --- joins ---------------------------------------------------------------------------------------


@query("select s_suppkey, s_name, n_lines, round(quantity, 4) as quantity from supplier join (select l_suppkey, count(*) as n_lines, sum(l_quantity) as quantity from lineitem group by 1) on l_suppkey = s_suppkey where s_suppkey in (select l_suppkey from lineitem)")
def one_to_one_join(spark, sf_dir):
    totals = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    suppliers = table(spark, sf_dir, "supplier").join(totals.select("s_suppkey"), "s_suppkey", "left_semi")
    return joins.one_to_one(suppliers, totals, ["s_suppkey"]).select("s_suppkey", "s_name", "n_lines", F.round("quantity", 4).alias("quantity"))


@query("""with l as (select distinct c_custkey as k from customer where c_custkey % 3 <> 0), r as (select c_custkey as k, bool_or(c_custkey % 10 = 0) as nul from customer where c_custkey % 2 = 0 group by 1), j as (select l.k as a, r.k as b, nul from l full join r on l.k = r.k)
select count(a) as n_population, count(*) filter (a is not null and b is not null) as n_matched, count(*) filter (b is null) as n_unmatched, count(*) filter (a is null) as n_right_only, count(*) filter (a is not null and nul) as n_null_features,
(select string_agg(cast(a as varchar), ',' order by a) from (select a from j where b is null order by a limit 20)) as unmatched, (select string_agg(cast(b as varchar), ',' order by b) from (select b from j where a is null order by b limit 20)) as right_only, (select string_agg(cast(a as varchar), ',' order by a) from (select a from j where nul and a is not null order by a limit 20)) as null_features from j""")
def coverage_report(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    right = c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("x"))
    return joins.coverage_report(c.filter("c_custkey % 3 <> 0"), right, "c_custkey", ["x"], 20)


@query("select p_partkey, round(p_retailprice * 2, 4) as doubled, round(p_retailprice, 4) as p_retailprice from part where p_partkey % 2 = 0")
def covered_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    doubled = part.select("p_partkey", (F.col("p_retailprice") * 2).alias("doubled"))
    rows = joins.require_coverage(part.filter("p_partkey % 2 = 0").select("p_partkey", "p_retailprice"), doubled, "p_partkey", ["doubled"])
    return rows.select("p_partkey", *(F.round(c, 4).alias(c) for c in ("doubled", "p_retailprice")))


@query("select 'changed' as kind, p_partkey from part where p_partkey % 50 = 1 union all select 'gone', p_partkey from part where p_partkey % 50 = 2 union all select 'new', p_partkey from part where p_partkey % 50 = 3")
def regression_gate(spark, sf_dir):
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    old = part.filter(k % 50 != 3).withColumn("p_retailprice", F.when(k % 50 == 4, F.lit(float("nan"))).otherwise(F.col("p_retailprice")))
    new = part.filter(k % 50 != 2).withColumn("p_retailprice", F.when(k % 50 == 1, F.col("p_retailprice") + 1e-6).when(k % 50 == 4, None).when(k % 50 == 5, F.col("p_retailprice") * (1 + 1e-17)).otherwise(F.col("p_retailprice")))
    rows = joins.regression_differences(new, old, ["p_partkey"], ["p_retailprice"])
    return rows.select(F.when(k % 50 == 1, "changed").when(k % 50 == 2, "gone").otherwise("new").alias("kind"), "p_partkey")


@query("select u.user_id, c_name, event_id from (select user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) as event_id from events group by 1) u join customer on c_custkey = u.user_id")
def latest_with_name(spark, sf_dir):
    last = state.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return last.join(names, "user_id").select("user_id", "c_name", "event_id")


# --- quality -------------------------------------------------------------------------------------


@query("""with c as (select *, c_custkey % 10 as k from customer)
select 'settlement_id_not_blank' as rule, count(*) filter (k = 1) as n_violations from c union all select 'settlement_name_not_blank', count(*) filter (k = 2) from c union all select 'latitude_in_range', count(*) filter (k in (3, 4)) from c
union all select 'longitude_in_range', count(*) filter (k = 5) from c union all select 'unique_settlement_id', count(*) - count(distinct case when k = 1 then ' ' when k = 6 then 'same' else cast(c_custkey as varchar) end) from c""")
def settlement_checks(spark, sf_dir):
    k = F.col("c_custkey") % 10
    rows = table(spark, sf_dir, "customer").select(
        F.when(k == 1, " ").when(k == 6, "same").otherwise(F.col("c_custkey").cast("string")).alias("settlement_id"), F.when(k == 2, " padded").otherwise(F.col("c_name")).alias("settlement_name"),
        F.when(k == 3, 90.5).when(k == 4, float("nan")).otherwise(11.0).alias("latitude"), F.when(k == 5, "east").otherwise("76.5").alias("longitude"),
    )
    return Q.report(rows, Q.settlement_rules(), [["settlement_id"]])


@query("""with p as (select *, p_partkey % 12 as k from part)
select p_partkey, concat_ws(',', case when k = 1 then 'elevation_m_finite' end, case when k in (2, 3) then 'slope_deg_in_range' end, case when k = 4 then 'date_valid' end, case when k in (5, 6) then 'rainfall_1d_mm_finite' end, case when k = 7 then 'rainfall_3d_mm_null_or_finite' end) as violations from p where k between 1 and 7""")
def feature_checks(spark, sf_dir):
    k, inf = F.col("p_partkey") % 12, float("inf")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k == 1, inf).otherwise(900.0).alias("elevation_m"), F.when(k == 2, -0.1).when(k == 3, 90.1).otherwise(45.0).alias("slope_deg"), F.when(k != 4, F.lit("2024-01-01").cast("date")).alias("date"),
        F.when(k == 5, inf).when(k != 6, 1.5).alias("rainfall_1d_mm"), F.when(k == 7, inf).when(k != 8, 3.0).alias("rainfall_3d_mm"), F.lit(None).cast("double").alias("rainfall_7d_mm"),
    )
    return Q.check(rows, Q.terrain_rules() + Q.rainfall_rules()).select("p_partkey", F.array_join("violations", ",").alias("violations"))


@query("""with o as (select o_orderkey % 11 as k, o_orderkey, o_custkey from orders) select count(*) as n_events, count(*) filter (k in (1, 2)) as n_no_coordinate, count(*) filter (k in (1, 2, 3)) as n_out_of_range, 11.0::double as lat_min, 'NaN'::double as lat_max,
(select count(*) - count(distinct o_custkey) from orders where o_orderkey % 11 <> 4) as n_duplicates from o""")
def event_profile(spark, sf_dir):
    k = F.col("o_orderkey") % 11
    rows = table(spark, sf_dir, "orders").select(F.when(k == 1, F.lit(float("nan"))).when(k != 2, 11.0).alias("lat"), F.when(k == 3, 99.0).otherwise(76.5).alias("lon"), F.when(k == 4, " ").otherwise(F.col("o_custkey").cast("string")).alias("slide_no"))
    return Q.event_profile(rows, "lat", "lon", "slide_no", (10.0, 76.0, 12.0, 77.0))


@query("select 15000 as wanted, (select count(*) from orders) as n_rows where (select count(*) from orders) <> 15000 union all select 7, (select count(*) from region)")
def expected_counts(spark, sf_dir):
    count = lambda name, n: Q.expected_count(table(spark, sf_dir, name), n).select(F.lit(n).alias("wanted"), "n_rows")
    return count("orders", 15000).unionByName(count("region", 7))


@query("""with d as (select o_custkey % 3 as place, cast(o_orderdate as date) as day, o_orderkey % 17 = 0 as hole from orders), c as (select place, day, bool_or(hole) as hole, min(day) over () as z from d group by place, day),
w as (select place, day, year(day) as y, hole, case when count(*) filter (not hole) over (partition by place, year(day) order by day rows 2 preceding) = 3 then 1 end as s3, case when count(*) filter (not hole) over (partition by place, year(day) order by day rows 6 preceding) = 7 then 1 end as s7 from c)
select place, cast(y as int) as year, count(*) as n_rows, count(distinct day) as n_days, count(*) filter (hole) as n_null_1d, count(*) filter (s3 is null) as n_null_3d, count(*) filter (s7 is null) as n_null_7d, dayofyear(make_date(y, 12, 31)) - count(distinct day) as n_missing,
 count(*) = dayofyear(make_date(y, 12, 31)) and count(*) filter (hole) = 0 and count(*) filter (s3 is null) = 2 and count(*) filter (s7 is null) = 6 as complete from w group by place, y""")
def rolling_audit(spark, sf_dir):
    """Sums start afresh in each source year."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("place"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 17 == 0).alias("hole"))
    days = o.groupBy("place", "day").agg(F.max("hole").alias("hole")).withColumns({"source_year": F.year("day"), "mm": F.when(~F.col("hole"), 1.5)})
    sums = timeseries.antecedent(days, ["place", "source_year"], "day", "mm")
    return timeseries.rolling_audit(sums, ["place"], "day", "mm", "sum_3d", "sum_7d")


@query(f"with {_INDEX}, n as (select idx.user_id, (terrain - t0) / (t1 - t0) as t, score from idx join raw using (user_id), ends) select user_id, case when user_id % 5 = 0 then 'not_finite' when user_id % 5 = 1 then 'part_out_of_range' when user_id % 5 = 2 then 'index_out_of_range' else 'formula' end as fault from n where user_id % 5 < 4")
def index_gate(spark, sf_dir):
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n_errors"))
    raw = joins.lookup(_climatology(spark, sf_dir), errors, ["user_id"], "n_errors", 0)
    raw = raw.select("user_id", F.col("max_1d").alias("t"), F.coalesce("p95_7d", "p95_3d", F.lit(0.0)).alias("r"), F.log1p("n_errors").alias("h"))
    n = timeseries.min_max(raw, ["t", "r", "h"])
    k, parts = F.col("user_id") % 5, ("t_norm", "r_norm", "h_norm")
    rows = n.withColumn("index", timeseries.composite_index(*(F.col(c) for c in parts)))
    rows = rows.withColumns({"t_norm": F.when(k == 0, F.lit(float("nan"))).when(k == 1, 1.5).otherwise(F.col("t_norm")), "index": F.when(k == 2, 100.5).when(k == 3, F.col("index") / 2 + 1e-9).otherwise(F.col("index"))})
    return Q.index_faults(rows, list(parts), "index", parts).select("user_id", "fault")


@query("""with p as (select p_partkey, case when p_partkey % 40 = 7 then 'EPSG:32643' else 'EPSG:4326' end as crs, case when p_partkey % 40 = 9 then null else -32768 end as nodata from part)
select p_partkey, case when crs <> 'EPSG:4326' then 'crs' else 'nodata' end as differs from p where crs <> 'EPSG:4326' or nodata is null""")
def tile_gate(spark, sf_dir):
    k = F.col("p_partkey") % 40
    tiles = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 7, "EPSG:32643").otherwise("EPSG:4326").alias("crs"), F.lit(1).alias("bands"), F.when(k != 9, -32768).alias("nodata"))
    return Q.incompatible_tiles(tiles, "p_partkey", ["crs", "bands", "nodata"]).select("p_partkey", "differs")


@query("select c_custkey, case when c_custkey % 30 > 24 then 'latitude' else 'longitude' end as axis from customer where c_custkey % 30 > 24 or c_custkey % 50 >= 45")
def grid_coverage(spark, sf_dir):
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", (k % 30).cast("double").alias("latitude"), (k % 50).cast("double").alias("longitude"))
    grid = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double").alias("lat"), (F.col("n_nationkey") * 44 / 24.0).alias("lon"))
    return Q.outside_axes(points, grid).select("c_custkey", "axis")


@query(f"with {_GRID} select true as covers, count(*) as n_valid, count(*) >= 100 as accepted from cells")
def raster_gate(spark, sf_dir):
    box = lambda *x: spark.createDataFrame([x], "west double, south double, east double, north double")
    return Q.raster_covers(box(0.0, 0.0, 40.0, 9000.0), box(1.0, 1.0, 39.0, 49.0), _cells(spark, sf_dir))


@query(f"with {_GRID} select count(*) as n_valid, count(*) as n_processed, true as complete from cells")
def flow_reached(spark, sf_dir):
    return Q.all_reached(_cells(spark, sf_dir), _flow(spark, sf_dir))


# --- shelters ------------------------------------------------------------------------------------

_SHELTERS = """s as (select s_suppkey as k, cast(s_suppkey as varchar) as shelter_id, case when s_suppkey % 4 = 3 then 'unverified' when s_suppkey % 4 = 2 or s_suppkey % 12 in (0, 4) then 'needs_review' else 'verified' end as verification_status,
 case when s_suppkey % 3 = 0 then 'operational' when s_suppkey % 3 = 1 then 'not_operational' else 'unknown' end as operational_status, cast(s_suppkey % 7 * 10 as int) as capacity, n_name as village, strftime(date '2024-01-01' + cast(s_suppkey % 20 as int), '%Y-%m-%d') as last_updated
 from supplier left join nation on n_nationkey = s_nationkey)"""


def _shelters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("shelter_id"), F.when(k % 4 == 3, "Unverified").when(k % 4 == 2, " ").otherwise(" VERIFIED ").alias("verification_status"),
        F.when(k % 3 == 0, "Operational").when(k % 3 == 1, "not_operational").otherwise("").alias("operational_status"), F.when(k % 12 == 4, "13.0").otherwise("11.5").alias("latitude"), F.lit("76.5").alias("longitude"),
        (k % 7 * 10).cast("string").alias("capacity"), F.when(k % 12 == 0, " ").otherwise("office").alias("source"), F.lit("2024-02-01").alias("verified_at"), F.col("s_nationkey").cast("string").alias("village_lgd_code"),
        F.lit("").alias("taluk"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 20).cast("int")), "yyyy-MM-dd").alias("last_updated"),
    )
    villages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("village_lgd_code"), F.col("n_name").alias("village_name_en"), F.lit("t").alias("taluk_name_en"))
    return Q.shelters(rows, villages, (11.0, 76.0, 12.0, 77.0))


@query(f"with {_SHELTERS} select shelter_id, case when verification_status = 'needs_review' and k % 4 = 2 then 'needs_review' else verification_status end as verification_status, operational_status, capacity, verification_status = 'verified' and operational_status = 'operational' as operational, village from s")
def shelter_rules(spark, sf_dir):
    return _shelters(spark, sf_dir).select("shelter_id", "verification_status", "operational_status", "capacity", "operational", "village")


@query(f"with {_SHELTERS} select count(*) as total_records, count(*) filter (verification_status = 'verified' and operational_status = 'operational') as route_eligible_records, count(*) filter (verification_status = 'verified') as verified, count(*) filter (verification_status = 'unverified') as unverified, count(*) filter (verification_status = 'needs_review') as needs_review, max(last_updated) as last_updated, 'authoritative' as source_coverage from s")
def shelter_coverage(spark, sf_dir):
    return Q.shelter_coverage(_shelters(spark, sf_dir))


@query(f"with {_SHELTERS}, d as (select shelter_id, 2 * 6371.0 * asin(sqrt(pow(sin(radians(11.5 - (11 + k % 10 / 10.0)) / 2), 2))) as km from s where verification_status = 'verified' and operational_status = 'operational') select shelter_id, round(km, 6) as km, cast(row_number() over (order by km, shelter_id) as int) as position from d")
def shelters_by_distance(spark, sf_dir):
    rows = _shelters(spark, sf_dir).filter("operational")
    km = S.haversine_km(F.lit(11) + F.col("shelter_id").cast("long") % 10 / 10.0, F.lit(76.5), F.col("latitude"), F.col("longitude"))
    return serving.ranked(rows.select("shelter_id", km.alias("km")), [F.asc("km"), F.asc("shelter_id")]).withColumn("km", F.round("km", 6))


# --- warnings ------------------------------------------------------------------------------------

_EVALUATED = """w as (select event_id, user_id, ts, case when event_id % 9 <> 0 then 40 + event_id % 60 end as score, case when event_id % 2 = 0 then case event_id % 3 when 0 then 1.0 when 1 then 1.5 else 2.2 end end as mult, value as m, case event_id % 4 when 0 then 'stale' when 1 then 'offline' else 'online' end as fresh, event_id % 5 = 0 as test, event_id % 7 <> 0 as hydro, nullif(event_id % 6, 0) as ev from events),
r as (select *, fresh = 'online' as on_, coalesce(score >= 80, false) as high, coalesce(score >= 60, false) as watch, coalesce(mult >= 1.5, false) as wr, coalesce(mult >= 2.0, false) as pr, fresh = 'online' and m >= 60 as wet, fresh = 'online' and m >= 80 as very from w),
e as (select *, case when high and pr then 'high_susceptibility_and_prepare_rainfall' when high and wr and very then 'high_susceptibility_watch_rainfall_and_very_wet_online_sensor' when watch and (wr or wet) then 'watch_susceptibility_with_rainfall_or_online_wet_sensor' when watch or wr then 'single_watch_signal' else 'no_configured_watch_signal' end as rule_id,
 case when (high and pr) or (high and wr and very) then 'red' when watch and (wr or wet) then 'orange' when watch or wr then 'yellow' else 'green' end as stage, case when fresh = 'online' then case when m >= 80 then 'very_wet' when m >= 60 then 'wet' else 'below_wet_support' end end as band from r)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(table(spark, sf_dir, "events"))


def evaluated(events: DataFrame) -> DataFrame:
    """Warnings of inputs made from events, batch or stream."""
    k = F.col("event_id")
    rows = events.select(
        "event_id", "user_id", "ts", F.when(k % 9 != 0, (40 + k % 60).cast("double")).alias("score"), F.when(k % 2 == 0, F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 1.5).otherwise(2.2)).alias("multiplier"),
        F.when(k % 2 == 0, "scenario").otherwise("current_conditions").alias("mode"), F.col("value").alias("moisture"), F.when(k % 4 == 0, "stale").when(k % 4 == 1, "offline").otherwise("online").alias("freshness"),
        (k % 5 == 0).alias("is_test"), F.when(k % 7 != 0, "available").alias("hydrology_status"), F.nullif(k % 6, F.lit(0)).alias("linked_events"), (k % 13 != 0).alias("supported"),
    )
    return warnings.evaluate(rows)


@query(f"""with {_EVALUATED} select event_id, case when score is null or event_id % 13 = 0 then 'unavailable' else 'available' end as status, case when event_id % 13 <> 0 then rule_id end as rule_id, case when event_id % 13 <> 0 then stage end as stage,
 case when event_id % 13 = 0 then 'validated model and hydrology coverage' else concat_ws('; ', case when score is null then 'modeled susceptibility' end, case when event_id % 2 = 1 then 'validated current rainfall' end,
  case when fresh = 'stale' then 'fresh soil-moisture observation (last reading is stale)' when fresh = 'offline' then 'fresh soil-moisture observation (sensor is offline)' end, case when not hydro then 'terrain-derived hydrological context' end) end as missing,
 case when event_id % 13 <> 0 then concat_ws(',', case when score is null then 'unavailable' when watch then 'high' else 'below_watch' end, case when mult is null then 'unavailable' when wr then 'elevated' else 'baseline' end, case when m >= 80 then 'very_wet' when m >= 60 then 'wet' else 'below_wet_support' end, case when hydro then 'available' else 'unavailable' end, case when ev > 0 then 'linked_records' else 'unavailable' end) end as graded from e""")
def warning_evidence(spark, sf_dir):
    graded = F.array_join(F.transform("factors", lambda f: f["status"]), ",")
    return _evaluated(spark, sf_dir).select("event_id", "status", "rule_id", "stage", F.array_join("missing_inputs", "; ").alias("missing"), graded.alias("graded"))


@query(f"""with {_EVALUATED} select event_id, case when event_id % 13 = 0 then 'Insufficient model/data coverage for warning evaluation.' else coalesce(nullif(concat_ws('; ', case when watch then 'High baseline modeled susceptibility' end, case when mult is not null then 'Rainfall scenario ' || printf('%.2f', mult) || '× historical baseline' end,
 case when wet then 'Online soil-moisture observation used' when fresh in ('stale', 'offline') then 'last reading not used' end, case when hydro then 'Terrain-derived hydrological context available; not a real-time water measurement' end), ''), 'No configured watch signal in the available inputs') || '.' end as reason from e""")
def warning_reasons(spark, sf_dir):
    """The moisture's digits are taken out, as rounding at ties differs between printers of numbers."""
    short = F.regexp_replace(F.regexp_replace("reason", r"Online soil-moisture observation [0-9.]+% used as supporting evidence", "Online soil-moisture observation used"), r"Soil-moisture last reading [0-9.]+% not used as current evidence \(sensor [a-z]+\)", "last reading not used")
    return _evaluated(spark, sf_dir).select("event_id", short.alias("reason"))


@query(f"""with {_EVALUATED}, s as (select user_id, event_id, ts, concat_ws('|', case when event_id % 13 <> 0 then stage || rule_id || coalesce(band, '') else 'none' end, event_id % 2, coalesce(cast(mult as varchar), ''), fresh, test) as sig from e), b as (select *, lag(sig) over w as before, row_number() over w as k from s window w as (partition by user_id order by ts, event_id)) select user_id, event_id from b where k = 1 or sig <> before""")
def warning_history(spark, sf_dir):
    rows = _evaluated(spark, sf_dir).select("user_id", "event_id", "ts", warnings.signature().alias("signature"))
    return state.changes(rows, ["user_id"], ["ts", "event_id"], ["signature"]).select("user_id", "event_id")


@query(f"with {_EVALUATED} select stage, count(*) as n from e where event_id % 13 <> 0 group by 1 order by case stage when 'red' then 1 when 'orange' then 2 when 'yellow' then 3 else 4 end limit 1")
def highest_stage(spark, sf_dir):
    return warnings.highest(_evaluated(spark, sf_dir).filter("stage is not null"))


# --- sensors -------------------------------------------------------------------------------------


@query("""with n as (select c_custkey as k, 'S' || (c_custkey % 150) as sensor_id, case when c_custkey % 4 = 0 then null else 'v' end as village, c_custkey % 3 = 0 as t from customer), s as (select 'S' || s_suppkey as sensor_id from supplier where s_suppkey < 90)
select k, case when s.sensor_id is not null then 'duplicate' when not (t or village is not null) then 'village_required' else 'accepted' end as outcome from n left join s using (sensor_id)""")
def sensor_registration(spark, sf_dir):
    k = F.col("c_custkey")
    new = table(spark, sf_dir, "customer").select(k.alias("k"), F.concat(F.lit("S"), k % 150).alias("sensor_id"), F.when(k % 4 != 0, "v").alias("village_lgd_code"), (k % 3 == 0).alias("is_test"))
    accepted, refused = sensors.registrations(new, _sensors(spark, sf_dir))
    return accepted.select("k", F.lit("accepted").alias("outcome")).unionByName(refused.select("k", F.col("reason").alias("outcome")))


@query("""with m as (select event_id, case when event_id % 5 = 1 then 'unknown_field' when event_id % 5 = 2 then 'percent_out_of_range' when event_id % 5 = 3 then 'malformed' when event_id % 5 = 4 then 'too_large' end as reason from events) select event_id, reason from m""")
def ingest_gate(spark, sf_dir):
    """Bodies as they arrive: an unknown field, a percentage out of range, no JSON, and one that is too large."""
    k = F.col("event_id")
    good = F.to_json(F.struct(F.lit("S1").alias("sensor_id"), F.lit(50.5).alias("soil_moisture_percent"), F.lit(1000).alias("raw_value")))
    body = F.when(k % 5 == 1, F.lit('{"sensor_id":"S1","soil_moisture_percent":50.5,"colour":"red"}')).when(k % 5 == 2, F.lit('{"sensor_id":"S1","soil_moisture_percent":100.5}')).when(k % 5 == 3, F.lit('{"sensor_id"')).when(k % 5 == 4, F.concat(F.lit('{"sensor_id":"'), F.repeat(F.lit("x"), 5000), F.lit('"}'))).otherwise(good)
    return sensors.parsed(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body").select("event_id", "reason")


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as recorded_at, strftime(ts + interval 1 hour, '%Y-%m-%d %H:%M:%S') as received_at from (select *, row_number() over (partition by user_id order by ts + interval 1 hour desc, event_id desc) as k from events) where k = 1 and event_id % 2 = 0 union all select event_id, strftime(ts + interval 1 hour, '%Y-%m-%d %H:%M:%S'), strftime(ts + interval 1 hour, '%Y-%m-%d %H:%M:%S') from (select *, row_number() over (partition by user_id order by ts + interval 1 hour desc, event_id desc) as k from events) where k = 1 and event_id % 2 = 1")
def arrival_order(spark, sf_dir):
    """The latest reading is the one that arrived last; what has no time of its own was recorded when it arrived."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("recorded_at"), (F.col("ts") + F.expr("interval 1 hour")).alias("received_at"))
    last = state.latest(sensors.with_times(rows), ["user_id"], ["received_at", "event_id"])
    return last.select("event_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("recorded_at", "received_at")))


@query("select event_id from events where event_id % 13 <> 0")
def without_test_readings(spark, sf_dir):
    return state.without_tests(_readings(spark, sf_dir)).select("event_id")


# --- sources and sinks ---------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select n_nationkey, case when n_nationkey % 5 = 0 then 'NA' when n_nationkey % 5 = 1 then '' else n_name end as n_name, strftime(date '2024-01-01' + n_nationkey, '%Y-%m-%d') as day from nation")
def csv_round_trip(spark, sf_dir):
    """Written and read again as typed columns, with NA and blanks kept as they are."""
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 5 == 0, "NA").when(k % 5 == 1, "").otherwise(F.col("n_name")).alias("n_name"), F.date_add(F.lit("2024-01-01").cast("date"), k).alias("day"))
    at = _folder(spark, "csv")
    sinks.write_csv(rows, at)
    text = readers.csv_text(spark, at)
    typed = readers.csv_typed(spark, at, "n_nationkey int, n_name string, day date").select("n_nationkey", F.date_format("day", "yyyy-MM-dd").alias("day"))
    return joins.many_to_one(text.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name"), typed, ["n_nationkey"])


@query("select r_regionkey, r_name, cast(r_regionkey as double) / 2 as half from region")
def published_table(spark, sf_dir):
    """Two releases of a table are published; readers find the second one."""
    rows = table(spark, sf_dir, "region").withColumn("half", F.col("r_regionkey") / 2.0)
    at = _folder(spark, "release")
    sinks.publish({"region": rows.filter("r_regionkey < 2"), "other": rows}, at)
    sinks.publish({"region": rows, "other": rows}, at)
    return sinks.read_published(spark, at, "region")


@query("""select c_custkey, '{"type":"Feature","properties":{"c_custkey":' || c_custkey || '},"geometry":{"type":"MultiLineString","coordinates":[[[' || (c_custkey % 100) || '.5,11.25],[76.5,12.5]]]}}' as value from customer""")
def line_features(spark, sf_dir):
    x = (F.col("c_custkey") % 100) + 0.5 + 1e-9
    rows = table(spark, sf_dir, "customer").withColumn("line", F.array(F.array(F.array(x, F.lit(11.25)), F.array(F.lit(76.5), F.lit(12.5)))))
    one = geometry.geojson(rows, ["c_custkey"], "line")
    return one.select(F.get_json_object("value", "$.properties.c_custkey").cast("long").alias("c_custkey"), "value")


@query("""with f as (select o_orderpriority as source, sha256('orders of ' || strftime(o_orderdate, '%Y') || ' ' || o_orderpriority) as h from orders where o_orderpriority <> '5-LOW' group by o_orderpriority, strftime(o_orderdate, '%Y')),
d as (select source, count(*) as n_files, list_aggregate(list_sort(list(h)), 'string_agg', ',') as digests from f group by 1)
select o_orderpriority as source, coalesce(n_files, 0) as n_files, coalesce(digests, '') as digests, count(distinct o_custkey) as n_lat, count(distinct o_orderstatus) as n_lon, count(*) as n_rows, (select count(*) from orders) as n_total, min(o_custkey) as lat_min, max(o_custkey) as lat_max from orders left join d on source = o_orderpriority group by 1, 2, 3""")
def source_provenance(spark, sf_dir):
    """Sources with a file for each year, but for one without any, and what their rows span."""
    rows = table(spark, sf_dir, "orders")
    year = F.date_format("o_orderdate", "yyyy")
    contents = F.concat(F.lit("orders of "), year, F.lit(" "), F.col("o_orderpriority")).cast("binary")
    files = rows.filter("o_orderpriority <> '5-LOW'").groupBy("o_orderpriority", year.alias("year")).agg(F.first(contents).alias("content"))
    out = catalog.source_provenance(rows, "o_orderpriority", files, "content", "o_orderdate", "o_custkey", "o_orderstatus")
    return out.select(F.col("o_orderpriority").alias("source"), "n_files", F.array_join("sha256s", ",").alias("digests"), "n_lat", "n_lon", "n_rows", "n_total", "lat_min", "lat_max")


@query("select count(*) as n_part, (select count(*) from supplier) as n_supplier, 0::bigint as n_sensor, true as ready_model, false as ready_sensors, false as ready from part")
def system_readiness(spark, sf_dir):
    tables = {"part": table(spark, sf_dir, "part"), "supplier": table(spark, sf_dir, "supplier"), "sensor": table(spark, sf_dir, "part").filter("p_partkey < 0")}
    rows = catalog.readiness(catalog.coverage_snapshot(tables, "part"), {"model": ["part", "supplier"], "sensors": ["sensor", "part"]})
    return rows.select("n_part", "n_supplier", "n_sensor", "ready_model", "ready_sensors", "ready")


@query("select 'available' as status, r_name as title, '/overlays/streams.png' as streams_url from region where r_regionkey = 0 union all select 'unavailable', null, null from region where r_regionkey = 0")
def hydrology_map(spark, sf_dir):
    meta = readers.json_document(spark, _written_json(spark, table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.col("r_name").alias("title"))))
    return catalog.map_payload(meta, True, ["streams"]).unionByName(catalog.map_payload(meta, False, ["streams"]))


def _written_json(spark: SparkSession, rows: DataFrame) -> str:
    at = _folder(spark, "json")
    sinks.write_json_lines(rows, at)
    return at


@query("select case when c_custkey % 2 = 0 then 'lat' else 'lon' end as axis, c_custkey as position, case when c_custkey % 30 = 4 then 'no_number' when c_custkey % 30 = 8 then 'out_of_limits' else 'not_rising' end as fault from customer where c_custkey < 80 and (c_custkey % 30 in (4, 8, 12) or (c_custkey % 30 = 10))")
def axis_checks(spark, sf_dir):
    """By place on the axis: no number, beyond the limits (the next one falls below it), and one that does not rise."""
    k = F.col("c_custkey")
    value = F.when(k % 30 == 4, F.lit(float("nan"))).when(k % 30 == 8, 999.0).when(k % 30 == 12, k - 2).otherwise(k.cast("double"))
    axes = table(spark, sf_dir, "customer").filter("c_custkey < 80").select(F.when(k % 2 == 0, "lat").otherwise("lon").alias("axis"), k.alias("position"), value.alias("value"))
    return readers.axis_faults(axes, {"lat": (0.0, 90.0), "lon": (0.0, 180.0)})


@query("select c_custkey, case when c_custkey % 4 <> 0 then c_name end as slide, case when c_custkey % 4 <> 0 then 'Hillside' end as district, cast(case when c_custkey % 3 <> 0 then 11.25 end as double) as lat from customer")
def anchored_columns(spark, sf_dir):
    """Lines whose columns begin where the state's name does, at another place in each line."""
    k = F.col("c_custkey")
    lead, state = F.repeat(F.lit(" "), (k % 7).cast("int")), F.when(k % 4 != 0, "Statename ").otherwise("Elsewhere ")
    line = F.concat(lead, state, F.lit("Hillside  "), F.col("c_name"), F.when(k % 3 != 0, "  10.5 76.0 11.25 76.5").otherwise("  -"))
    rows = readers.anchored(table(spark, sf_dir, "customer").select("c_custkey", line.alias("value")), "Statename", [("district", 10, 10), ("slide", 20, 18)])
    return rows.select("c_custkey", "slide", "district", F.col("place.latitude").alias("lat"))


@query("""select n_name as source_id, case when n_nationkey % 5 = 0 then 'planned' when n_nationkey % 3 = 1 then 'available' else 'unavailable' end as status from nation
union all select 'soil_moisture', 'unavailable' union all select 'shelters', case when (select count(*) from supplier where s_acctbal > 0) > 0 then 'available' else 'unavailable' end""")
def source_catalog(spark, sf_dir):
    """A source for each nation, planned, with its files, or with one that is not there; and two that depend on rows."""
    k, here, gone = F.col("n_nationkey"), F.lit(f"{sf_dir}/region.parquet"), F.lit(f"{sf_dir}/none")
    listed = F.when(k % 3 == 1, F.array(here)).when(k % 3 == 2, F.array(here, gone)).otherwise(F.array().cast("array<string>"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_id"), F.col("n_name").alias("name"), F.lit("observed").alias("data_type"), (k % 5 == 0).alias("planned"), listed.alias("artifacts"))
    sources = nations.unionByName(catalog.catalog(spark, [("soil_moisture", "Soil", "observed", False, []), ("shelters", "Shelters", "reference", False, [])]))
    paths = {p for p in (f"{sf_dir}/region.parquet", f"{sf_dir}/none") if catalog.exists(spark, p)}
    eligible = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").count()
    return catalog.availability(sources, paths, has_sensor=False, eligible_shelters=eligible).select("source_id", "status")
