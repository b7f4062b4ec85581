"""Registered queries of scalar functions, predicates and orders, on values made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slopeworks.functions import scalar as S
from slopeworks.operators import catalog, geometry, serving, state
from slopeworks.operators import quality as Q
from slopeworks.plans.hazard import query
from slopeworks.runtime import table


@query(r"""with r as (select c_custkey as k, '  ' || c_mktsegment || '   ' || c_name || '  ' as raw, c_name as name from customer)
select k, trim(raw) as trimmed, lower(trim(raw)) as folded, trim(regexp_replace(raw, '\s+', ' ', 'g')) as collapsed, trim(substr(raw, 5, 6)) as cell,
 case when k % 3 = 0 then null else name end as blank,
 case when k % 2 = 0 then 'Upper-side above ' || name else 'Road ' || name || ' end' end as joined,
 case when k % 4 = 0 then 'a|b b|c' end as parts, cast(case when k % 5 <> 0 then 11 + (k % 1000) / 1000.0 end as double) as lat,
 trim(substr(raw, 3, 4)) || ' ' || trim(substr(name, 3, 4)) as merged from r""")
def text_functions(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    raw = F.concat(F.lit("  "), "c_mktsegment", F.lit("   "), "c_name", F.lit("  "))
    fragments = F.when(k % 2 == 0, F.array(F.lit("Upper-"), F.lit("side a"), F.lit("bove"), name)).otherwise(F.array(F.lit("Road"), F.lit(""), name, F.lit("end")))
    place = F.when(k % 5 != 0, F.concat(F.lit("near 10.5 76.25 and "), F.format_string("%.3f", 11 + (k % 1000) / 1000.0), F.lit(" 76.5 end"))).otherwise("no place 5 6")
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), S.blank_to_null(raw).alias("trimmed"), F.lower(F.trim(raw)).alias("folded"), S.collapse_spaces(raw).alias("collapsed"), S.fixed_width(raw, 4, 6).alias("cell"),
        S.blank_to_null(F.when(k % 3 == 0, "   ").otherwise(name)).alias("blank"), S.join_fragments(fragments).alias("joined"),
        F.array_join(S.split_wide(F.when(k % 4 == 0, "a  b b   c").when(k % 4 == 1, "a  b").otherwise("a b c")), "|").alias("parts"), S.last_coordinates(place)["latitude"].alias("lat"),
        S.merged_lines(F.array(raw, F.lit("      "), name), 2, 4).alias("merged"),
    )


@query("""with r as (select o_orderkey as k, o_totalprice as v, o_orderkey % 90000 as s, (o_orderkey % 41 - 20) / 100.0 as d from orders)
select k, case k % 6 when 0 then cast(k as varchar) when 1 then cast(k as varchar) else null end as code,
 case when k % 5 < 3 then v end as finite_value, round_even(v * 10, 0) / 10 as rounded, k % 7 < 5 as percent_valid,
 case when s < 60 then cast(s as varchar) || ' sec ago' when s < 3600 then cast(s // 60 as varchar) || ' min ago' when s < 86400 then cast(s // 3600 as varchar) || ' hr ago' else cast(s // 86400 as varchar) || ' days ago' end as elapsed,
 case when abs(d) < 0.05 then 'zero' when d > 0 then 'up' else 'down' end as delta_class,
 case when abs((k % 9 - 4) / 2.0) < 0.05 then '0.0' when k % 9 > 4 then '+' || printf('%.1f', (k % 9 - 4) / 2.0) else printf('%.1f', (k % 9 - 4) / 2.0) end as delta,
 case when k % 101 = 0 then 'Clear' when k % 101 <= 3 then 'Cloudy' when k % 101 between 45 and 48 then 'Fog' when k % 101 between 51 and 57 then 'Drizzle' when k % 101 between 61 and 67 then 'Rain' when k % 101 between 71 and 77 then 'Snow' when k % 101 between 80 and 82 then 'Showers' when k % 101 between 95 and 99 then 'Thunderstorm' else 'Unknown' end as weather,
 case k % 5 when 0 then 'moderate' when 1 then 'baseline' when 2 then 'heavy' when 3 then 'extreme' else 'custom' end as preset,
 cast(case when k % 3 = 0 then 1.5 when k % 3 = 1 then 2.5 else 3.5 end as double) as chosen, dayofyear(make_date(cast(1990 + k % 40 as int), 12, 31)) as days from r""")
def number_functions(spark, sf_dir):
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    code = F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, F.concat(k.cast("string"), F.lit(".0"))).when(k % 6 == 2, F.concat(k.cast("string"), F.lit(".5"))).when(k % 6 == 3, F.concat(F.lit("-1"), k.cast("string"))).when(k % 6 == 4, "x").otherwise(" ")
    text = F.when(k % 5 < 3, v.cast("string")).when(k % 5 == 3, "NaN").otherwise("Infinity")
    percent = F.when(k % 7 < 5, (k % 101).cast("double")).when(k % 7 == 5, F.lit(float("nan"))).otherwise(100.5)
    factor = F.when(k % 5 == 0, 0.72).when(k % 5 == 1, 1.0).when(k % 5 == 2, 1.46).when(k % 5 == 3, 2.2).otherwise(1.2)
    text_score = F.when(k % 3 == 0, "1.5").when(k % 3 == 1, "")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), S.canonical_code(code).alias("code"), S.finite(text).alias("finite_value"), S.rint_at(v, 1).alias("rounded"), (~Q.outside(percent, 0, 100)).alias("percent_valid"),
        S.elapsed_text(k % 90000).alias("elapsed"), S.delta_class((k % 41 - 20) / 100.0).alias("delta_class"), S.delta_text((k % 9 - 4) / 2.0).alias("delta"), S.weather_label((k % 101).cast("int")).alias("weather"),
        S.preset_name(factor).alias("preset"), S.chosen_score(text_score, F.when(k % 3 == 1, "2.5"), F.lit("3.5")).alias("chosen"), S.year_days((1990 + k % 40).cast("int")).cast("long").alias("days"),
    )


@query("""select s_suppkey, case s_suppkey % 6 when 0 then 'missing' when 1 then 'invalid' when 2 then 'needs_review' when 3 then 'valid' when 4 then 'outside_study_extent' else 'invalid' end as status from supplier""")
def coordinate_checks(spark, sf_dir):
    k = F.col("s_suppkey") % 6
    lat = F.when(k == 0, " ").when(k == 1, "north").when(k == 2, "0").when(k == 3, "11.5").when(k == 4, "13.5").otherwise("91")
    rows = table(spark, sf_dir, "supplier")
    return rows.select("s_suppkey", S.coordinate_status(lat, F.when(k == 2, "0.0").otherwise("76.5"), (11.0, 76.0, 12.0, 77.0)).alias("status"))


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then 'explicit' when o_orderkey % 4 = 1 then 'year_only' when o_orderkey % 4 = 2 then 'na' else 'ambiguous' end as category,
 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as utc from orders""")
def served_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 1, "20245").when(k % 4 == 2, "Na").otherwise("around 2019")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 2 == 0, F.concat(iso, F.lit("Z"))).otherwise(iso)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.history_category_served(raw, F.when(k % 4 == 0, "2019-08-01").otherwise("")).alias("category"), F.date_format(S.utc_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("select p_brand, count(*) as n_files, list_aggregate(list_sort(list(sha256(p_name))), 'string_agg', ',') as sha256s from part group by 1")
def content_digests(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("content", F.col("p_name").cast("binary"))
    return catalog.provenance(rows, "p_brand", "content").withColumn("sha256s", F.array_join("sha256s", ","))


@query("""select o_orderkey, o_orderkey % 5 = 0 as route_valid from orders""")
def route_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    one, two = point(F.lit(76.5), F.lit(11.5)), point(F.when(k % 5 == 1, 190.0).otherwise(76.6), F.lit(11.6))
    coords = F.when(k % 5 == 2, F.array(one)).otherwise(F.array(one, two))
    good = S.route_valid(coords, F.when(k % 5 == 3, 0.0).otherwise(12.5), F.when(k % 5 == 4, 50.5).otherwise(50.0), F.lit(3.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", good.alias("route_valid"))


_UTM = """with p as (select s_suppkey, (8 + (s_suppkey * 6151 % 10007) / 2000.0)::double as lat, (72.5 + (s_suppkey * 3571 % 10009) / 2000.0)::double as lon from supplier),
a as (select s_suppkey, radians(lat) as phi, radians(lon - 75) as lam, 6378137.0::double as a, 0.00669437999014::double as e from p),
b as (select *, sin(phi) as s, cos(phi) as c, pow(tan(phi), 2) as t, e / (1 - e) as ep from a),
d as (select *, a / sqrt(1 - e * s * s) as n, ep * c * c as c2, c * lam as q, a * ((1 - e/4 - 3*e*e/64 - 5*e*e*e/256) * phi - (3*e/8 + 3*e*e/32 + 45*e*e*e/1024) * sin(2*phi) + (15*e*e/256 + 45*e*e*e/1024) * sin(4*phi) - 35*e*e*e/3072 * sin(6*phi)) as m from b)
select s_suppkey, round(0.9996 * n * (q + (1 - t + c2) * pow(q, 3) / 6 + (5 - 18*t + t*t + 72*c2 - 58*ep) * pow(q, 5) / 120) + 500000, 3) as east,
 round(0.9996 * (m + n * tan(phi) * (q*q/2 + (5 - t + 9*c2 + 4*c2*c2) * pow(q, 4) / 24 + (61 - 58*t + t*t + 600*c2 - 330*ep) * pow(q, 6) / 720)), 3) as north from d"""


@query(_UTM)
def utm_points(spark, sf_dir):
    k = F.col("s_suppkey")
    east, north = geometry.utm(8 + (k * 6151 % 10007) / 2000.0, 72.5 + (k * 3571 % 10009) / 2000.0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query("""with p as (select p_partkey, p_size / 10.0 as v from part), a(x) as (values (0.0), (1.0), (2.5), (4.0), (5.0))
select p_partkey, cast(arg_min(x, struct_pack(d := round(abs(x - v), 9), n := -x)) as double) as nearest from p, a group by 1""")
def nearest_axis(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", geometry.nearest_axis(F.round(F.col("p_size") / 10.0, 9), [0.0, 1.0, 2.5, 4.0, 5.0]).alias("nearest"))


@query("""select c_custkey, case when c_custkey % 6 = 0 then 'BENCH' when c_custkey % 2 = 0 then 'TEST' else 'PRODUCTION' end as record_class,
 case when c_custkey % 7 = 0 then 'unknown_place' when c_custkey % 5 = 0 then 'no_row' else 'available' end as outcome, 'source_unavailable' as outcome_incomplete from customer where c_custkey % 7 <> 0
 union all select c_custkey, case when c_custkey % 6 = 0 then 'BENCH' when c_custkey % 2 = 0 then 'TEST' else 'PRODUCTION' end, 'unknown_place', 'unknown_place' from customer where c_custkey % 7 = 0""")
def record_outcomes(spark, sf_dir):
    k = F.col("c_custkey")
    cls = state.record_class(F.when(k % 3 != 0, F.lit("village")), k % 2 == 0)
    out = lambda complete: serving.outcome(k % 7 != 0, complete, k % 5 != 0)
    return table(spark, sf_dir, "customer").select("c_custkey", cls.alias("record_class"), out(True).alias("outcome"), out(False).alias("outcome_incomplete"))


@query("""with s as (select user_id, event_id, cast(2000 + value * 20 as bigint) as raw, (row_number() over (partition by user_id order by event_id) - 1) // 10 as g from events),
m as (select user_id, g, sum(raw) // count(*) as mean_raw from s group by 1, 2), p as (select *, greatest(0.0, least(100.0, 100.0 * (4095 - mean_raw) / 2013)) as percent from m)
select user_id, g as reading, round(percent, 6) as percent, case when percent < 30 then 'DRY' when percent < 70 then 'NORMAL' else 'WET' end as status from p""")
def sensor_readings(spark, sf_dir):
    """Ten samples of a device make one reading."""
    place = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) / 10)
    samples = table(spark, sf_dir, "events").select("user_id", F.rint(2000 + F.col("value") * 20).cast("bigint").alias("raw"), place.alias("reading"))
    percent = S.device_reading(F.col("samples"))
    by = samples.groupBy("user_id", "reading").agg(F.collect_list("raw").alias("samples"))
    return by.select("user_id", "reading", F.round(percent, 6).alias("percent"), S.device_status(percent).alias("status"))


_RANKED = "select {cols}, cast(row_number() over ({part} order by {order}) as int) as position from {source}"


@query("with c as (select c_custkey, c_name, c_acctbal, case when c_acctbal >= 6000 then 'HIGH' when c_acctbal >= 3000 then 'MEDIUM' else 'LOW' end as tier from customer) select c_custkey, tier from c where tier = 'HIGH' and (lower(c_name) like '%customer%' and (cast(c_custkey as varchar) like '%7%'))")
def tier_search(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.upper("c_name").alias("name"), F.col("c_custkey").cast("string").alias("code"), S.tier(F.col("c_acctbal"), 6000.0, 3000.0).alias("tier"))
    found = serving.search(serving.search(serving.with_tier(rows, "tier", "high"), " Customer ", ["name"], []), "7", [], ["code"])
    return found.select("c_custkey", "tier")


@query("select p_partkey, p_name, cast(row_number() over (order by lower(p_name), p_name, p_partkey) as int) as position from (select p_partkey, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as p_name from part)")
def name_order(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"))
    return serving.ranked(rows, [*serving.by_name("p_name"), F.asc("p_partkey")])


@query("with s as (select c_custkey, case when c_custkey % 9 <> 0 then c_acctbal end as score from customer) select c_custkey, cast(row_number() over (order by score asc nulls last, c_custkey) as int) as up, cast(row_number() over (order by score desc nulls last, c_custkey) as int) as down from s")
def score_order(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("score"))
    up = serving.ranked(rows, serving.order_by_score("score", descending=False, tie="c_custkey")).select("c_custkey", F.col("position").alias("up"))
    return serving.ranked(rows, serving.order_by_score("score", tie="c_custkey")).select("c_custkey", F.col("position").alias("down")).join(up, "c_custkey")


@query("select o_custkey, o_orderkey, cast(k as int) as position from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k <= 14")
def last_fourteen(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return state.latest_n(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], 14).drop("o_orderdate")


@query("select o_orderkey, o_custkey, cast(row_number() over (order by o_orderdate desc, o_orderkey desc) as int) as position from orders order by o_orderdate desc, o_orderkey desc limit 500")
def newest_first(spark, sf_dir):
    return serving.newest(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 9000).select("o_orderkey", "o_custkey", "position")


@query("select o_orderkey, 'orders of ' || year(o_orderdate) as source, 'fixed' as method from orders where o_orderdate >= '1997-01-01' and o_orderdate < '1998-01-01'")
def year_with_lineage(spark, sf_dir):
    rows = serving.year_slice(table(spark, sf_dir, "orders"), "o_orderdate", 1997).withColumn("year", F.year("o_orderdate"))
    return catalog.with_lineage(rows, {"method": "fixed"}, {"source": ("orders of %d", "year")}).select("o_orderkey", "source", "method")


@query("select n_nationkey, n_name from nation join region on n_regionkey = r_regionkey where lower(trim(r_name)) in ('asia', 'europe')")
def district_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit(" "), "r_name").alias("district")), "n_regionkey")
    return Q.district(rows, "district", ["Asia ", "EUROPE"]).select("n_nationkey", "n_name")
