"""Registered queries: each applies operators to the driver's tables, with the SQL that must agree."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.functions import scalar as S
from slopeworks.operators import catalog, drainage, geometry, joins, model, quality, raster, serving, state, timeseries, warnings
from slopeworks.runtime import by_key, table
from slopeworks.streaming import sensors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(c, places: int = 6):
    return F.round(c, places)


# --- calendar windows, percentiles, index -------------------------------------------------

_DAILY = """daily as (select user_id, cast(ts as date) as day, sum(value) as v from events group by all),
span as (select min(day) as a, max(day) as b from daily),
cal as (select user_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from (select distinct user_id from daily), span),
dense as (select cal.user_id, cal.day, v from cal left join daily using (user_id, day)),
ante as (select *,
  case when count(v) over w3 = 3 then sum(v) over w3 end as sum_3d, case when count(v) over w7 = 7 then sum(v) over w7 end as sum_7d
  from dense window w3 as (partition by user_id order by day rows between 2 preceding and current row), w7 as (partition by user_id order by day rows between 6 preceding and current row))"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))


def _antecedent(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir)
    span = daily.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = daily.select("user_id").distinct().crossJoin(F.broadcast(span)).select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    return timeseries.antecedent(days.join(daily, ["user_id", "day"], "left"), ["user_id"], "day", "v")


@query(f"with {_DAILY} select user_id, strftime(day, '%Y-%m-%d') as day, round(v, 6) as v, round(sum_3d, 6) as sum_3d, round(sum_7d, 6) as sum_7d from ante")
def antecedent_sums(spark, sf_dir):
    return _antecedent(spark, sf_dir).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *(_r(F.col(c)).alias(c) for c in ("v", "sum_3d", "sum_7d")))


_CLIMATE = f"""{_DAILY}, clim as (select user_id, quantile_cont(sum_7d, 0.95) as p95_7d, quantile_cont(sum_3d, 0.95) as p95_3d, max(v) as max_1d, sum(v) / 5.0 as annual_mean from ante group by user_id)"""


def _climatology(spark, sf_dir):
    return timeseries.climatology(_antecedent(spark, sf_dir), ["user_id"], "v")


@query(f"with {_CLIMATE} select user_id, round(p95_7d, 6) as p95_7d, round(p95_3d, 6) as p95_3d, round(max_1d, 6) as max_1d, round(annual_mean, 6) as annual_mean from clim")
def climatology(spark, sf_dir):
    return _climatology(spark, sf_dir).select("user_id", *(_r(F.col(c)).alias(c) for c in ("p95_7d", "p95_3d", "max_1d", "annual_mean")))


_INDEX = f"""{_CLIMATE}, hist as (select user_id, count(*) as n_errors from events where event_type = 'error' group by user_id),
raw as (select clim.user_id, max_1d as terrain, coalesce(p95_7d, p95_3d, 0) as rain, ln(1 + coalesce(n_errors, 0)) as history from clim left join hist using (user_id)),
ends as (select min(terrain) t0, max(terrain) t1, min(rain) r0, max(rain) r1, min(history) h0, max(history) h1 from raw),
idx as (select user_id, 100.0 * (0.35 * (terrain - t0) / nullif(t1 - t0, 0) + 0.40 * (rain - r0) / nullif(r1 - r0, 0) + 0.25 * (history - h0) / nullif(h1 - h0, 0)) as score from raw, ends)"""


def _index(spark, sf_dir):
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n_errors"))
    raw = joins.lookup(_climatology(spark, sf_dir), errors, ["user_id"], "n_errors", 0)
    raw = raw.select("user_id", F.col("max_1d").alias("terrain"), F.coalesce("p95_7d", "p95_3d", F.lit(0.0)).alias("rain"), F.log1p("n_errors").alias("history"))
    scaled = timeseries.min_max(raw, ["terrain", "rain", "history"])
    return scaled.select("user_id", timeseries.composite_index(*(F.col(f"{c}_norm") for c in ("terrain", "rain", "history"))).alias("score"))


@query(f"with {_INDEX} select user_id, round(score, 6) as score, case when score is null then null when score >= 60 then 'HIGH' when score >= 30 then 'MEDIUM' else 'LOW' end as tier from idx")
def composite_index(spark, sf_dir):
    return _index(spark, sf_dir).select("user_id", _r(F.col("score")).alias("score"), S.tier(F.col("score")).alias("tier"))


@query(f"with {_INDEX}, r as (select user_id, round(score, 6) as score from idx) select user_id, score, cast(row_number() over (order by score desc nulls last, user_id) as int) as position from r")
def composite_ranking(spark, sf_dir):
    rows = composite_index(spark, sf_dir).select("user_id", "score")
    return serving.ranked(rows, serving.order_by_score("score", tie="user_id"))


@query(f"with {_INDEX}, c as (select case when score >= 60 then 'HIGH' when score >= 30 then 'MEDIUM' else 'LOW' end as tier, count(*) as n from idx where score is not null group by 1) select t.tier, coalesce(n, 0) as n from (values ('HIGH'), ('MEDIUM'), ('LOW')) t(tier) left join c using (tier)")
def tier_counts(spark, sf_dir):
    rows = _index(spark, sf_dir).filter("score is not null").select(S.tier(F.col("score")).alias("tier"))
    return serving.histogram(rows, "tier", ["HIGH", "MEDIUM", "LOW"])


@query("select year(o_orderdate) as year, count(*) as n_rows, count(distinct cast(o_orderdate as date)) as n_dates from orders group by 1")
def year_audit(spark, sf_dir):
    return timeseries.year_audit(table(spark, sf_dir, "orders"), "o_orderdate")


@query("with d as (select distinct user_id, cast(ts as date) as day from events), cal as (select user_id, cast(unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day)) as date) as day from (select distinct user_id from d)) select user_id, strftime(day, '%Y-%m-%d') as day from cal anti join d using (user_id, day)")
def calendar_gaps(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    gaps = timeseries.missing_days(days, ["user_id"], "day", F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))
    return gaps.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


# --- joins and quality ---------------------------------------------------------------------


@query("with l as (select distinct c_custkey as k from customer), r as (select distinct o_custkey as k from orders) select count(l.k) as n_left, count(*) filter (l.k is not null and r.k is not null) as n_matched, count(*) filter (r.k is null) as n_left_only, count(*) filter (l.k is null) as n_right_only from l full join r on l.k = r.k")
def coverage_join(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return joins.coverage(left, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("select o_orderkey, c_name, n_name, coalesce(r_name, '') as r_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def checked_joins(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    rows = joins.many_to_one(t["orders"].select("o_orderkey", F.col("o_custkey").alias("c_custkey")), t["customer"], ["c_custkey"])
    rows = joins.many_to_one(rows.withColumnRenamed("c_nationkey", "n_nationkey"), t["nation"], ["n_nationkey"])
    rows = joins.lookup(rows.withColumnRenamed("n_regionkey", "r_regionkey"), t["region"], ["r_regionkey"], "r_name", "")
    return rows.select("o_orderkey", "c_name", "n_name", "r_name")


@query("select 'left' as side, p_partkey as k from part where p_partkey % 7 <> 0 and (p_partkey % 5 = 0 or p_partkey not in (select l_partkey from lineitem)) union all select 'right', k from (select distinct l_partkey as k from lineitem) where k % 5 <> 0 and (k % 7 = 0 or k not in (select p_partkey from part))")
def identity_differences(spark, sf_dir):
    a = table(spark, sf_dir, "part").filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("k"))
    b = table(spark, sf_dir, "lineitem").filter("l_partkey % 5 <> 0").select(F.col("l_partkey").alias("k")).distinct()
    return joins.identity_differences(a, b, ["k"])


@query("with o as (select *, case when o_orderkey % 7 = 0 then null else o_totalprice end as price from orders) select 'price_in_range' as rule, count(*) filter (not coalesce(price between 1000 and 400000, false)) as n_violations from o union all select 'o_orderstatus_known', count(*) filter (not coalesce(o_orderstatus in ('F', 'O'), false)) from o union all select 'o_orderpriority_not_blank', count(*) filter (trim(o_orderpriority) = '' or o_orderpriority is null) from o union all select 'unique_o_custkey', count(*) - count(distinct o_custkey) from o")
def quality_report(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    rules = [quality.in_range("price", 1000, 400000), quality.one_of("o_orderstatus", ["F", "O"]), quality.not_blank("o_orderpriority")]
    return quality.report(orders, rules, [["o_custkey"]])


@query("select c as \"column\", n, n_null, n_distinct, least, greatest from (select 'p_brand' as c, count(*) as n, count(*) filter (p_brand is null) as n_null, count(distinct p_brand) as n_distinct, min(p_brand) as least, max(p_brand) as greatest from part union all select 'p_size', count(*), count(*) filter (p_size is null), count(distinct p_size), cast(min(p_size) as varchar), cast(max(p_size) as varchar) from part)")
def column_profile(spark, sf_dir):
    return quality.profile(table(spark, sf_dir, "part"), ["p_brand", "p_size"])


@query("select l_orderkey, count(distinct struct_pack(a := l_returnflag, b := l_linestatus)) as n_values from lineitem group by 1 having count(distinct struct_pack(a := l_returnflag, b := l_linestatus)) > 1")
def constant_within(spark, sf_dir):
    return quality.constant_within(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("select p_partkey from part where p_partkey % 3 = 0 and p_size > 25 and p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")
def key_sets(spark, sf_dir):
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    third, large = part.filter("p_partkey % 3 = 0").select("p_partkey"), part.filter("p_size > 25").select("p_partkey")
    return third.intersect(large).exceptAll(line.filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct())


# --- state -----------------------------------------------------------------------------------

_AS_OF = "2024-01-31 00:00:00"


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def latest_reading(spark, sf_dir):
    return state.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("select user_id, event_id, cast(k as int) as position from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k <= 5")
def latest_five(spark, sf_dir):
    return state.latest_n(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 5).drop("ts")


@query(f"with l as (select user_id, max(ts) as ts from events group by 1), a as (select user_id, greatest(0, (epoch_us(timestamp '{_AS_OF}') - epoch_us(ts)) // 1000000) as age_s from l) select user_id, age_s, case when age_s <= 3600 then 'online' when age_s <= 14400 then 'stale' else 'offline' end as freshness from a")
def freshness(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    now = F.lit(_AS_OF).cast("timestamp_ntz")
    return last.select("user_id", S.age_seconds(F.col("ts"), now).alias("age_s"), S.freshness(F.col("ts"), now, 3600, 14400).alias("freshness"))


_BAND = "case when value >= 80 then 'very_wet' when value >= 60 then 'wet' else 'below' end"


@query(f"with e as (select user_id, ts, event_id, {_BAND} as band from events), b as (select *, lag(band) over w as before, row_number() over w as k from e window w as (partition by user_id order by ts, event_id)) select user_id, event_id, band from b where k = 1 or band is distinct from before")
def change_history(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", S.moisture_band(F.col("value")).alias("band"))
    return state.changes(rows, ["user_id"], ["ts", "event_id"], ["band"]).drop("ts")


@query("with e as (select user_id, ts, event_id, case when value < 60 then 'normal' when value < 80 then 'elevated' else 'high' end as state from events where value between 0 and 100), b as (select *, lag(state) over (partition by user_id order by ts, event_id) as before from e), c as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from b where before is null or before <> state) select user_id, event_id, state, cast(k as int) as position from c where k <= 12")
def state_transitions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return state.transitions(rows, ["user_id"], ["ts", "event_id"], S.moisture_alert(F.col("value"))).select("user_id", "event_id", "state", "position")


def _readings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("S"), F.col("user_id") % 97).alias("sensor_id"), F.when(F.col("event_id") % 11 != 0, (F.col("user_id") % 97 % 10).cast("string")).alias("village_lgd_code"),
        F.col("value").alias("soil_moisture_percent"), (F.col("event_id") * 1000).alias("raw_value"), F.when(F.col("event_id") % 13 == 0, True).alias("is_test"), "event_id",
    )


def _sensors(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").filter("s_suppkey < 90")
    return s.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("sensor_id"), (F.col("s_suppkey") % 10).cast("string").alias("village_lgd_code"), (F.col("s_suppkey") % 5 == 0).alias("is_test"))


@query("""with r as (select event_id, 'S' || (user_id % 97) as sensor_id, case when event_id % 11 <> 0 then cast(user_id % 97 % 10 as varchar) end as village, value, event_id * 1000 as raw, case when event_id % 13 = 0 then true end as is_test from events),
s as (select 'S' || s_suppkey as sensor_id, cast(s_suppkey % 10 as varchar) as rv, s_suppkey % 5 = 0 as rt from supplier where s_suppkey < 90)
select event_id, case when s.sensor_id is null then 'unknown_sensor' when village is distinct from rv then 'village_mismatch' when is_test is not null and is_test <> rt then 'test_flag_mismatch' when value is null or not value between 0 and 100 then 'percent_out_of_range' when not raw between 0 and 10000000 then 'raw_out_of_range' end as reason from r left join s using (sensor_id)""")
def quarantine(spark, sf_dir):
    return sensors.enrich(_readings(spark, sf_dir), _sensors(spark, sf_dir)).select("event_id", "reason")


# --- warnings, scenarios, models ----------------------------------------------------------------


@query("""with x as (select c_custkey, (c_acctbal + 1000) / 110.0 as score, c_custkey % 101 as moisture, case when c_custkey % 3 = 0 then 'stale' else 'online' end as freshness, p.factor, p.name as scenario
from customer, (values ('moderate', 0.7), ('baseline', 1.0), ('heavy', 1.5), ('extreme', 2.2)) p(name, factor)),
y as (select *, case when freshness = 'online' then moisture end as wet from x)
select c_custkey, scenario, case when score >= 80 and factor >= 2.0 then 'red' when score >= 80 and factor >= 1.5 and coalesce(wet >= 80, false) then 'red' when score >= 60 and (factor >= 1.5 or coalesce(wet >= 60, false)) then 'orange' when score >= 60 or factor >= 1.5 then 'yellow' else 'green' end as stage from y""")
def warning_cascade(spark, sf_dir):
    presets = spark.createDataFrame(list(S.PRESETS.items()), "scenario string, multiplier double")
    rows = table(spark, sf_dir, "customer").crossJoin(F.broadcast(presets)).select(
        "c_custkey", "scenario", ((F.col("c_acctbal") + 1000) / 110.0).alias("score"), "multiplier", (F.col("c_custkey") % 101).cast("double").alias("moisture"),
        F.when(F.col("c_custkey") % 3 == 0, "stale").otherwise("online").alias("freshness"), F.lit("scenario").alias("mode"), F.lit(0).alias("linked_events"),
    )
    return warnings.evaluate(rows).select("c_custkey", "scenario", "stage")


@query("with s as (select case when c_acctbal >= 9000 then 'red' when c_acctbal >= 5000 then 'orange' when c_acctbal >= 0 then 'yellow' else 'green' end as stage from customer), c as (select stage, count(*) as n from s group by 1) select stage, coalesce(n, 0) as n from (values ('green'), ('yellow'), ('orange'), ('red')) d(stage) left join c using (stage)")
def stage_counts(spark, sf_dir):
    a = F.col("c_acctbal")
    rows = table(spark, sf_dir, "customer").select(F.when(a >= 9000, "red").when(a >= 5000, "orange").when(a >= 0, "yellow").otherwise("green").alias("stage"))
    return warnings.counts(rows, "stage", warnings.STAGES)


#: A small stored model of two trees over two features of parts.
_MODEL = json.dumps({"learner": {"feature_names": ["p_size", "p_retailprice"], "gradient_booster": {"model": {"trees": [
    {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [25.0, -0.75, 0.5], "default_left": [1, 0, 0], "loss_changes": [3.0, 0.0, 0.0]},
    {"left_children": [1, -1, 3, -1, -1], "right_children": [2, -1, 4, -1, -1], "split_indices": [1, 0, 0, 0, 0], "split_conditions": [1000.0, -0.25, 40.0, 0.25, 1.25], "default_left": [0, 0, 1, 0, 0], "loss_changes": [2.0, 0.0, 1.0, 0.0, 0.0]},
]}}}})
_MARGIN = "(case when {s} < 25 then -0.75 else 0.5 end + case when cast({p} as float) < 1000 then -0.25 when {s} < 40 then 0.25 else 1.25 end)"


@query(f"select p_partkey, round(1 / (1 + exp(-{_MARGIN.format(s='p_size', p='p_retailprice')})), 9) as probability from part")
def tree_scores(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(model.score(model.load_model(_MODEL)), 9).alias("probability"))


@query("with g(feature, gain) as (values ('p_size', 3.0::double), ('p_retailprice', 2.0), ('p_size', 1.0)), m as (select feature, count(*) as n_splits, avg(gain) as gain from g group by 1) select feature, n_splits, gain / (select sum(gain) from m) as importance, (select case feature when 'p_size' then count(*) + count(*) filter (cast(p_retailprice as float) >= 1000) else count(*) end from part) as n_rows from m")
def tree_importances(spark, sf_dir):
    """Gains of the stored model's splits, with the parts that reach them."""
    found = model.load_model(_MODEL)
    return model.importances(spark, found).join(model.split_covers(table(spark, sf_dir, "part"), found), "feature")


_SCORE = "round_even(10000 / (1 + exp(-" + _MARGIN + ")), 0) / 100"
_TIER = "case when {0} >= 60 then 'HIGH' when {0} >= 30 then 'MEDIUM' else 'LOW' end"


@query(f"with x as (select p_partkey, name as scenario, factor, {_SCORE.format(s='p_size', p='p_retailprice')} as baseline_score, {_SCORE.format(s='(p_size * factor)', p='(p_retailprice * factor)')} as scenario_score from part, (values ('moderate', cast(0.7 as double)), ('baseline', 1.0), ('heavy', 1.5), ('extreme', 2.2)) f(name, factor)) select *, round_even((scenario_score - baseline_score) * 100, 0) / 100 as delta, {_TIER.format('baseline_score')} as baseline_tier, {_TIER.format('scenario_score')} as scenario_tier from x")
def scenario_grid(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return model.scenario(parts, model.score(model.load_model(_MODEL)), ["p_partkey"], scaled=("p_size", "p_retailprice"))


_METRICS = """by_score as (select {k} s, sum(y) as pos, sum(1 - y) as neg, sum((p - y) * (p - y)) as loss from r group by all),
w as (select *, sum(pos) over (partition by {g} order by s desc) as tp, sum(neg) over (partition by {g} order by s desc) as fp, sum(pos) over (partition by {g}) as pa, sum(neg) over (partition by {g}) as na from by_score)"""


@query("with r as (select cast(quality as double) as y, least(1.0, n_chars / 6000.0) as p, least(1.0, n_chars / 6000.0) as s from labels join documents using (doc_id)), " + _METRICS.format(k="", g="1") + """
select round(sum(neg * (tp - pos / 2)) / max(pa * na), 6) as roc_auc, round(sum(pos * tp / (tp + fp)) / max(pa), 6) as average_precision, round(sum(loss) / sum(pos + neg), 6) as brier,
  coalesce(sum(pos) filter (s >= 0.5), 0) as tp, coalesce(sum(neg) filter (s >= 0.5), 0) as fp, coalesce(sum(pos) filter (s < 0.5), 0) as fn, coalesce(sum(neg) filter (s < 0.5), 0) as tn from w""")
def classification_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 6000.0).alias("p"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    out = model.metrics(rows, "quality", "p")
    return out.select(*(_r(F.col(c)).alias(c) for c in ("roc_auc", "average_precision", "brier")), "tp", "fp", "fn", "tn")


@query("""with r as (select lang, doc_id, quality as y from labels join documents using (doc_id)), g as (select lang, count(*) filter (y = 1) as p, count(*) filter (y = 0) as u from r group by 1), t as (select sum(p) as ap, sum(u) as au from g),
f as (select lang as fold, cast(row_number() over (order by lang) as int) as fold_index, ap - p as np, au - u as nu from g, t)
select fold, fold_index, doc_id, lang = fold as is_test, round(case when y = 1 then 1.0 else np / greatest(nu, 1) end, 9) as weight from r, f""")
def loto_splits(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "quality")
    return model.leave_one_group_out(rows, "lang", "quality").select("fold", "fold_index", "doc_id", "is_test", F.round("weight", 9).alias("weight"))


# --- geometry ------------------------------------------------------------------------------------


def _diamonds(spark, sf_dir):
    """A diamond of radius 4 with a hole of radius 1 around (8 k + 4, 5) for each region k, so that neighbours touch in a corner."""
    x = F.col("r_regionkey") * 8.0 + 4.0
    ring = lambda r: F.array(*(F.struct((x + dx * r).alias("x"), F.lit(5.0 + dy * r).alias("y")) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))))
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("code"), F.array(F.struct(ring(4.0).alias("shell"), F.array(ring(1.0)).alias("holes"))).alias("parts"))


_NEAR = "(abs(x - (8 * r_regionkey + 4)) + abs(y - 5))"


@query(f"""with p as (select c_custkey, cast(c_custkey % 43 as double) / 1 - 1 as x, cast((c_custkey // 43) % 23 as double) / 2 as y from customer),
h as (select c_custkey, r_name, {_NEAR} as d from p, region),
m as (select c_custkey, count(*) filter (d < 4 and d > 1) as i, count(*) filter (d = 4 or d = 1) as t, min(r_name) filter (d < 4 and d > 1) as c from h group by 1)
select c_custkey, case when i = 1 and t = 0 then 'EXACT' when i + t > 0 then 'AMBIGUOUS' else 'NO_MATCH' end as match_status, case when i = 1 and t = 0 then c end as code from m""")
def strict_linkage(spark, sf_dir):
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", ((k % 43) - 1).cast("double").alias("x"), (F.floor(k / 43) % 23 / 2.0).alias("y"))
    return geometry.link_points(points, _diamonds(spark, sf_dir), "c_custkey", "code", 2.0).select("c_custkey", "match_status", "code")


def _cells(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"), F.col("p_size").cast("double").alias("z"))


_GRID = "cells as (select cast(p_partkey // 40 as int) as \"row\", cast(p_partkey % 40 as int) as col, cast(p_size as double) as z from part)"


@query(f"with {_GRID}, c as (select col + 0.5 as x, \"row\" % 11 + 0.25 as y, z from cells), i as (select r_name, z from c, region where {_NEAR} < 4 and {_NEAR} > 1) select r_name as code, count(z) as n_cells, round(avg(z), 6) as mean_z, min(z) as min_z, max(z) as max_z from region left join i using (r_name) group by 1")
def zonal_stats(spark, sf_dir):
    cells = _cells(spark, sf_dir).select((F.col("col") + 0.5).alias("x"), (F.col("row") % 11 + 0.25).alias("y"), "z")
    return geometry.zonal(cells, _diamonds(spark, sf_dir), "code", ["z"]).withColumn("mean_z", _r(F.col("mean_z")))


@query("with p as (select s_suppkey, 10 + (s_suppkey * 37 % 1000) / 250.0 as lat, 76 + (s_suppkey * 91 % 1000) / 250.0 as lon from supplier) select s_suppkey, cast(floor(lat / 0.25 + 0.5) * 0.25 as double) as grid_lat, cast(floor(lon / 0.25 + 0.5) * 0.25 as double) as grid_lon from p")
def nearest_grid(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.snap(10 + (k * 37 % 1000) / 250.0, 0.25).alias("grid_lat"), S.snap(76 + (k * 91 % 1000) / 250.0, 0.25).alias("grid_lon"))


_HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2))))"


@query(f"""with c as (select c_custkey, 8 + (c_custkey * 7919 % 10007) / 1000.0 as lat, 70 + (c_custkey * 104729 % 10009) / 1000.0 as lon from customer),
s as (select s_suppkey, 8 + (s_suppkey * 6151 % 10007) / 1000.0 as lat, 70 + (s_suppkey * 3571 % 10009) / 1000.0 as lon from supplier),
d as (select c_custkey, s_suppkey, {_HAVERSINE} as km from c, s)
select c_custkey, round(min(km), 6) as distance_km from d group by 1""")
def nearest_site(spark, sf_dir):
    place = lambda k, a, b: ((8 + (k * a % 10007) / 1000.0).alias("lat"), (70 + (k * b % 10009) / 1000.0).alias("lon"))
    points = table(spark, sf_dir, "customer").select("c_custkey", *place(F.col("c_custkey"), 7919, 104729))
    sites = table(spark, sf_dir, "supplier").select("s_suppkey", *place(F.col("s_suppkey"), 6151, 3571))
    return geometry.nearest_sites(points, sites, "c_custkey", "s_suppkey").select("c_custkey", _r(F.col("distance_km")).alias("distance_km"))


@query("""with seg as (select n_nationkey as route, n_nationkey * 40.0 as x1, 0.0 as y1, n_nationkey * 40.0 + 300 as x2, 400.0 as y2 from nation),
pt as (select s_suppkey, cast(s_suppkey * 53 % 1400 as double) as x, cast(s_suppkey * 29 % 430 as double) as y, s_acctbal from supplier),
d as (select route, s_suppkey, s_acctbal, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) as t, x, y, x1, y1, x2, y2 from seg, pt),
n as (select route, s_acctbal from d where sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) <= 50),
a as (select n_nationkey as route, count(s_acctbal) filter (s_acctbal > 9500) as n_red, count(s_acctbal) filter (s_acctbal > 8000) as n_listed, count(s_acctbal) as n_events from nation left join n on n.route = n_nationkey group by 1)
select route, n_red, n_listed, n_events, case when n_red > 0 then 'high_risk' when n_listed > 0 then 'caution' else 'preferred' end as status from a""")
def route_exposure(spark, sf_dir):
    k = F.col("n_nationkey")
    routes = table(spark, sf_dir, "nation").select(k.alias("route"))
    segments = table(spark, sf_dir, "nation").select(k.alias("route"), (k * 40.0).alias("x1"), F.lit(0.0).alias("y1"), (k * 40.0 + 300).alias("x2"), F.lit(400.0).alias("y2"))
    s = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select("s_suppkey", (s * 53 % 1400).cast("double").alias("x"), (s * 29 % 430).cast("double").alias("y"))
    balances = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    near = geometry.near_routes(points, segments, "s_suppkey", "route", 50.0).join(balances, "s_suppkey")
    b = F.col("s_acctbal")
    counts = near.groupBy("route").agg(F.count_if(b > 9500).alias("n_red"), F.count_if(b > 8000).alias("n_listed"), F.count(b).alias("n_events"))
    rows = routes.join(counts, "route", "left").fillna(0, ["n_red", "n_listed", "n_events"])
    return rows.withColumn("status", geometry.exposure_status(F.col("n_red"), F.col("n_listed")))


# --- rasters ---------------------------------------------------------------------------------------

_GRADIENT = "case when lag({a}) over w = {a} - 1 and lead({a}) over w = {a} + 1 then (lead(z) over w - lag(z) over w) / (2 * {s}) when lead({a}) over w = {a} + 1 then (lead(z) over w - z) / {s} when lag({a}) over w = {a} - 1 then (z - lag(z) over w) / {s} end"


@query(f"with {_GRID}, gx as (select \"row\", col, z, {_GRADIENT.format(a='col', s='30.0')} as gx from cells window w as (partition by \"row\" order by col)), g as (select *, {_GRADIENT.format(a='row', s='30.0').replace('(row)', '(\"row\")').replace('= row', '= \"row\"')} as gy from gx window w as (partition by col order by \"row\")) select \"row\", col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) as slope_deg from g")
def slope_grid(spark, sf_dir):
    return raster.slope_degrees(_cells(spark, sf_dir), F.lit(30.0), F.lit(30.0)).select("row", "col", _r(F.col("slope_deg")).alias("slope_deg"))


_STEPS = "steps(k, dr, dc, code) as (values (0, 0, 1, 1), (1, 1, 1, 2), (2, 1, 0, 4), (3, 1, -1, 8), (4, 0, -1, 16), (5, -1, -1, 32), (6, -1, 0, 64), (7, -1, 1, 128))"


@query(f"""with {_GRID}, {_STEPS}, n as (select a."row", a.col, k, code, (a.z - b.z) / case when k % 2 = 1 then sqrt(2.0) else 1.0 end as d from cells a, steps join cells b on b."row" = a."row" + dr and b.col = a.col + dc),
best as (select "row", col, code from (select *, row_number() over (partition by "row", col order by d desc, k) as r from n where d > 0) where r = 1)
select "row", col, coalesce(code, 0) as direction from cells left join best using ("row", col)""")
def d8_direction(spark, sf_dir):
    return raster.d8_direction(_cells(spark, sf_dir)).select("row", "col", "direction")


@query("with recursive up(node, top) as (select p_partkey, p_partkey from part union all select node, (top - 1) // 2 from up where top > 0) select top as p_partkey, count(*) as accumulation from up group by 1")
def flow_accumulation(spark, sf_dir):
    k = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select("p_partkey", F.when(k > 0, F.floor((k - 1) / 2)).alias("down"))
    return raster.accumulate(nodes, "p_partkey", "down")


@query()
def depression_fill(spark, sf_dir):
    return drainage.fill_depressions(_cells(spark, sf_dir))


def _flow(spark, sf_dir):
    cells = raster.settled(raster.d8_direction(_cells(spark, sf_dir)))
    key = lambda r, c: F.concat_ws("_", r, c)
    down = raster.downstream(cells).select("row", "col", key(F.col("to_row"), F.col("to_col")).alias("down"))
    nodes = cells.join(by_key(down), ["row", "col"], "left").select("row", "col", "direction", key(F.col("row"), F.col("col")).alias("node"), "down")
    return nodes.join(by_key(raster.accumulate(nodes)), "node")


_UP = f"""with recursive {_GRID}, {_STEPS}, n as (select a."row", a.col, k, dr, dc, code, (a.z - b.z) / case when k % 2 = 1 then sqrt(2.0) else 1.0 end as d from cells a, steps join cells b on b."row" = a."row" + dr and b.col = a.col + dc),
best as (select "row", col, "row" + dr as tr, col + dc as tc, code from (select *, row_number() over (partition by "row", col order by d desc, k) as r from n where d > 0) where r = 1),
up(r0, c0, tr, tc) as (select "row", col, "row", col from cells union all select r0, c0, best.tr, best.tc from up join best on best."row" = up.tr and best.col = up.tc),
acc as (select tr as "row", tc as col, count(*) as accumulation from up group by 1, 2)"""


@query(f"{_UP} select \"row\", col, accumulation, accumulation >= 4 as is_stream from acc")
def stream_cells(spark, sf_dir):
    return raster.stream_mask(_flow(spark, sf_dir), 4).select("row", "col", "accumulation", "is_stream")


@query()
def stream_segments(spark, sf_dir):
    rows = raster.stream_segments(raster.stream_mask(_flow(spark, sf_dir), 4).select("node", "down", "is_stream"))
    return rows.select("segment", F.array_join("nodes", ">").alias("nodes"))


@query(f"""{_UP}, m as (select acc."row" // 8 as zone, accumulation, code from acc left join best on best."row" = acc."row" and best.col = acc.col)
select cast(zone as bigint) as zone, count(*) as n_cells, round(count(*) * 900 / 1e6, 6) as area_km2, round(avg(accumulation), 6) as mean_accumulation, max(accumulation) as max_accumulation,
round(avg(case when accumulation >= 4 then 1.0 else 0.0 end), 6) as stream_fraction, round(coalesce(sum(case when accumulation >= 4 and code is not null then case when code in (2, 8, 32, 128) then 30 * sqrt(2.0) else 30.0 end end), 0) / 1000, 6) as stream_km from m group by 1""")
def zonal_hydrology(spark, sf_dir):
    cells = _flow(spark, sf_dir).withColumn("zone", F.floor(F.col("row") / 8))
    out = raster.zonal_hydrology(cells, "zone", 30.0, 4)
    return out.select("zone", "n_cells", "max_accumulation", *(_r(F.col(c)).alias(c) for c in ("area_km2", "mean_accumulation", "stream_fraction", "stream_km")))


@query(f"with {_GRID}, t as (select \"row\", col, case when z > 10 then z end as z, 0 as o from cells union all select \"row\", col, z + 100, 1 from cells where col % 2 = 0) select \"row\", col, min_by(z, o) filter (z is not null) as z from t group by 1, 2")
def raster_mosaic(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    first = cells.withColumn("z", F.when(F.col("z") > 10, F.col("z"))).withColumn("tile_order", F.lit(0))
    return raster.mosaic(first.unionByName(cells.filter("col % 2 = 0").withColumn("z", F.col("z") + 100).withColumn("tile_order", F.lit(1))))


# --- serving ---------------------------------------------------------------------------------------


@query("with c as (select c_custkey, c_name, case when c_custkey % 9 <> 0 then c_acctbal end as score from customer where lower(c_name) like '%00%') select c_custkey, score, cast(row_number() over (order by score desc nulls last, c_custkey) as int) as position from c")
def ranking(spark, sf_dir):
    rows = serving.search(table(spark, sf_dir, "customer"), "00", ["c_name"], [])
    rows = rows.select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("score"))
    return serving.ranked(rows, serving.order_by_score("score", tie="c_custkey"))


@query("with r as (select o_orderkey, o_custkey, case when o_orderstatus = 'F' then 'preferred' when o_orderstatus = 'O' then 'caution' else 'high_risk' end as status, o_orderkey % 3 as n_red, o_orderkey % 5 as n_orange, o_orderkey % 2 as n_high, o_orderkey % 7 as n_events, o_totalprice as distance_m, o_orderkey as duration_s from orders) select o_custkey, o_orderkey, cast(p as int) as position from (select *, row_number() over (partition by o_custkey order by case status when 'preferred' then 1 when 'caution' then 2 else 3 end, n_red, n_orange, n_high, n_events, distance_m, duration_s) as p from r) where p <= 3")
def route_rank(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "preferred").when(F.col("o_orderstatus") == "O", "caution").otherwise("high_risk").alias("status"),
        (k % 3).alias("n_red"), (k % 5).alias("n_orange"), (k % 2).alias("n_high"), (k % 7).alias("n_events"), F.col("o_totalprice").alias("distance_m"), k.alias("duration_s"),
    )
    return serving.ranked(rows, serving.route_order(), ["o_custkey"], 3).select("o_custkey", "o_orderkey", "position")


@query("select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as int)) as bigint) as total_k, count(*) filter (json_extract_string(props, '$.missing') is null) as n_missing from events group by 1")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    missing = F.get_json_object("props", "$.missing")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total_k"), F.count_if(missing.isNull()).alias("n_missing"))


_DATES = "case o_orderkey % 6 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then 'NA' when 2 then '2019' when 3 then cast(1 + o_orderkey % 28 as varchar) || 'th august 2019 at 5 pm' when 4 then '31 February 2024' else 'October 2014' end"


@query(f"with r as (select o_orderkey, {_DATES} as raw, strftime(o_orderdate, '%Y-%m-%d') as iso from orders), p as (select *, case when o_orderkey % 6 = 0 then iso when o_orderkey % 6 = 3 then '2019-08-' || lpad(cast(1 + o_orderkey % 28 as varchar), 2, '0') else '' end as parsed from r) select o_orderkey, parsed, case when raw = 'NA' then 'na' when parsed <> '' then 'explicit_date' when regexp_full_match(raw, '\\d{{4}}') then 'year_only' else 'ambiguous' end as category from p")
def text_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    day = F.concat((1 + k % 28).cast("string"), F.lit("th august 2019 at 5 pm"))
    raw = F.when(k % 6 == 0, iso).when(k % 6 == 1, "NA").when(k % 6 == 2, "2019").when(k % 6 == 3, day).when(k % 6 == 4, "31 February 2024").otherwise("October 2014")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("parsed", S.strict_date(F.col("raw")))
    return rows.select("o_orderkey", "parsed", S.history_category(F.col("raw"), F.col("parsed")).alias("category"))


@query("with l as (select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k = 1) select c_custkey, case when l.o_custkey is null then 'missing' else 'available' end as order_status, l.o_orderkey, l.o_totalprice, case when n_nationkey is null then 'missing' else 'available' end as nation_status, n_name from customer left join l on l.o_custkey = c_custkey left join nation on n_nationkey = c_nationkey")
def context_struct(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_totalprice")
    last = state.latest(orders, ["c_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = people.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select("c_custkey", "n_name")
    rows = serving.assemble(people.select("c_custkey"), "c_custkey", {"last_order": last, "nation": nations, "hydrology": None})
    return rows.select("c_custkey", F.col("last_order.status").alias("order_status"), "last_order.o_orderkey", "last_order.o_totalprice", F.col("nation.status").alias("nation_status"), "nation.n_name")


@query("select count(*) as n_part, (select count(*) from supplier) as n_supplier, 100.0 as pct_part, round_even(1000.0 * (select count(*) from supplier) / nullif(count(*), 0), 0) / 10 as pct_supplier from part")
def coverage_snapshot(spark, sf_dir):
    return catalog.coverage_snapshot({"part": table(spark, sf_dir, "part"), "supplier": table(spark, sf_dir, "supplier")}, "part")


@query("select l_suppkey, round(100.0 * (4095 - l_partkey % 4200) / 2013 , 6) as percent_raw, case when greatest(0, least(100, 100.0 * (4095 - l_partkey % 4200) / 2013)) < 30 then 'DRY' when greatest(0, least(100, 100.0 * (4095 - l_partkey % 4200) / 2013)) < 70 then 'NORMAL' else 'WET' end as status, count(*) as n from lineitem group by all")
def device_calibration(spark, sf_dir):
    raw = (F.col("l_partkey") % 4200).cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", _r(100.0 * (4095 - raw) / 2013).alias("percent_raw"), S.device_status(S.device_moisture(raw)).alias("status"))
    return rows.groupBy("l_suppkey", "percent_raw", "status").agg(F.count("*").alias("n"))
