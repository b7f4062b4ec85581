"""Registered queries of the training table, its features, validation by groups, and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.operators import model
from slopeworks.plans.hazard import _METRICS, _MODEL, _SCORE, _TIER, ORACLE, query
from slopeworks.runtime import table

_DAYS = "days as (select cast(o_custkey % 40 as varchar) as v, cast(o_orderkey % 97 as double) / 4 as r1, case when o_orderkey % 11 <> 0 then cast(o_orderkey % 197 as double) / 2 end as r3, case when o_orderkey % 7 <> 0 then cast(o_orderkey % 397 as double) / 2 end as r7 from orders)"
_TABLE = f"""{_DAYS}, rain as (select v, quantile_cont(r7, 0.95) as r7p, quantile_cont(r3, 0.95) as r3p, max(r1) as r1m, sum(r1) / 5.0 as mean from days group by 1),
t as (select cast(s_suppkey as varchar) as v, 800 + s_suppkey * 1.5 as elevation_mean_m, 100.0 + s_suppkey % 13 as elevation_range_m, 5 + s_suppkey % 20 * 1.0 as slope_mean_deg, 30 + s_suppkey % 9 * 1.0 as slope_max_deg, s_suppkey * 3.5 as mean_flow, s_suppkey * 7 + 100.0 as max_flow, s_suppkey % 10 / 100.0 as fraction, s_suppkey % 17 / 10.0 as density,
 case when s_suppkey % 8 < 5 then s_suppkey % 8 else 0 end as n_events, 'taluk ' || (s_suppkey % 6) as taluk from supplier where s_suppkey < 40)"""


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter("s_suppkey < 40").withColumn("k", F.col("s_suppkey")).withColumn("village_lgd_code", F.col("k").cast("string"))


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = F.col("k"), F.col("o_orderkey")
    p = _population(spark, sf_dir)
    d = lambda c: c.cast("double")
    terrain = p.select(
        "village_lgd_code", d(800 + k * 1.5).alias("elevation_mean_m"), F.lit(700.0).alias("elevation_min_m"), d(800 + k % 13).alias("elevation_max_m"),
        d(5 + k % 20).alias("slope_mean_deg"), d(30 + k % 9).alias("slope_max_deg"),
    )
    days = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).cast("string").alias("village_lgd_code"), (d(o % 97) / 4).alias("rainfall_1d_mm"),
        F.when(o % 11 != 0, d(o % 197) / 2).alias("rainfall_3d_mm"), F.when(o % 7 != 0, d(o % 397) / 2).alias("rainfall_7d_mm"),
    )
    evidence = p.select("village_lgd_code", F.when(k % 8 < 5, k % 8).otherwise(0).alias(model.TARGET))
    master = p.select("village_lgd_code", F.concat(F.lit("taluk "), (k % 6).cast("string")).alias("taluk_name_en"))
    hydrology = p.select("village_lgd_code", *(d(c).alias(n) for n, c in zip(model.HYDROLOGY, (k * 3.5, k * 7 + 100, k % 10 / 100.0, k % 17 / 10.0))))
    return model.training_table(terrain, days, evidence, master, hydrology, sources={"boundary": "regions"})


_NAMED = "t.v as village_lgd_code, elevation_mean_m::double as elevation_mean_m, elevation_range_m::double as elevation_range_m, slope_mean_deg::double as slope_mean_deg, slope_max_deg::double as slope_max_deg, mean_flow::double as mean_flow_accumulation_cells, max_flow::double as max_flow_accumulation_cells, fraction::double as high_flow_area_fraction, density::double as drainage_density_km_per_km2, r7p as rainfall_7d_p95_mm, r3p as rainfall_3d_p95_mm, r1m as rainfall_1d_max_mm, round(mean, 6) as rainfall_annual_mean_mm"


@query(f"with {_TABLE} select {_NAMED}, taluk as taluk_name_en, case when n_events > 0 then 1 else 0 end as label_s, case when n_events > 0 then 'POSITIVE' else 'UNLABELED' end as pu_status, 'regions' as boundary_source from t join rain on rain.v = t.v")
def training_table(spark, sf_dir):
    rows = _training(spark, sf_dir).withColumn("rainfall_annual_mean_mm", F.round("rainfall_annual_mean_mm", 6))
    return rows.select("village_lgd_code", *model.FEATURES, "taluk_name_en", "label_s", "pu_status", "boundary_source")


@query(f"""with {_TABLE}, rows as (select {_NAMED} from t join rain on rain.v = t.v), long as (unpivot (select columns(* exclude (village_lgd_code))::double from rows) on * into name feature value x), seen as (select feature, count(x) as n_values, min(x) as least, max(x) as greatest from long group by 1)
select g as feature_group, f as feature, cast(p as int) as position, s as in_scenario, n_values, round(least, 6) as least, round(greatest, 6) as greatest from (values ('terrain', 'elevation_mean_m', 1, false), ('terrain', 'elevation_range_m', 2, false), ('terrain', 'slope_mean_deg', 3, false), ('terrain', 'slope_max_deg', 4, false),
('hydrology', 'mean_flow_accumulation_cells', 5, false), ('hydrology', 'max_flow_accumulation_cells', 6, false), ('hydrology', 'high_flow_area_fraction', 7, false), ('hydrology', 'drainage_density_km_per_km2', 8, false),
('rainfall', 'rainfall_7d_p95_mm', 9, true), ('rainfall', 'rainfall_3d_p95_mm', 10, true), ('rainfall', 'rainfall_1d_max_mm', 11, true), ('rainfall', 'rainfall_annual_mean_mm', 12, false)) d(g, f, p, s) join seen on feature = f""")
def feature_schema(spark, sf_dir):
    """The model's features in order, with what the training table holds of each."""
    seen = model.completeness(_training(spark, sf_dir), list(model.FEATURES))
    rows = model.feature_groups(spark).join(F.broadcast(seen), "feature")
    return rows.select("feature_group", "feature", "position", "in_scenario", "n_values", F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"))


_PRIOR = f"""with {_TABLE}, r0 as (select taluk as fold, case when n_events > 0 then 1.0 else 0.0 end as y from t), n as (select sum(y) as p, sum(1 - y) as u from r0), g as (select fold, n.p - sum(y) as tp, n.u - sum(1 - y) as tu from r0, n group by fold, n.p, n.u),
r as (select fold, y, tp / (tp + tu) as p, tp / (tp + tu) as s from r0 join g using (fold)), """
_OUT = """round(sum(neg * (tp - pos / 2)) / max(nullif(pa * na, 0)), 6) as roc_auc, round(case when max(na) > 0 then sum(pos * tp / (tp + fp)) / max(nullif(pa, 0)) end, 6) as average_precision, round(sum(loss) / sum(pos + neg), 6) as brier,
 coalesce(sum(pos) filter (s >= 0.5), 0)::double as tp, coalesce(sum(neg) filter (s >= 0.5), 0)::double as fp, coalesce(sum(pos) filter (s < 0.5), 0)::double as fn, coalesce(sum(neg) filter (s < 0.5), 0)::double as tn from w"""


def _folds(spark, sf_dir):
    rows = _training(spark, sf_dir).select("village_lgd_code", "taluk_name_en", "label_s")
    return model.evaluate_folds(model.leave_one_group_out(rows, "taluk_name_en", "label_s"), "label_s")


def _rounded(df: DataFrame) -> list[Column]:
    return [*(F.round(c, 6).alias(c) for c in ("roc_auc", "average_precision", "brier")), "tp", "fp", "fn", "tn"]


@query(_PRIOR + _METRICS.format(k="fold, ", g="fold") + f" select fold, {_OUT} group by fold")
def fold_metrics(spark, sf_dir):
    by_fold, _ = _folds(spark, sf_dir)
    return by_fold.select("fold", *_rounded(by_fold))


@query(_PRIOR + _METRICS.format(k="", g="1") + f" select {_OUT}")
def pooled_metrics(spark, sf_dir):
    _, pooled = _folds(spark, sf_dir)
    return pooled.select(*_rounded(pooled))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")


@query(f"with x as (select p_partkey, {_SCORE.format(s='p_size', p='p_retailprice')} as b, {_SCORE.format(s='20', p='(p_retailprice * 1.8)')} as s from part) select p_partkey, 'own' as scenario, 1.8::double as factor, b as baseline_score, s as scenario_score, round_even((s - b) * 100, 0) / 100 as delta, {_TIER.format('b')} as baseline_tier, {_TIER.format('s')} as scenario_tier from x union all select p_partkey, 'unheard', 1.0, b, {_SCORE.format(s='20', p='p_retailprice')}, round_even(({_SCORE.format(s='20', p='p_retailprice')} - b) * 100, 0) / 100, {_TIER.format('b')}, {_TIER.format(_SCORE.format(s='20', p='p_retailprice'))} from x join part using (p_partkey)")
def scenario_overrides(spark, sf_dir):
    """A multiplier of its own, a preset that nobody knows, and one feature set outright."""
    presets = {"own": model.scenario_factor("heavy", 1.8), "unheard": model.scenario_factor("unheard")}
    return model.scenario(_parts(spark, sf_dir), model.score(model.load_model(_MODEL)), ["p_partkey"], presets, scaled=("p_size", "p_retailprice"), overrides={"p_size": 20.0})


@query(f"with g as ({ORACLE['scenario_grid']}) select scenario, factor, count(*) filter (scenario_tier = 'HIGH') as high, count(*) filter (scenario_tier = 'MEDIUM') as medium, count(*) filter (scenario_tier = 'LOW') as low, round(avg(scenario_score), 6) as mean_score from g group by 1, 2")
def scenario_summary(spark, sf_dir):
    rows = model.scenario(_parts(spark, sf_dir), model.score(model.load_model(_MODEL)), ["p_partkey"], scaled=("p_size", "p_retailprice"))
    return model.scenario_summary(rows).withColumn("mean_score", F.round("mean_score", 6))


@query("select p_partkey, round(1 / (1 + exp(-(case when p_partkey % 3 < 2 then -0.75 when p_size < 25 then -0.75 else 0.5 end + case when p_partkey % 3 < 2 then 0.25 when cast(p_retailprice as float) < 1000 then -0.25 when p_size < 40 then 0.25 else 1.25 end))), 9) as probability from part where p_partkey % 3 = 2 or p_retailprice >= 0")
def scores_of_gaps(spark, sf_dir):
    """Features that are null or NaN go the way that the tree has for them: left at its size splits, right at its price split, then left."""
    k = F.col("p_partkey")
    gap = lambda c: F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 3 == 2, c.cast("double"))
    rows = table(spark, sf_dir, "part").select("p_partkey", gap(F.col("p_size")).alias("p_size"), gap(F.col("p_retailprice")).alias("p_retailprice"))
    return rows.select("p_partkey", F.round(model.score(model.load_model(_MODEL)), 9).alias("probability"))


_LOGISTIC = """with recursive r as (select p_partkey, p_partkey % 5 as g, cast(p_size as double) as x, case when p_partkey * 7919 % 100 < p_size + 20 then 1.0 else 0.0 end as y from part), folds as (select distinct g as fold from r),
st as (select fold, avg(x) as m, stddev_pop(x) as d, sum(y) / greatest(sum(1 - y), 1) as wu from folds join r on r.g <> fold group by 1), tr as (select fold, (x - m) / d as z, y, case when y = 1 then 1.0 else wu end as w from st join r on r.g <> fold),
b(fold, k, b0, b1) as (select fold, 0, 0.0::double, 0.0::double from st union all
 select fold, k + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) from (
  select fold, k, b0, b1, 0.5 * sum(w * (p - y)) as g0, 0.5 * sum(w * (p - y) * z) + b1 as g1, 0.5 * sum(w * p * (1 - p)) as h00, 0.5 * sum(w * p * (1 - p) * z) as h01, 0.5 * sum(w * p * (1 - p) * z * z) + 1 as h11
  from (select b.*, z, y, w, 1 / (1 + exp(-(b0 + b1 * z))) as p from b join tr using (fold) where k < 12) group by fold, k, b0, b1)),
done as (select fold, b0, b1, m, d from b join st using (fold) where k = 12)"""


def _logistic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    label = F.when(k * 7919 % 100 < F.col("p_size") + 20, 1).otherwise(0)
    rows = table(spark, sf_dir, "part").select("p_partkey", (k % 5).alias("fold_group"), F.col("p_size").cast("double").alias("size"), label.alias("label"))
    return rows, model.logistic_folds(rows, "fold_group", ["size"], "label")


@query(f"{_LOGISTIC} select fold, round(b0, 6) as intercept, round(b1, 6) as coefficient, round(m, 6) as mean, round(d, 6) as scale from done")
def logistic_folds(spark, sf_dir):
    """A logistic model of all parts but a group's, for each group."""
    _, folds = _logistic(spark, sf_dir)
    return folds.select("fold", F.round("intercept", 6).alias("intercept"), *(F.round(F.col(c)[0], 6).alias(n) for c, n in (("coefficients", "coefficient"), ("mean", "mean"), ("scale", "scale"))))


_HELD = ", r as (select g as fold, y, round(1 / (1 + exp(-(b0 + b1 * (x - m) / d))), 9) as p, round(1 / (1 + exp(-(b0 + b1 * (x - m) / d))), 9) as s from r0 join done on fold = g), "


@query(_LOGISTIC.replace("r as (select p_partkey", "r0 as (select p_partkey").replace("from r)", "from r0)").replace("join r on r.g", "join r0 on r0.g") + _HELD + _METRICS.format(k="fold, ", g="fold") + f" select fold, {_OUT} group by fold")
def logistic_fold_metrics(spark, sf_dir):
    """How each fold's model does on the group that it has not seen."""
    rows, folds = _logistic(spark, sf_dir)
    scored = model.held_out_scores(rows, folds, "fold_group", ["size"]).withColumn("probability", F.round("probability", 9)).withColumnRenamed("fold_group", "fold")
    by_fold = model.metrics(scored, "label", "probability", ["fold"])
    return by_fold.select("fold", *_rounded(by_fold))
