"""Stored tree models as expressions, scenarios, validation splits and metrics."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slopeworks.functions.scalar import PRESETS, rint_at, tier
from slopeworks.operators.joins import enforce, one_to_one
from slopeworks.runtime import on_workers, settled

#: The twelve features in their groups (fixed values); evidence and the composite index are no features.
TERRAIN = ("elevation_mean_m", "elevation_range_m", "slope_mean_deg", "slope_max_deg")
HYDROLOGY = ("mean_flow_accumulation_cells", "max_flow_accumulation_cells", "high_flow_area_fraction", "drainage_density_km_per_km2")
RAINFALL = ("rainfall_7d_p95_mm", "rainfall_3d_p95_mm", "rainfall_1d_max_mm", "rainfall_annual_mean_mm")
FEATURES = (*TERRAIN, *HYDROLOGY, *RAINFALL)
TARGET = "conditional_strict_linked_event_count"


def load_model(text: str) -> dict:
    """A stored boosted-tree model of binary logistic objective, from its JSON text."""
    learner = json.loads(text)["learner"]
    return {"features": learner["feature_names"], "trees": learner["gradient_booster"]["model"]["trees"]}


def _node(tree: dict, features: list[str], k: int) -> Column:
    if tree["left_children"][k] == -1:
        return F.lit(float(tree["split_conditions"][k]))
    value = F.col(features[tree["split_indices"][k]]).cast("float")
    left, right = _node(tree, features, tree["left_children"][k]), _node(tree, features, tree["right_children"][k])
    missing = left if tree["default_left"][k] else right
    return F.when(value.isNull() | F.isnan(value), missing).when(value < F.lit(tree["split_conditions"][k]).cast("float"), left).otherwise(right)


def score(model: dict) -> Column:
    """The probability of the positive class: the logistic of the sum of leaves."""
    total = F.lit(0.0)
    for tree in model["trees"]:
        total = total + _node(tree, model["features"], 0)
    return 1.0 / (1.0 + F.exp(-total))


def importances(spark: SparkSession, model: dict) -> DataFrame:
    """(feature, n_splits, importance): mean gain of a feature's splits, as a share of all features' sum."""
    rows = [(model["features"][t["split_indices"][k]], float(t["loss_changes"][k])) for t in model["trees"] for k in range(len(t["left_children"])) if t["left_children"][k] != -1]
    by = spark.createDataFrame(rows, "feature string, gain double").groupBy("feature").agg(F.count("*").alias("n_splits"), F.avg("gain").alias("gain"))
    return by.join(F.broadcast(by.agg(F.sum("gain").alias("total")))).select("feature", "n_splits", (F.col("gain") / F.col("total")).alias("importance"))


def split_covers(df: DataFrame, model: dict) -> DataFrame:
    """(feature, n_rows): how many rows reach the splits of each feature, counted in one pass over the table."""
    reached: dict[str, Column] = {}

    def walk(tree: dict, k: int, here: Column) -> None:
        if tree["left_children"][k] == -1:
            return
        feature, limit = model["features"][tree["split_indices"][k]], tree["split_conditions"][k]
        reached[feature] = reached.get(feature, F.lit(0)) + here.cast("int")
        value = F.col(feature).cast("float")
        left = F.when(value.isNull() | F.isnan(value), F.lit(bool(tree["default_left"][k]))).otherwise(value < F.lit(limit).cast("float"))
        walk(tree, tree["left_children"][k], here & left)
        walk(tree, tree["right_children"][k], here & ~left)

    for tree in model["trees"]:
        walk(tree, 0, F.lit(True))
    sums = df.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(f) for f, n in reached.items()))
    return sums.select(F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(f), F.col(f"`{f}`").cast("long")) for f in reached)))).alias("feature", "n_rows"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_values, least, greatest) of numeric columns, in one pass."""
    one = lambda c: F.struct(F.lit(c).alias("feature"), F.count(c).alias("n_values"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("greatest"))
    return df.agg(F.array(*map(one, columns)).alias("found")).select(F.explode("found").alias("f")).select("f.*")


def feature_groups(spark: SparkSession) -> DataFrame:
    """(feature_group, feature, position, in_scenario) of the model's features, in order."""
    groups = (("terrain", TERRAIN), ("hydrology", HYDROLOGY), ("rainfall", RAINFALL))
    rows = [(g, f, FEATURES.index(f) + 1, f in SCALED) for g, features in groups for f in features]
    return spark.createDataFrame(rows, "feature_group string, feature string, position int, in_scenario boolean")


def training_table(terrain: DataFrame, days: DataFrame, evidence: DataFrame, master: DataFrame, hydrology: DataFrame, key: str = "village_lgd_code", years: float = 5.0, sources: dict[str, str] | None = None) -> DataFrame:
    """One row per place: features, label, group and lineage; fails on a source that lacks a place or holds it twice, and on null features.

    ``terrain`` is the population, ``days`` has the rainfall sums of each place and day, ``evidence`` the
    linked events, ``master`` the group's name, ``hydrology`` its four metrics. A place without linked
    events is unlabeled, which is no negative.
    """
    rain = days.groupBy(key).agg(
        F.percentile("rainfall_7d_mm", 0.95).alias("rainfall_7d_p95_mm"), F.percentile("rainfall_3d_mm", 0.95).alias("rainfall_3d_p95_mm"),
        F.max("rainfall_1d_mm").alias("rainfall_1d_max_mm"), (F.sum("rainfall_1d_mm") / F.lit(years)).alias("rainfall_annual_mean_mm"),
    )
    rows = terrain.withColumn("elevation_range_m", F.col("elevation_max_m") - F.col("elevation_min_m"))
    names = master.select(key, "taluk_name_en").distinct()
    for part in (rain, evidence.select(key, TARGET), names, hydrology.select(key, *HYDROLOGY)):
        rows = one_to_one(rows, part, [key])
    rows = settled(rows)
    enforce(rows.filter(F.greatest(*(F.col(c).isNull() for c in FEATURES))).select(key), "features are null, and nothing is filled in")
    positive = F.col(TARGET) > 0
    lineage = {f"{name}_source": F.lit(text) for name, text in (sources or {}).items()}
    return rows.withColumns({"label_s": positive.cast("int"), "pu_status": F.when(positive, "POSITIVE").otherwise("UNLABELED"), **lineage})


#: The features that a rainfall scenario scales, and those it leaves.
SCALED = ("rainfall_7d_p95_mm", "rainfall_3d_p95_mm", "rainfall_1d_max_mm")


def scenario_factor(preset: str | None = None, multiplier: float | None = None) -> float:
    """A multiplier if given, else the preset's factor; a preset of another name leaves the rainfall as it is."""
    return float(multiplier) if multiplier is not None else PRESETS.get(preset or "", 1.0)


def scenario_summary(rows: DataFrame) -> DataFrame:
    """(scenario, factor, high, medium, low, mean_score) of the scenario's rows."""
    n = lambda name: F.count_if(F.col("scenario_tier") == name)
    return rows.groupBy("scenario", "factor").agg(n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"), F.avg("scenario_score").alias("mean_score"))


def scenario(df: DataFrame, probability: Column, key: list[str], presets: dict[str, float] | None = None, scaled: tuple[str, ...] = SCALED, overrides: dict[str, float] | None = None) -> DataFrame:
    """A row per place and preset: scores before and after, both tiers, and the difference of the rounded scores.

    A preset is a row of a small fixed table that joins every place. Overrides set a feature outright.
    """
    table = df.sparkSession.createDataFrame(list((presets or PRESETS).items()), "scenario string, factor double")
    base = df.withColumn("_baseline", rint_at(probability * 100, 2))
    rows = base.crossJoin(F.broadcast(table)).withColumns({c: F.col(c) * F.col("factor") for c in scaled})
    rows = rows.withColumns({c: F.lit(float(v)) for c, v in (overrides or {}).items()})
    after = rint_at(probability * 100, 2)
    return rows.select(*key, "scenario", "factor", F.col("_baseline").alias("baseline_score"), after.alias("scenario_score")).select(
        "*", rint_at(F.col("scenario_score") - F.col("baseline_score"), 2).alias("delta"), tier(F.col("baseline_score")).alias("baseline_tier"), tier(F.col("scenario_score")).alias("scenario_tier")
    )


#: Groups that may be held out one by one, each with a copy of all rows.
FOLDS = 1000


def evaluate_folds(splits: DataFrame, label: str, fit=None, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Metrics of each fold's held-out rows, and of all held-out rows together.

    ``splits`` are rows of ``leave_one_group_out``. ``fit(training rows) -> function that adds probability``
    is called for each fold; without it, the prior is the score: the share of positives in training.
    """
    if fit is None:
        prior = splits.filter(~F.col("is_test")).groupBy("fold").agg(F.avg(F.col(label).cast("double")).alias("probability"))
        scored = splits.filter("is_test").join(F.broadcast(prior), "fold")
    else:
        splits, scored = settled(splits), None
        for fold in [r["fold"] for r in splits.select("fold").distinct().orderBy("fold").collect()]:  # at most FOLDS
            mine = splits.filter(F.col("fold") == fold)
            one = fit(mine.filter(~F.col("is_test")))(mine.filter("is_test"))
            scored = one if scored is None else scored.unionByName(one)
    scored = settled(scored.select("fold", label, "probability"))
    return metrics(scored, label, "probability", ["fold"], threshold), metrics(scored, label, "probability", threshold=threshold)


def leave_one_group_out(df: DataFrame, group: str, label: str) -> DataFrame:
    """Each row once in every fold: the fold's number in sorted order, whether the row is held out, and its weight.

    In a fold's training rows a positive weighs 1, an unlabeled one positives / unlabeled. Folds are as many
    as groups, a small set that is broadcast; their counts are sums over groups, without a pass per fold.
    """
    by = df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("u"))
    every = by.agg(F.sum("p").alias("all_p"), F.sum("u").alias("all_u"))
    folds = by.crossJoin(F.broadcast(every)).select(
        F.col(group).alias("fold"), F.row_number().over(Window.orderBy(group)).alias("fold_index"), (F.col("all_p") - F.col("p")).alias("n_pos"), (F.col("all_u") - F.col("u")).alias("n_unl")
    )
    if folds.limit(FOLDS + 1).count() > FOLDS:
        raise ValueError(f"more than {FOLDS} groups: every row would be copied for each of them")
    rows = df.crossJoin(F.broadcast(folds)).withColumn("is_test", F.col(group) == F.col("fold"))
    return rows.withColumn("weight", F.when(F.col(label) == 1, 1.0).otherwise(F.col("n_pos") / F.greatest(F.col("n_unl"), F.lit(1))))


def cumulated(by: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by score ``s`` with ``tp`` and ``fp`` (of ``pos`` and ``neg`` from the highest score down to it) and ``p_all`` and ``n_all``.

    Scores are dealt out in ranges that are summed each, and the sums above a range come from the few sums of ranges.
    """
    parts = int(by.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(by.repartitionByRange(parts, *keys, F.desc("s")).withColumn("_range", F.spark_partition_id()))
    above, total = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    sums = ranged.groupBy("_range", *keys).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    sums = sums.withColumns({"_pos_above": F.sum("_pos").over(above), "_neg_above": F.sum("_neg").over(above), "p_all": F.sum("_pos").over(total), "n_all": F.sum("_neg").over(total)})
    names = {k: f"_key{n}" for n, k in enumerate(keys)}
    met = F.col("_range") == F.col("_of")
    for k, name in names.items():
        met = met & F.col(k).eqNullSafe(F.col(name))
    sums = sums.drop("_pos", "_neg").withColumnsRenamed(names | {"_range": "_of"})
    down, zero = Window.partitionBy("_range", *keys).orderBy(F.desc("s")), F.lit(0.0)
    rows = ranged.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)}).join(sums, met)
    return rows.withColumns({"tp": F.coalesce("tp", zero) + F.coalesce("_pos_above", zero), "fp": F.coalesce("fp", zero) + F.coalesce("_neg_above", zero)})


def metrics(df: DataFrame, label: str, probability: str, keys: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """ROC-AUC, average precision, Brier score, confusion counts, precision, recall and F1; null where one class is missing.

    Rows are first summed by distinct score, so ties take no window over rows. Distinct scores are summed in
    ranges, so no task holds all of them.
    """
    keys = keys or []
    y, p = F.col(label).cast("double"), F.col(probability).cast("double")
    by = df.groupBy(*keys, p.alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.sum(F.pow(p - y, 2)).alias("loss"))
    w = cumulated(by, keys)
    high = F.col("s") >= threshold
    one = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    out = w.groupBy(*keys).agg(
        (F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / F.max(F.nullif(F.col("p_all") * F.col("n_all"), F.lit(0.0)))).alias("roc_auc"),
        F.when(F.max("n_all") > 0, F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max(F.nullif(F.col("p_all"), F.lit(0.0)))).alias("average_precision"),
        (F.sum("loss") / F.sum(F.col("pos") + F.col("neg"))).alias("brier"),
        one(F.when(high, F.col("pos"))).alias("tp"), one(F.when(high, F.col("neg"))).alias("fp"), one(F.when(~high, F.col("pos"))).alias("fn"), one(F.when(~high, F.col("neg"))).alias("tn"),
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def train(df: DataFrame, features: list[str], label: str = "label", weight: str = "weight", kind: str = "boosted"):
    """A fitted pipeline of spark.ml: logistic, forest or boosted, on weighted rows without nulls in features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    common = {"labelCol": label, "weightCol": weight}
    last = {
        "logistic": lambda: LogisticRegression(featuresCol="scaled", regParam=1.0 / (0.5 * max(1, df.count())), **common),
        "forest": lambda: RandomForestClassifier(featuresCol="scaled", numTrees=50, maxDepth=2, seed=42, **common),
        "boosted": lambda: GBTClassifier(featuresCol="scaled", maxIter=35, maxDepth=3, stepSize=0.08, seed=42, **common),
    }[kind]()
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), last]).fit(df)


def fold_moments(df: DataFrame, group: str, features: list[str], label: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The folds in order with, for each one's training rows, the features' means and deviations and the weight of unlabeled rows.

    They follow from sums by group, at most FOLDS rows, so no row is looked at for each fold.
    """
    rows = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"), *(F.avg(f).alias(f"m{k}") for k, f in enumerate(features)), *(F.var_pop(f).alias(f"v{k}") for k, f in enumerate(features)))
    found = rows.orderBy(group).limit(FOLDS + 1).collect()
    if len(found) > FOLDS:
        raise ValueError(f"more than {FOLDS} groups")
    d = len(features)
    n, p = (np.array([float(r[c]) for r in found]) for c in ("n", "p"))
    m, v = (np.array([[r[f"{c}{k}"] for k in range(d)] for r in found], float).reshape(-1, d) for c in ("m", "v"))
    others = 1.0 - np.eye(len(found))
    n_train = others @ n
    mean = (others @ (n[:, None] * m)) / np.maximum(n_train, 1)[:, None]
    spread = np.array([(others[k] * n) @ (v + (m - mean[k]) ** 2) for k in range(len(found))]).reshape(-1, d) / np.maximum(n_train, 1)[:, None]
    scale = np.sqrt(spread)
    scale[scale == 0] = 1.0
    return [r[group] for r in found], mean, scale, (others @ p) / np.maximum(others @ (n - p), 1)


def _newton_sums(folds: list, mean: np.ndarray, scale: np.ndarray, unlabeled: np.ndarray, beta: np.ndarray):
    """Each partition's sums of all folds' gradients and curvatures, where a row counts in every fold but its own."""
    number = {g: k for k, g in enumerate(folds)}
    wide = beta.shape[1]

    def run(batches):
        total = np.zeros((len(folds), wide + wide * wide))
        for batch in batches:
            own = np.array([number[g] for g in batch.column(0).to_pylist()], int)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]]) if batch.num_rows else np.zeros((0, wide - 1))
            for k in range(len(folds)):
                train = own != k
                z = np.column_stack((np.ones(train.sum()), (x[train] - mean[k]) / scale[k]))
                w = np.where(y[train] == 1, 1.0, unlabeled[k])
                p = 1 / (1 + np.exp(-np.clip(z @ beta[k], -700, 700)))
                total[k, :wide] += z.T @ (w * (p - y[train]))
                total[k, wide:] += ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

    return run


def logistic_folds(df: DataFrame, group: str, features: list[str], label: str, c: float = 0.5, steps: int = 100) -> DataFrame:
    """(fold, intercept, coefficients, mean, scale): for each group a logistic model of all other rows, on inputs standardised by these.

    Positives weigh 1, unlabeled rows positives / unlabeled of the fold's training rows; ``c`` is the inverse strength of the
    squared penalty, which leaves the intercept alone. A Newton step of all folds is one pass of grouped sums over the rows.
    A null feature is an error: nothing is imputed or dropped.
    """
    on_workers(df.sparkSession)
    rows = df.select(F.col(group), F.col(label), *(F.col(f).cast("double") for f in features))
    lacking = rows.filter(reduce(or_, (F.col(x).isNull() for x in (group, label, *features))))
    if not lacking.isEmpty():
        raise ValueError("a group, label or feature is missing")
    folds, mean, scale, unlabeled = fold_moments(df, group, features, label)
    wide = len(features) + 1
    beta, penalty = np.zeros((len(folds), wide)), np.diag([0.0] + [1.0] * (wide - 1))
    for _ in range(steps if folds else 0):
        sums = rows.mapInArrow(_newton_sums(folds, mean, scale, unlabeled, beta), "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
        total = np.zeros(len(folds) * wide * (wide + 1))
        for r in sums.collect():  # folds times squared features, whatever the number of rows
            total[r["at"]] = r["value"]
        total = total.reshape(len(folds), -1)
        gradient = c * total[:, :wide] + beta @ penalty
        curve = c * total[:, wide:].reshape(-1, wide, wide) + penalty + 1e-12 * np.eye(wide)
        move = np.linalg.solve(curve, gradient[:, :, None])[:, :, 0]
        beta -= move
        if np.abs(move).max() < 1e-10:
            break
    else:
        if folds:
            raise ValueError(f"no convergence in {steps} steps")
    kind = df.schema[group].dataType.simpleString()
    data = [(f, float(b[0]), b[1:].tolist(), m.tolist(), s.tolist()) for f, b, m, s in zip(folds, beta, mean, scale)]
    return df.sparkSession.createDataFrame(data, f"fold {kind}, intercept double, coefficients array<double>, mean array<double>, scale array<double>")


def held_out_scores(df: DataFrame, folds: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Rows with ``probability`` by the model that has not seen their group; models are at most FOLDS rows."""
    joined = df.join(F.broadcast(folds.withColumnRenamed("fold", group)), group)
    inputs = F.array(*(F.col(f).cast("double") for f in features))
    terms = F.transform(F.arrays_zip(inputs.alias("x"), "coefficients", "mean", "scale"), lambda t: t["coefficients"] * (t["x"] - t["mean"]) / t["scale"])
    score = F.col("intercept") + F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return joined.withColumn("probability", 1 / (1 + F.exp(-score))).drop("intercept", "coefficients", "mean", "scale")
