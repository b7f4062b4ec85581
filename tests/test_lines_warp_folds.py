"""Simplified lines, routes of two providers, the inverse projection and warps, fits of all folds, and freshness that moves by time."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeworks.operators import geometry, lines, model, warp
from slopeworks.sources import geotiff
from slopeworks.streaming import freshness


def brute_simplified(points, tolerance):
    if len(points) < 3:
        return points
    (ax, ay), (bx, by) = points[0], points[-1]
    length = (bx - ax) ** 2 + (by - ay) ** 2

    def away(p):
        t = min(1, max(0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / length)) if length else 0
        return np.hypot(p[0] - (ax + t * (bx - ax)), p[1] - (ay + t * (by - ay)))

    far = [away(p) for p in points[1:-1]]
    k = int(np.argmax(far)) + 1
    if far[k - 1] <= tolerance:
        return [points[0], points[-1]]
    return brute_simplified(points[: k + 1], tolerance)[:-1] + brute_simplified(points[k:], tolerance)


def test_simplified_lines(spark):
    rnd = random.Random(8)
    made = [[(float(rnd.randrange(60)), float(rnd.randrange(60))) for _ in range(rnd.randrange(1, 40))] for _ in range(300)]
    made += [[(1.0, 1.0)] * 5, [(0.0, 0.0), (9.0, 40.0), (0.0, 0.0)], [(float(k), 0.0) for k in range(50_000)]]
    df = spark.createDataFrame([(k, p, "x") for k, p in enumerate(made)] + [(-1, None, "x"), (-2, [], "x")], f"id int, points {lines.POINTS}, other string")
    got = {r["id"]: None if r["points"] is None else [tuple(p) for p in r["points"]] for r in lines.simplified(df, 15.0).collect()}
    assert got.pop(-1) is None and got.pop(-2) == [] and got.pop(302) == [(0.0, 0.0), (49_999.0, 0.0)]
    assert got == {k: brute_simplified(p, 15.0) for k, p in enumerate(made[:302])}
    spiral = np.array([(k * np.cos(k), k * np.sin(k)) for k in range(20_000)])  # no depth of recursion
    assert lines.kept(spiral, 1.0).sum() > 10_000


LINE = {"type": "LineString", "coordinates": [[76.0, 11.0], [76.01, 11.0, 5.0], [76.01, 11.02]]}


def plain(geometry=LINE, distance=3000.0, duration=200, code="Ok"):
    return json.dumps({"code": code, "routes": [{"geometry": geometry, "distance": distance, "duration": duration}], "waypoints": [{"location": [76.0, 11.0]}, {"location": [76.01, 11.02]}]})


def features(**changes):
    one = {"geometry": LINE, "properties": {"summary": {"distance": 3000.0, "duration": 200}}} | changes
    return json.dumps({"type": "FeatureCollection", "features": [one, one]})


def test_routes_of_both_providers_have_one_shape(spark):
    bad = [
        ("osrm", plain(code="NoRoute"), "no_route"), ("osrm", "{}", "no_route"), ("ors", '{"features": []}', "no_route"), ("osrm", "not json", "no_route"), ("osrm", None, "no_route"), ("maps", plain(), "unknown_provider"),
        ("osrm", plain({"type": "Point", "coordinates": []}), "not_a_line"), ("osrm", plain({"type": "LineString", "coordinates": [[1, 2]]}), "too_few_points"), ("ors", features(geometry={"type": "LineString"}), "too_few_points"),
        ("osrm", plain({"type": "LineString", "coordinates": [[181, 2], [3, 4]]}), "coordinate_out_of_range"), ("osrm", plain({"type": "LineString", "coordinates": [[1], [3, 4]]}), "coordinate_out_of_range"),
        ("osrm", plain(distance=None), "no_distance_or_time"), ("ors", features(properties={}), "no_distance_or_time"), ("osrm", plain(distance=0), "not_positive"), ("ors", features(properties={"summary": {"distance": 5, "duration": -1}}), "not_positive"),
    ]
    answers = spark.createDataFrame([(k, p, b) for k, (p, b, _) in enumerate([("osrm", plain(), None), ("ors", features(), None), *bad])], "k int, provider string, body string")
    rows = lines.routes(answers, "provider").orderBy("k", "route_no").collect()
    one, two, three = rows[:3]
    assert one["points"] == two["points"] == three["points"] and [tuple(p) for p in one["points"]] == [(76.0, 11.0), (76.01, 11.0), (76.01, 11.02)]
    assert (one["distance_m"], one["duration_s"], one["snapped_origin"], two["snapped_origin"], three["route_no"]) == (3000.0, 200.0, [76.0, 11.0], None, 1)
    assert one["provider_name"].startswith("OSRM") and two["provider_name"].startswith("OpenRouteService") and not any(r["reason"] for r in rows[:3])
    assert {r["k"]: r["reason"] for r in rows[3:]} == {k: why for k, (_, _, why) in enumerate(bad, 2)}


def test_lengths_and_gaps_follow_from_the_line(spark):
    rows = spark.createDataFrame([([(76.0, 11.0), (76.01, 11.0), (76.01, 11.02)],), ([(76.0, 11.0)],), ([],)], f"points {lines.POINTS}")
    at = (F.lit(11.0), F.lit(76.001)), (F.lit(11.02), F.lit(76.01))
    got = rows.select(lines.line_length(F.col("points")), *lines.end_gaps(F.col("points"), *at)).collect()
    assert got[0][0] == pytest.approx(1091.5 + 2223.9, abs=0.5) and got[0][1] == pytest.approx(109.15, abs=0.1) and got[0][2] == 0
    assert got[1][0] == 0 and got[2][0] == 0 and got[2][1] is None


def test_inverse_projection_within_a_millimetre(spark):
    """Over the zone: the forward series leads back to where the inverse started."""
    place = spark.range(4000).select((8.0 + F.col("id") % 63).alias("lat"), (72.0 + F.floor(F.col("id") / 63) * 0.0952).alias("lon"))
    east, north = geometry.utm(F.col("lat"), F.col("lon"))
    back = place.select("lat", "lon", *(c.alias(n) for c, n in zip(warp.from_utm(east, north), ("lat2", "lon2"))))
    worst = back.agg(F.max(F.abs(F.col("lat") - F.col("lat2")) * 111_320), F.max(F.abs(F.col("lon") - F.col("lon2")) * 111_320 * F.cos(F.radians("lat")))).first()
    assert max(worst) < 1e-3


def test_warp_reads_only_the_blocks_it_needs(spark, tmp_path):
    """A plane over longitude and latitude comes back as itself on a grid of metres."""
    cells = spark.range(200 * 200).selectExpr("int(id / 200) as row", "int(id % 200) as col", "id / 200 + 3 * (id % 200) as value")
    lat, lon = 12 - (F.floor(F.col("id") / 200) + 0.5) * 0.001, 76 + (F.col("id") % 200 + 0.5) * 0.001
    cells = spark.range(200 * 200).select(F.floor(F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"), (1000 * (lat - 11) + 500 * (lon - 76)).alias("value"))
    geotiff.write(cells, str(tmp_path / "dem"), 76.0, 12.0, 0.001, dtype="float64", size=50)
    source = geotiff.on_grid(geotiff.read(spark, str(tmp_path / "dem")), 76.0, 12.0, 0.001)
    corner = spark.range(1).select(*geometry.utm(F.lit(11.95), F.lit(76.05))).first()
    target, left, top = warp.grid(spark, corner[0], corner[1] - 1500, corner[0] + 1500, corner[1], 30.0)
    assert left % 30 == 0 and top % 30 == 0 and target.count() in (50 * 50, 51 * 51, 50 * 51)
    got = warp.warped(source, target, 76.0, 12.0, 0.001)
    lat, lon = warp.from_utm(F.col("east"), F.col("north"))
    worst = got.withColumn("e", F.abs(F.col("z") - (1000 * (lat - 11) + 500 * (lon - 76)))).agg(F.max("e"), F.count("e"), F.count("*")).first()
    assert worst[0] < 1e-6 and worst[1] == worst[2] == target.count()
    assert warp.warped(source, target.filter("row < 0"), 76.0, 12.0, 0.001).collect() == []


def dense_fit(x, y, w, c):
    z = np.column_stack((np.ones(len(x)), x))
    beta, penalty = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(c * (z.T * (w * p * (1 - p))) @ z + penalty, c * z.T @ (w * (p - y)) + penalty @ beta)
    return beta


def test_all_folds_are_fitted_at_once(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3)) * [1, 40, 0.01] + [5, -300, 0]
    y = (rng.random(240) < 1 / (1 + np.exp(-(x[:, 0] - 5 + (x[:, 1] + 300) / 40)))).astype(int)
    group = [f"g{k % 6}" for k in range(240)]
    df = spark.createDataFrame([(g, int(t), *map(float, v), 1.0) for g, t, v in zip(group, y, x)], "taluk string, y int, a double, b double, c double, flat double").repartition(3)
    names = ["a", "b", "c", "flat"]
    folds = model.logistic_folds(df, "taluk", names, "y")
    got = {r["fold"]: r for r in folds.collect()}
    x = np.column_stack((x, np.ones(240)))
    for g in set(group):
        train = np.array(group) != g
        mean, scale = x[train].mean(axis=0), x[train].std(axis=0)
        scale[scale == 0] = 1
        w = np.where(y[train] == 1, 1.0, y[train].sum() / (1 - y[train]).sum())
        want = dense_fit((x[train] - mean) / scale, y[train], w, 0.5)
        assert np.allclose([got[g]["intercept"], *got[g]["coefficients"]], want, atol=1e-8) and np.allclose(got[g]["scale"], scale)
    scored = model.held_out_scores(df, folds, "taluk", names)
    first = scored.first()
    m = got[first["taluk"]]
    z = m["intercept"] + sum(b * (first[n] - mu) / s for b, n, mu, s in zip(m["coefficients"], names, m["mean"], m["scale"]))
    assert first["probability"] == pytest.approx(1 / (1 + np.exp(-z))) and scored.count() == 240
    assert model.metrics(scored, "y", "probability").first()["roc_auc"] > 0.7
    with pytest.raises(ValueError, match="missing"):
        model.logistic_folds(df.withColumn("a", F.when(F.col("a") < 5, F.col("a"))), "taluk", names, "y")
    assert model.logistic_folds(df.limit(0), "taluk", names, "y").count() == 0


def test_sensors_turn_stale_and_offline_by_time_alone(spark, tmp_path):
    """Readings that arrived almost a limit ago move on without another reading, as the batch rule says; a purge forgets."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    now, schema = time.time(), "sensor_id string, received_at timestamp, purge boolean"
    ages = {"fresh": 1, "soon stale": 580, "stale": 700, "soon offline": 1780, "offline": 5000, "late": 3, "purged": 5}
    rows = [(name, now - age, False) for name, age in ages.items()]
    put = lambda rows, mode: spark.createDataFrame(rows, "sensor_id string, t double, purge boolean").selectExpr("sensor_id", "timestamp_micros(cast(t * 1000000 as bigint)) as received_at", "purge").coalesce(1).write.mode(mode).parquet(str(tmp_path / "in"))
    put(rows, "append")
    moved = freshness.transitions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = moved.writeStream.outputMode("update").format("memory").queryName("moved").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "c")).start()
    told = lambda: [(r["sensor_id"], r["status"]) for r in spark.table("moved").orderBy("at_ms").collect()]
    try:
        until = time.time() + 120
        while len(told()) < len(ages) and time.time() < until:
            time.sleep(0.5)
        put([("late", now - 900, False), ("purged", now, True)], "append")
        while not {("soon stale", "stale"), ("soon offline", "offline")} <= set(told()) and time.time() < until:
            time.sleep(0.5)
        time.sleep(3)
        found = told()
        ages_told = {(r["sensor_id"], r["status"]): r["age_seconds"] for r in spark.table("moved").collect()}
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(found) == sorted([("fresh", "online"), ("late", "online"), ("offline", "offline"), ("purged", "online"), ("soon offline", "offline"), ("soon offline", "stale"), ("soon stale", "online"), ("soon stale", "stale"), ("stale", "stale")])
    assert 601 <= ages_told["soon stale", "stale"] < 700 and 1801 <= ages_told["soon offline", "offline"] < 1900
    assert [freshness.status_of(a, 600, 1800) for a in (0, 600, 601, 1800, 1801)] == ["online", "online", "stale", "stale", "offline"]
