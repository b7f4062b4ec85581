"""Operators on small fixtures with known answers."""

import datetime as dt
import heapq
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from slopeworks.functions import scalar as S
from slopeworks.operators import catalog, drainage, geometry, joins, model, places, quality, raster, serving, state, timeseries, warnings
from slopeworks.plans import streams
from slopeworks.sources import readers, sinks
from slopeworks.streaming import sensors


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- windows


def test_antecedent_sums_need_complete_windows(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(k), float(k + 1)) for k in range(10)]
    rows = {r["d"]: r for r in timeseries.antecedent(spark.createDataFrame([("a", *x) for x in days], "k string, d date, v double"), ["k"], "d", "v").collect()}
    assert rows[dt.date(2024, 1, 2)]["sum_3d"] is None and rows[dt.date(2024, 1, 3)]["sum_3d"] == 6
    assert rows[dt.date(2024, 1, 6)]["sum_7d"] is None and rows[dt.date(2024, 1, 7)]["sum_7d"] == 28


def test_missing_and_nan_values_leave_sums_null(spark):
    days = [("a", dt.date(2024, 1, 1) + dt.timedelta(k), float("nan") if k == 3 else None if k == 8 else 1.0) for k in range(12)]
    rows = timeseries.antecedent(spark.createDataFrame(days, "k string, d date, v double"), ["k"], "d", "v").orderBy("d").collect()
    assert [r["sum_3d"] for r in rows] == [None, None, 3, None, None, None, 3, 3, None, None, None, 3]


def test_min_max_of_a_constant_is_null(spark):
    rows = timeseries.min_max(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"], strict=False).orderBy("a").collect()
    assert [(r["a_norm"], r["b_norm"]) for r in rows] == [(0, None), (1, None)]


# --- joins and quality


def test_joins_fail_loudly(spark):
    left = spark.createDataFrame([("A",), ("B",)], "k string")
    right = spark.createDataFrame([("A", 1)], "k string, v int")
    with pytest.raises(joins.CardinalityError, match="unmatched"):
        joins.one_to_one(left, right, ["k"])
    with pytest.raises(joins.CardinalityError, match="duplicate"):
        joins.many_to_one(left, right.union(right), ["k"])
    assert joins.coverage(left, right, "k").first().asDict() == {"n_left": 2, "n_matched": 1, "n_left_only": 1, "n_right_only": 0}


def test_regression_differences_take_nulls_and_nan_as_equal(spark):
    old = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0), (4, 1.0)], "k int, v double")
    new = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0 + 1e-13), (4, 1.1), (5, 0.0)], "k int, v double")
    assert sorted(r["k"] for r in joins.regression_differences(new, old, ["k"], ["v"]).collect()) == [4, 5]


def test_rules_report_every_violation(spark):
    rows = spark.createDataFrame([("S1", "x", 10.0, 76.0), (" S2", "", 95.0, float("nan"))], "settlement_id string, settlement_name string, latitude double, longitude double")
    bad = quality.check(rows, quality.settlement_rules()).collect()
    assert [sorted(r["violations"]) for r in bad] == [["latitude_in_range", "longitude_in_range", "settlement_id_not_blank", "settlement_name_not_blank"]]
    assert one(spark, quality.outside(F.lit(float("nan")), 0, 1).alias("x"))["x"]


# --- scalars


@pytest.mark.parametrize(("text", "code"), [("587.0", "587"), ("1.5", None), ("-1", None), ("", None), ("abc", None), (" 42 ", "42")])
def test_canonical_code(spark, text, code):
    assert one(spark, S.canonical_code(F.lit(text)).alias("x"))["x"] == code


@pytest.mark.parametrize(
    ("raw", "category", "served"),
    [("NA", "na", "na"), ("2019", "year_only", "year_only"), ("October 2014", "ambiguous", "ambiguous"), ("02 November 2013, October 2014", "ambiguous", "ambiguous"), ("27 May 2025", "explicit_date", "explicit"), ("2026-01-12", "explicit_date", "explicit"), ("31 February 2024", "ambiguous", "ambiguous"), ("na", "ambiguous", "na")],
)
def test_history_categories(spark, raw, category, served):
    parsed = S.strict_date(F.lit(raw))
    got = one(spark, S.history_category(F.lit(raw), parsed).alias("a"), S.history_category_served(F.lit(raw), parsed).alias("b"))
    assert (got["a"], got["b"]) == (category, served)


def test_strict_date_reads_ordinals_and_times(spark):
    assert one(spark, S.strict_date(F.lit("3rd august 2019 at 5 pm")).alias("x"))["x"] == "2019-08-03"


def test_rounding_is_that_of_scaled_values(spark):
    assert one(spark, S.rint_at(F.lit(2.345), 2).alias("x"))["x"] == 2.35


@pytest.mark.parametrize(("age", "expected"), [(600, "online"), (601, "stale"), (1800, "stale"), (1801, "offline")])
def test_freshness_boundaries(spark, age, expected):
    now = dt.datetime(2024, 1, 1, 12)
    got = one(spark, S.freshness(F.lit(now - dt.timedelta(seconds=age)), F.lit(now)).alias("x"), S.freshness(F.lit(None).cast("timestamp"), F.lit(now)).alias("none"))
    assert (got["x"], got["none"]) == (expected, "no_data")


@pytest.mark.parametrize(("value", "expected"), [(59.999, "normal"), (60.0, "elevated"), (79.999, "elevated"), (80.0, "high"), (None, None), (-0.1, None), (100.1, None), (float("nan"), None)])
def test_moisture_alert(spark, value, expected):
    got = one(spark, S.moisture_alert(F.lit(value).cast("double")).alias("x"), S.moisture_alert(F.lit(86.0), F.lit("offline")).alias("off"))
    assert (got["x"], got["off"]) == (expected, None)


def test_fragments_and_coordinates(spark):
    got = one(spark, S.join_fragments(F.array(F.lit("Upper-"), F.lit("side a"), F.lit("bove"), F.lit("Road"))).alias("x"), S.last_coordinates(F.lit("x 11.5 76.5 y 11.25 76.75 z")).alias("c"))
    assert got["x"] == "Upper-side above Road" and tuple(got["c"]) == (11.25, 76.75)


def test_coordinate_status(spark):
    extent = (11.0, 76.0, 12.0, 77.0)
    status = lambda a, b: one(spark, S.coordinate_status(F.lit(a), F.lit(b), extent).alias("x"))["x"]
    assert [status("", "76"), status("x", "76"), status("95", "76"), status("0", "0"), status("11.5", "76.5"), status("13", "76.5")] == ["missing", "invalid", "invalid", "needs_review", "valid", "outside_study_extent"]


# --- state and warnings


def test_changes_keep_first_and_differences_only(spark):
    rows = spark.createDataFrame([("v", k, s) for k, s in enumerate(["A", "A", "B", None, None, "A"])], "k string, t int, s string")
    assert [r["t"] for r in state.changes(rows, ["k"], ["t"], ["s"]).orderBy("t").collect()] == [0, 2, 3, 5]


CASES = [
    (30.0, 1.0, "scenario", None, None, "green"), (60.0, 1.0, "scenario", None, None, "yellow"), (60.0, 1.5, "scenario", None, None, "orange"), (80.0, 2.0, "scenario", None, None, "red"),
    (80.0, 1.5, "scenario", 80.0, "online", "red"), (70.0, 1.0, "scenario", 95.0, "stale", "yellow"), (70.0, 1.0, "scenario", 95.0, "offline", "yellow"), (70.0, None, "current", 75.0, "online", "orange"),
    (59.9, 1.5, "scenario", None, None, "yellow"), (30.0, 1.0, "scenario", 100.0, "online", "green"), (None, 1.5, "scenario", None, None, "yellow"),
]


@pytest.mark.parametrize("case", CASES)
def test_warning_cases(spark, case):
    rows = spark.createDataFrame([(*case[:5], 0)], "score double, multiplier double, mode string, moisture double, freshness string, linked_events long")
    got = warnings.evaluate(rows).first()
    assert got["stage"] == case[5] and got["status"] == ("unavailable" if case[0] is None else "available")
    assert (warnings.MISSING["rainfall"] in got["missing_inputs"]) == (case[2] == "current") and (warnings.MISSING["score"] in got["missing_inputs"]) == (case[0] is None)
    assert [f["type"] for f in got["factors"]] == ["susceptibility", "rainfall", "soil_moisture", "hydrology", "historical_evidence"]


# --- geometry

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
HOLE = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6), (0.4, 0.4)]


def polygons(spark, *rows):
    return spark.createDataFrame([(c, [(shell, holes)]) for c, shell, holes in rows], f"code string, parts {geometry.PARTS}")


def test_strict_linkage(spark):
    shifted = [(x + 0.8, y) for x, y in SQUARE]
    shapes = polygons(spark, ("a", SQUARE, [HOLE]), ("b", shifted, []))
    points = spark.createDataFrame([(1, 0.2, 0.2), (2, 5.0, 5.0), (3, 0.5, 0.5), (4, 0.4, 0.5), (5, 0.9, 0.5), (6, 0.0, 0.5), (7, 1.5, 0.5)], "id int, x double, y double")
    got = {r["id"]: (r["match_status"], r["code"]) for r in geometry.link_points(points, shapes, "id", "code", 0.5).collect()}
    no = ("NO_MATCH", None)
    vague = ("AMBIGUOUS", None)
    assert got == {1: ("EXACT", "a"), 2: no, 3: no, 4: vague, 5: vague, 6: vague, 7: ("EXACT", "b")}


def test_nearest_axis_ties_go_up(spark):
    got = one(spark, geometry.nearest_axis(F.lit(10.5), [10, 11]).alias("a"), geometry.nearest_axis(F.lit(10.4), [10, 11]).alias("b"), S.snap(F.lit(76.5), 1.0).alias("c"))
    assert (got["a"], got["b"], got["c"]) == (11, 10, 77)


def test_nearest_site_is_the_brute_force_one(spark):
    import math
    import random

    rnd = random.Random(3)
    points = [(k, rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for k in range(40)]
    sites = [(k, rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for k in range(15)]

    def km(a, b):
        la, lb, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[2] - a[2])
        return 2 * 6371 * math.asin(math.sqrt(min(1, math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(d / 2) ** 2)))

    got = geometry.nearest_sites(spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(sites, "s int, lat double, lon double"), "p", "s").collect()
    assert {r["p"]: r["nearest_id"] for r in got} == {p[0]: min(sites, key=lambda s: km(p, s))[0] for p in points}


def test_utm_of_a_known_place(spark):
    got = one(spark, *(c.alias(n) for c, n in zip(geometry.utm(F.lit(11.4), F.lit(76.7)), "en")))
    assert abs(got["e"] - 685518) < 50 and abs(got["n"] - 1260709) < 200


# --- rasters


def grid(spark, values):
    return spark.createDataFrame([(r, c, None if z is None else float(z)) for r, row in enumerate(values) for c, z in enumerate(row)], "row int, col int, z double")


def priority_flood(values):
    n, m = len(values), len(values[0])
    out = {(r, c): values[r][c] for r in range(n) for c in range(m) if r in (0, n - 1) or c in (0, m - 1)}
    heap = [(z, k) for k, z in out.items()]
    heapq.heapify(heap)
    while heap:
        f, (r, c) = heapq.heappop(heap)
        for k in ((r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if 0 <= k[0] < n and 0 <= k[1] < m and k not in out:
                out[k] = max(f, values[k[0]][k[1]])
                heapq.heappush(heap, (out[k], k))
    return out


def test_fill_over_many_tiles_is_a_priority_flood(spark):
    import random

    rnd = random.Random(1)
    values = [[rnd.randrange(50) for _ in range(20)] for _ in range(20)]
    got = {(r["row"], r["col"]): r["filled"] for r in drainage.fill_depressions(grid(spark, values), tile=6).collect()}
    assert got == priority_flood(values)


def test_ramp_flows_east(spark):
    cells = raster.d8_direction(grid(spark, [[7 - c for c in range(7)] for _ in range(7)]))
    down = raster.downstream(cells).selectExpr("row * 10 + col as node", "to_row * 10 + to_col as down")
    nodes = cells.selectExpr("row * 10 + col as node").join(down, "node", "left")
    acc = {r["node"]: r["accumulation"] for r in raster.accumulate(nodes).collect()}
    assert len(acc) == 49 and min(acc.values()) == 1 and all(acc[r * 10 + 6] >= 6 for r in range(1, 6))


def test_accumulation_of_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        raster.accumulate(spark.createDataFrame([(1, 2), (2, 1)], "node int, down int"))


def test_streams_are_cut_at_junctions(spark):
    # 1 -> 2 -> 3 and 4 -> 3, then 3 -> 5 -> 6
    nodes = spark.createDataFrame([(1, 2, True), (2, 3, True), (4, 3, True), (3, 5, True), (5, 6, True), (6, None, True)], "node int, down int, is_stream boolean")
    assert {r["segment"]: r["nodes"] for r in raster.stream_segments(nodes).collect()} == {1: [1, 2, 3], 4: [4, 3], 3: [3, 5, 6]}


def test_mosaic_takes_the_first_value(spark):
    tiles = spark.createDataFrame([(0, 0, None, 0), (0, 0, 5.0, 1), (0, 1, 1.0, 0), (0, 1, 2.0, 1)], "row int, col int, z double, tile_order int")
    assert {r["col"]: r["z"] for r in raster.mosaic(tiles).collect()} == {0: 5.0, 1: 1.0}


def test_stream_threshold():
    assert [raster.stream_threshold(None, "128"), raster.stream_threshold(256, "128"), raster.stream_threshold()] == [128, 256, 1000]
    with pytest.raises(ValueError):
        raster.stream_threshold("invalid")


# --- audits


def test_temporal_status_of_explicit_dates_only(spark):
    days = ["2024-07-01", "", " ", None, "2023-11-23", "2024-02-31", "2019", "2024-07-02"]
    events = spark.createDataFrame(list(enumerate(days)), "serial int, reported_history_date string")
    got = timeseries.temporal_status(events, spark.sql("select explode(array(date'2024-07-01', date'2024-07-01')) as date")).orderBy("serial").collect()
    unknown, absent = "EVENT_DATE_UNKNOWN", "RAINFALL_DATE_NOT_AVAILABLE"
    assert [r["temporal_status"] for r in got] == ["RAINFALL_DATE_AVAILABLE", unknown, unknown, unknown, absent, unknown, unknown, absent]
    assert [r["rainfall_year_available"] for r in got] == [True] + [False] * 6 + [True]
    assert [r["event_year"] for r in got] == [2024, None, None, None, 2023, None, None, 2024]


def test_polygons_of_another_subdistrict_are_rejected(spark):
    villages = spark.createDataFrame([("100", "587", "5756")], "village_lgd_code string, district_lgd_code string, taluk_lgd_code string")
    square = [([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)], [])]
    rows = [("100", "587", "5756", square), ("100", "587", "999", square), ("100", "1", "5756", square * 2), ("7", "587", "5756", None)]
    shapes = spark.createDataFrame(rows, f"vlcode string, dtcode string, sdcode string, parts {geometry.PARTS}")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0)], "id int, x double, y double")
    got = geometry.link_points(points, geometry.exact_code_polygons(shapes, villages), "id", "vlcode")
    assert {r["id"]: (r["match_status"], r["vlcode"]) for r in got.collect()} == {1: ("EXACT", "100"), 2: ("NO_MATCH", None)}
    assert tuple(geometry.geometry_summary(shapes, F.lit(True)).first()) == (4, 3, 1, 1, 4)


def test_unproven_shelters_are_to_review(spark):
    names = "shelter_id name type village_lgd_code taluk latitude longitude address capacity contact source last_updated verification_status verified_at operational_status".split()
    villages = spark.createDataFrame([("1", "V", "T")], "village_lgd_code string, village_name_en string, taluk_name_en string")
    proven = dict.fromkeys(names) | {"shelter_id": "a", "village_lgd_code": "1", "latitude": "11.4", "longitude": "76.7", "capacity": "20", "source": "s", "verification_status": " Verified", "verified_at": "2025-01-01", "operational_status": "operational"}
    run = lambda *rows, extent=(11.0, 76.0, 12.0, 77.0): quality.shelters(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names)), villages, extent)
    others = [proven | {"shelter_id": c} | change for c, change in zip("bcdef", ({"source": " "}, {"verified_at": None}, {"latitude": ""}, {"latitude": "13"}, {"verification_status": None, "operational_status": ""}))]
    got = {r["shelter_id"]: r for r in run(proven, *others).collect()}
    assert {k: r["verification_status"] for k, r in got.items()} == {"a": "verified"} | dict.fromkeys("bcdef", "needs_review")
    assert [k for k, r in got.items() if r["operational"]] == ["a"] and (got["a"]["village"], got["a"]["taluk"], got["a"]["capacity"]) == ("V", "T", 20)
    assert run(proven, extent=None).first()["verification_status"] == "needs_review"
    for wrong in ({"shelter_id": " "}, {"verification_status": "maybe"}, {"operational_status": "x"}, {"capacity": "many"}):
        with pytest.raises(joins.CardinalityError):
            run(proven | wrong)
    with pytest.raises(joins.CardinalityError):
        run(proven, proven)


# --- models, serving, catalog


def test_single_class_metrics_are_null(spark):
    got = model.metrics(spark.createDataFrame([(1, 0.9), (1, 0.2)], "y int, p double"), "y", "p").first()
    assert got["roc_auc"] is None and got["average_precision"] is None and got["tp"] == 1


def test_metrics_sum_scores_in_ranges(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), float(rnd.random() < 0.4), rnd.choice([rnd.random(), 0.25, 0.5])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, y double, p double")
    by = df.groupBy(F.col("p").alias("s")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    assert model.cumulated(by, []).select("_range").distinct().count() > 1
    for keys in ([], ["k"]):
        got = {r[keys[0]] if keys else 0: r for r in model.metrics(df, "y", "p", keys).collect()}
        assert len(got) == (3 if keys else 1)
        for k, r in got.items():
            part = [x[1:] for x in rows if not keys or x[0] == k]
            pos, neg = [p for y, p in part if y], [p for y, p in part if not y]
            auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
            ap = sum(sum(q >= p for q in pos) / sum(q >= p for _, q in part) for p in pos) / len(pos)
            assert r["roc_auc"] == pytest.approx(auc) and r["average_precision"] == pytest.approx(ap)


def test_training_separates_classes(spark):
    rows = spark.createDataFrame([(float(k % 2), float(k % 2) + 0.1 * k, 1.0) for k in range(20)], "label double, x double, weight double")
    for kind in ("logistic", "forest"):
        assert model.train(rows, ["x"], kind=kind).transform(rows).count() == 20


def test_ranking_puts_missing_scores_last(spark):
    rows = spark.createDataFrame([("Beta", 20.0), ("Alpha", 80.0), ("Gamma", None)], "name string, score double")
    order = lambda d: [r["name"] for r in serving.ranked(rows, serving.order_by_score("score", d)).orderBy("position").collect()]
    assert order(True) == ["Alpha", "Beta", "Gamma"] and order(False) == ["Beta", "Alpha", "Gamma"]


def test_catalog_status(spark):
    rows = catalog.catalog(spark, [("a", "A", "observed", False, ["x.csv"]), ("b", "B", "observed", False, ["y.csv"]), ("c", "C", "planned", True, [])])
    assert {r["source_id"]: r["status"] for r in catalog.availability(rows, {"x.csv"}).collect()} == {"a": "available", "b": "unavailable", "c": "planned"}


# --- sources, sinks, streams


def test_streams_come_from_files_and_not_from_the_driver(spark, sf_dir):
    for query in streams.QUERIES.values():
        assert query(spark, sf_dir).inputFiles()


def test_an_empty_stream_has_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k long, v long").parquet(str(tmp_path / "in"))
    assert sensors.run_to_end(stream, str(tmp_path / "a"), "append").count() == 0
    assert sensors.run_to_end(stream.groupBy("k").count(), str(tmp_path / "b"), "complete").count() == 0


def test_csv_keeps_literals_and_drops_the_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿code,name\nNA,\n001,x\n", encoding="utf-8")
    rows = readers.csv_text(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["code", "name"] and sorted(map(tuple, rows.collect())) == [("001", "x"), ("NA", "")]


def test_publish_and_refuse(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0)], "k int, v double")
    sinks.publish({"t": df}, str(tmp_path / "out"))
    sinks.publish({"t": df.union(df)}, str(tmp_path / "out"))
    assert sinks.read_published(spark, str(tmp_path / "out"), "t").count() == 2
    df.write.parquet(str(tmp_path / "there"))
    with pytest.raises(Exception, match="exist"):
        sinks.refuse_overwrite(df, str(tmp_path / "there"))
    with pytest.raises(joins.CardinalityError):
        sinks.publish_if_unchanged(df.withColumn("v", F.col("v") + 1), df, str(tmp_path / "new"), ["k"], ["v"])
    sinks.write_provenance(spark, {"b": 1, "a": 2}, str(tmp_path / "p.json"))
    assert json.loads((tmp_path / "p.json").read_text()) == {"a": 2, "b": 1}


def test_quarantine_reasons(spark):
    known = spark.createDataFrame([("S", "1", True)], "sensor_id string, village_lgd_code string, is_test boolean")
    rows = spark.createDataFrame([("X", "1", None, 5.0), ("S", "2", None, 5.0), ("S", "1", False, 5.0), ("S", "1", None, 100.1), ("S", "1", None, 50.0)], "sensor_id string, village_lgd_code string, is_test boolean, soil_moisture_percent double")
    got = sensors.enrich(rows.withColumn("raw_value", F.lit(1)), known)
    assert sorted(str(r["reason"]) for r in got.collect()) == ["None", "percent_out_of_range", "test_flag_mismatch", "unknown_sensor", "village_mismatch"]


def test_leave_one_group_out_weights(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 0), ("b", 0)], "g string, y int")
    got = model.leave_one_group_out(rows, "g", "y").filter("not is_test and y = 0").select("fold", "weight").distinct().collect()
    assert {r["fold"]: r["weight"] for r in got} == {"a": 0.5, "b": 1.0}


def test_registrations(spark):
    old = spark.createDataFrame([("S", "1", False)], "sensor_id string, village_lgd_code string, is_test boolean")
    new = spark.createDataFrame([("S", "1", False), ("T", None, False), ("U", None, True)], old.schema)
    good, bad = sensors.registrations(new, old)
    assert [r["sensor_id"] for r in good.collect()] == ["U"] and {r["sensor_id"]: r["reason"] for r in bad.collect()} == {"S": "duplicate", "T": "village_required"}


def test_overlapping_polygons(spark):
    shapes = polygons(spark, ("a", SQUARE, []), ("b", [(x + 0.5, y) for x, y in SQUARE], []), ("c", [(x + 1.0, y) for x, y in SQUARE], []), ("d", SQUARE, []))
    got = {(r["a"], r["b"]): round(r["area"], 9) for r in geometry.overlaps(shapes, "code").collect()}
    assert got == {("a", "b"): 0.5, ("b", "c"): 0.5, ("a", "d"): 1.0, ("b", "d"): 0.5}


# --- what fails, and odd inputs


def test_min_max_refuses_constants_and_what_is_not_finite(spark):
    for values in ([(1.0,), (1.0,)], [(1.0,), (float("nan"),)], [(1.0,), (None,)], [(1.0,), (float("inf"),)]):
        with pytest.raises(Exception, match="constant or not finite"):
            timeseries.min_max(spark.createDataFrame(values, "a double"), ["a"]).collect()
    assert timeseries.min_max(spark.createDataFrame([], "a double"), ["a"]).count() == 0


def test_unsupported_place_has_no_stage(spark):
    rows = spark.createDataFrame([(90.0, 2.0, "scenario", False)], "score double, multiplier double, mode string, supported boolean")
    got = warnings.evaluate(rows).first()
    assert (got["status"], got["stage"], got["factors"], got["missing_inputs"]) == ("unavailable", None, None, [warnings.MISSING["coverage"]])


def test_unknown_route_status_comes_last(spark):
    rows = spark.createDataFrame([(1, "unheard"), (2, None), (3, "high_risk"), (4, "preferred")], "id int, status string")
    for c in ("n_red", "n_orange", "n_high", "n_events", "distance_m", "duration_s"):
        rows = rows.withColumn(c, F.lit(0))
    got = [r["id"] for r in serving.ranked(rows, [*serving.route_order(), F.asc("id")]).orderBy("position").collect()]
    assert got == [4, 3, 1, 2]


def test_ranks_over_ranges_have_no_gaps(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(37)).alias("s"), "id")
    got = serving.ranked(rows, [F.desc("s"), F.asc("id")]).orderBy("position").collect()
    assert [(-r["s"], r["id"]) for r in got] == sorted((-r["s"], r["id"]) for r in got) and [r["position"] for r in got] == list(range(1, 1001))


def test_coverage_is_refused_with_the_keys(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(joins.CardinalityError, match="unmatched keys"):
        joins.require_coverage(left, spark.createDataFrame([(1, 1.0)], "k int, x double"), "k", ["x"])
    with pytest.raises(joins.CardinalityError, match="null"):
        joins.require_coverage(left, spark.createDataFrame([(1, 1.0), (2, None)], "k int, x double"), "k", ["x"])


def test_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(model, "FOLDS", 2)
    with pytest.raises(ValueError, match="groups"):
        model.leave_one_group_out(spark.createDataFrame([(g, 1) for g in "abc"], "g string, y int"), "g", "y")


def test_folds_with_a_fitted_model(spark):
    rows = spark.createDataFrame([("abc"[k % 3], k % 2, float(k % 2) + k / 100) for k in range(60)], "g string, label int, x double")
    splits = model.leave_one_group_out(rows, "g", "label")

    def fit(training):
        fitted = model.train(training, ["x"], kind="logistic")
        return lambda test: fitted.transform(test).withColumn("probability", F.col("probability").cast("string")).withColumn("probability", F.col("prediction"))

    by_fold, pooled = model.evaluate_folds(splits, "label", fit)
    assert by_fold.count() == 3 and pooled.first()["roc_auc"] == 1.0


def test_training_table_refuses_gaps(spark):
    terrain = spark.createDataFrame([("1", 1.0, 0.0, 2.0, 3.0, 4.0)], "village_lgd_code string, elevation_mean_m double, elevation_min_m double, elevation_max_m double, slope_mean_deg double, slope_max_deg double")
    days = spark.createDataFrame([("1", 1.0, 2.0, None)], "village_lgd_code string, rainfall_1d_mm double, rainfall_3d_mm double, rainfall_7d_mm double")
    evidence = spark.createDataFrame([("1", 0)], f"village_lgd_code string, {model.TARGET} long")
    master = spark.createDataFrame([("1", "t")], "village_lgd_code string, taluk_name_en string")
    hydrology = spark.createDataFrame([("1", 1.0, 2.0, 0.5, 0.1)], "village_lgd_code string, " + ", ".join(f"{c} double" for c in model.HYDROLOGY))
    with pytest.raises(joins.CardinalityError, match="null"):
        model.training_table(terrain, days, evidence, master, hydrology)
    full = model.training_table(terrain, days.withColumn("rainfall_7d_mm", F.lit(3.0)), evidence, master, hydrology).first()
    assert (full["elevation_range_m"], full["label_s"], full["pu_status"]) == (2.0, 0, "UNLABELED")


def test_samples_are_refused_with_their_ids(spark):
    cells = spark.createDataFrame([(0, 0, 5.0), (0, 1, float("nan"))], "row int, col int, z double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, -0.1, 0.5)], "id int, x double, y double")
    rows = places.sample(points, cells, 0.0, 1.0, 1.0, 1, 2, ["z"])
    assert {r["id"]: r["sample_status"] for r in rows.collect()} == {1: "sampled", 2: "nodata", 3: "outside"}
    with pytest.raises(joins.CardinalityError):
        places.require_samples(rows, "id")


def test_ingest_of_odd_bodies(spark):
    bodies = ["", "[]", "null", '{"sensor_id":"a","soil_moisture_percent":"x"}', '{"sensor_id":"a","soil_moisture_percent":50,"raw_value":-1}', '{"sensor_id":"a","soil_moisture_percent":50}', None]
    got = [r["reason"] for r in sensors.parsed(spark.createDataFrame(list(enumerate(bodies)), "k int, body string"), "body").orderBy("k").collect()]
    assert got == ["malformed", "malformed", "malformed", "percent_out_of_range", "raw_out_of_range", None, "malformed"]


def test_fill_of_odd_rasters(spark):
    """No cell, a single cell, a hole in the middle as an outlet, and a pit behind a wall that several tiles share."""
    assert drainage.fill_depressions(grid(spark, [[1]]).limit(0)).count() == 0
    assert [r["filled"] for r in drainage.fill_depressions(grid(spark, [[7]])).collect()] == [7.0]
    values = [[9] * 7 for _ in range(7)]
    values[3][3], values[3][2] = None, 1
    got = {(r["row"], r["col"]): r["filled"] for r in drainage.fill_depressions(grid(spark, values), tile=3).collect()}
    assert got[3, 2] == 1 and (3, 3) not in got and got[1, 1] == 9
    wall = [[5] * 13] + [[5] + [1] * 11 + [5] for _ in range(11)] + [[5] * 6 + [3] + [5] * 6]
    got = {(r["row"], r["col"]): r["filled"] for r in drainage.fill_depressions(grid(spark, wall), tile=4).collect()}
    assert got[1, 1] == got[11, 11] == 3 and got[0, 0] == 5


def test_points_at_just_a_route_s_width(spark):
    """All but one are 50 from the route; SQL's rounding takes some and leaves others, and the first one's square lies half way between two numbers."""
    values = "(0, 44.0, 142.0), (1, 2.0, 86.0), (2, 5.0, 90.0), (3, 8.0, 94.0), (4, -30.0, -40.0), (5, 11.0, 98.0), (6, 0.0, 84.0)"
    with duckdb.connect() as con:
        found = con.execute(f"""with p as (select k, x::double as x, y::double as y from (values {values}) v(k, x, y)), d as (select *, greatest(0.0, least(1.0, (x * 300 + y * 400) / 250000)) as t from p)
        select k from d where sqrt(pow(x - t * 300, 2) + pow(y - t * 400, 2)) <= 50""").fetchall()
    points = spark.sql(f"select k, cast(x as double) as x, cast(y as double) as y from values {values} as v(k, x, y)")
    route = spark.createDataFrame([(0, 0.0, 0.0, 300.0, 400.0)], "route int, x1 double, y1 double, x2 double, y2 double")
    near = {r["k"] for r in geometry.near_routes(points, route, "k", "route", 50.0).collect()}
    assert 0 in near and 6 not in near and near == {k for (k,) in found}
