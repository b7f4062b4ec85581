"""Functions that no query uses: readers, writers, reports and streaming sinks."""

import datetime as dt
import math
import time

import pytest
from pyspark.sql import functions as F

from slopeworks import runtime
from slopeworks.functions import scalar
from slopeworks.operators import raster, state, timeseries
from slopeworks.sources import readers, sinks
from slopeworks.streaming import sensors


def cube(spark, days, cells=((10.0, 76.0), (11.0, 77.0))):
    return spark.createDataFrame([(d, lat, lon, 1.0) for d in days for lat, lon in cells], "date date, lat double, lon double, mm double")


def test_rainfall_cubes_are_checked_whole(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(k) for k in range(365)]
    checks = lambda df, unit="mm": readers.rainfall_cube_checks(df, 2023, unit).first().asDict()
    good = {"covers_year": True, "unique_cells": True, "dense": True, "axes_in_range": True, "unit_is_mm": True}
    assert checks(cube(spark, days)) == good and checks(cube(spark, days), "cm") == good | {"unit_is_mm": False} and not checks(cube(spark, days), None)["unit_is_mm"]
    assert not checks(cube(spark, days[:-1]))["covers_year"]
    assert not checks(cube(spark, [*days, days[0]]))["unique_cells"]
    assert not checks(cube(spark, days).filter("not (date = date'2023-03-01' and lat = 10)"))["dense"]
    assert not checks(cube(spark, days, ((10.0, 76.0), (95.0, 77.0))))["axes_in_range"]
    assert not readers.rainfall_cube_checks(cube(spark, []), 2024).first()["axes_in_range"]


def test_inventory_rows_join_their_continuations(spark):
    lines = [(693, 1, "Sl No  State"), (693, 2, "  1  Hill slide"), (693, 3, "     on the road"), (693, 4, " 12  Other"), (694, 1, "  left over"), (694, 2, "13 Third"), (720, 1, "14 Later")]
    df = spark.createDataFrame(lines, "page int, line int, value string")
    got = {(r["page"], r["serial"]): r["row_text"] for r in readers.inventory_rows(df, pages=(693, 717)).collect()}
    assert got == {(693, 1): "  1  Hill slide\n     on the road", (693, 12): " 12  Other", (694, 13): "13 Third"}
    assert readers.inventory_rows(df).count() == 4


def test_files_by_pattern(spark, tmp_path):
    for name in ("b.nc", "a.nc", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert [(r["path"].rsplit("/", 1)[1], bytes(r["content"])) for r in readers.files(spark, str(tmp_path), "*.nc").collect()] == [("a.nc", b"a.nc"), ("b.nc", b"b.nc")]
    with pytest.raises(FileNotFoundError, match="no \\*.kmz"):
        readers.files(spark, str(tmp_path), "*.kmz")


def test_purged_tables_hold_no_test_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, is_test boolean")
    sinks.purge(rows, "is_test", str(tmp_path / "out"))
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]


def test_reports_and_previews(spark):
    report = sinks.markdown_report("Counts", spark.createDataFrame([(5, None)], "rows int, missing int"))
    assert report == "# Counts\n\n| measure | value |\n| --- | --- |\n| rows | 5 |\n| missing | None |\n"
    cells = spark.createDataFrame([(k, a) for k, a in enumerate([None, 10, 100, 1000, 10_000, 999_999])], "k int, accumulation long")
    assert [r["alpha"] for r in sinks.preview_rgba(cells, 100, 10_000).orderBy("k").collect()] == [0, 0, 75, 158, 240, 240]


def test_metre_steps_follow_the_latitude(spark):
    east, north = raster.metre_steps(F.lit(60.0), 0.001)
    assert tuple(spark.range(1).select(east, north).first()) == pytest.approx((111.32 * math.cos(math.radians(60)), 110.574))
    plane = spark.range(25).selectExpr("int(id / 5) as row", "int(id % 5) as col", "double(id % 5) * 55.66 as z")
    slopes = raster.slope_degrees(plane, *raster.metre_steps(F.lit(60.0), 0.001)).collect()
    assert all(r["slope_deg"] == pytest.approx(45.0) for r in slopes)


def test_missing_days_are_filled_between_ends(spark):
    day = dt.date
    df = spark.createDataFrame([("a", day(2024, 2, 27), 1), ("a", day(2024, 3, 1), 2), ("b", day(2024, 2, 28), 3)], "k string, d date, v int")
    assert [tuple(r) for r in timeseries.densify(df, ["k"], "d").orderBy("k", "d").collect()] == [("a", day(2024, 2, 27), 1), ("a", day(2024, 2, 28), None), ("a", day(2024, 2, 29), None), ("a", day(2024, 3, 1), 2), ("b", day(2024, 2, 28), 3)]
    whole = timeseries.densify(df, ["k"], "d", F.lit("2024-02-26").cast("date"), F.lit("2024-03-02").cast("date"))
    assert whole.groupBy("k").count().collect()[0]["count"] == 6 and whole.filter("v is not null").count() == 3


def test_freshness_of_rows(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    rows = spark.createDataFrame([(k, s) for k, s in enumerate([0, 600, 601, 1800, 1801, None, -5])], "k int, s int").withColumn("at", F.timestamp_add("SECOND", -F.col("s"), now))
    got = {r["k"]: (r["age_s"], r["freshness"]) for r in state.with_freshness(rows, "at", now).collect()}
    assert got == {0: (0, "online"), 1: (600, "online"), 2: (601, "stale"), 3: (1800, "stale"), 4: (1801, "offline"), 5: (None, "no_data"), 6: (0, "online")}


def test_batches_are_split_into_good_and_quarantined(spark, tmp_path):
    batch = spark.createDataFrame([(1, None), (2, "unknown_sensor"), (3, None)], "k int, reason string")
    for number in (0, 1):
        sensors.write_split(batch, number, str(tmp_path / "good"), str(tmp_path / "bad"))
    good, bad = (spark.read.parquet(str(tmp_path / n)) for n in ("good", "bad"))
    assert good.columns == ["k"] and good.count() == 4 and {tuple(r) for r in bad.collect()} == {(2, "unknown_sensor")}


def test_polling_picks_up_new_rows(spark, tmp_path):
    put = lambda k: spark.createDataFrame([(k,)], "k int").write.mode("append").parquet(str(tmp_path / "in"))
    put(1)
    query = sensors.polled(spark.readStream.schema("k int").parquet(str(tmp_path / "in")), str(tmp_path / "out"), "1 second")
    try:
        put(2)
        until = time.time() + 60
        found = []
        while len(found) < 2 and time.time() < until:
            time.sleep(0.5)
            if (tmp_path / "out/rows/_spark_metadata").exists():
                found = spark.read.parquet(str(tmp_path / "out/rows")).collect()
    finally:
        query.stop()
    assert sorted(r["k"] for r in found) == [1, 2]


def test_missing_values_have_no_distance_and_no_moisture(spark):
    nothing, one = F.lit(None).cast("double"), F.lit(1.0)
    row = spark.range(1).select(scalar.haversine_km(one, one, nothing, one).alias("d"), scalar.device_moisture(F.lit(None).cast("int")).alias("m"), scalar.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half")).first()
    assert row["d"] is None and row["m"] is None and row["half"] == pytest.approx(math.pi * scalar.EARTH_KM)


def test_settled_tables_are_kept_until_they_are_forgotten(spark):
    df = runtime.settled(spark.range(5).withColumn("x", F.rand()))
    assert df.collect() == df.collect() and runtime._SETTLED
    runtime.forget(spark)
    assert not runtime._SETTLED
    with pytest.raises(Exception, match="(?i)not exist|not found|no such file"):
        spark.read.schema("id long").parquet(df.inputFiles()[0]).collect()
