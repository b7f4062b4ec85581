"""Streaming twins of the batch state operators.

Readings are checked against the static sensor table and split into good and quarantined rows; the latest
reading of each key and the change-only history are keyed state of bounded size: one row per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def quarantine_reason(sensor_known: Column) -> Column:
    """Why a reading is set aside, or null: unknown sensor, other village, other test flag, percentage or raw value out of range."""
    percent, raw = F.col("soil_moisture_percent"), F.col("raw_value")
    return (
        F.when(~sensor_known, "unknown_sensor")
        .when(~F.col("village_lgd_code").eqNullSafe(F.col("registered_village")), "village_mismatch")
        .when(F.col("is_test").isNotNull() & (F.col("is_test") != F.col("registered_test")), "test_flag_mismatch")
        .when(percent.isNull() | F.isnan(percent) | ~percent.between(0, 100), "percent_out_of_range")
        .when(raw.isNotNull() & ~raw.between(0, 10_000_000), "raw_out_of_range")
    )


#: A body's largest size, and the fields it may have (fixed values).
MOST_BYTES = 4096
FIELDS = ("sensor_id", "village_lgd_code", "soil_moisture_percent", "raw_value", "recorded_at", "is_test")
BODY = "sensor_id string, village_lgd_code string, soil_moisture_percent double, raw_value long, recorded_at string, is_test boolean"


def parsed(bodies: DataFrame, body: str) -> DataFrame:
    """Bodies, batch or stream, with their fields and ``reason`` (null: good): too large, malformed, unknown field, or a value out of range."""
    text = F.col(body)
    names = F.json_object_keys(text)
    rows = bodies.withColumns({"_large": F.octet_length(text) > MOST_BYTES, "_names": names}).withColumn("_f", F.from_json(text, BODY))
    percent, raw = F.col("_f.soil_moisture_percent"), F.col("_f.raw_value")
    reason = (
        F.when(F.col("_large"), "too_large").when(F.col("_names").isNull(), "malformed")
        .when(F.exists("_names", lambda n: ~n.isin(*FIELDS)), "unknown_field")
        .when(percent.isNull() | F.isnan(percent) | ~percent.between(0, 100), "percent_out_of_range").when(raw.isNotNull() & ~raw.between(0, 10_000_000), "raw_out_of_range")
    )
    return rows.withColumn("reason", reason).select(*bodies.columns, "_f.*", "reason")


def with_times(readings: DataFrame, recorded: str = "recorded_at", received: str = "received_at") -> DataFrame:
    """Readings whose time of recording is their arrival where they give none. What is latest, and how fresh it is, goes by arrival."""
    return readings.withColumn(recorded, F.coalesce(recorded, received))


def enrich(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Readings, batch or stream, with their sensor's registration and ``reason`` (null: good)."""
    known = sensors.select("sensor_id", F.col("village_lgd_code").alias("registered_village"), F.col("is_test").alias("registered_test"), F.lit(True).alias("known"))
    joined = readings.join(known, "sensor_id", "left")
    reason = quarantine_reason(F.coalesce("known", F.lit(False)))
    return joined.withColumn("reason", reason).withColumn("is_test", F.coalesce("is_test", "registered_test")).drop("known")


def registrations(new: DataFrame, sensors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sensors to append and those refused: their id is taken, or a sensor that is no test has no village."""
    taken = new.join(sensors.select("sensor_id"), "sensor_id", "left_semi").withColumn("reason", F.lit("duplicate"))
    fresh = new.join(sensors.select("sensor_id"), "sensor_id", "left_anti")
    placed = F.coalesce(F.col("is_test"), F.lit(False)) | F.col("village_lgd_code").isNotNull()
    return fresh.filter(placed), taken.unionByName(fresh.filter(~placed).withColumn("reason", F.lit("village_required")))


def latest_stream(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, in update or complete mode: one aggregate with one row of state a key."""
    others = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row")).select(*keys, "row.*")


def change_stream(stream: DataFrame, key: str, order: str, signature: str) -> DataFrame:
    """Rows whose signature differs from the last one kept for their key; within a micro-batch rows go by ``order``.

    ``key`` and ``signature`` are text, ``order`` is a long. Rows that come late in a later batch count as newest, as they do
    on arrival order.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, seen = state.get if state.exists else (None, False)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        now = rows[signature].astype(object).where(rows[signature].notna(), None)
        previous = now.shift()
        previous.iloc[0] = before
        same = (now == previous) | (now.isna() & previous.isna())
        same.iloc[0] &= seen
        last = now.iloc[-1]
        state.update((last, True))
        yield rows.loc[~same.to_numpy(), [key, order, signature]]

    slim = stream.select(F.col(key).cast("string").alias(key), F.col(order).cast("long").alias(order), F.col(signature).cast("string").alias(signature))
    schema = f"`{key}` string, `{order}` long, `{signature}` string"
    return slim.groupBy(key).applyInPandasWithState(step, schema, "before string, seen boolean", "append", GroupStateTimeout.NoTimeout)


def run_to_end(result: DataFrame, folder: str, mode: str) -> DataFrame:
    """Drains what is available into Parquet files in ``folder``, which executors write and read; no row comes to the driver.

    In append mode all batches' rows count; in complete mode each batch is the whole result, and the last one counts.
    """
    spark, out = result.sparkSession, f"{folder}/rows"
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        spark.createDataFrame([], result.schema).write.parquet(out)  # what is read if the stream is empty
        query = writer.format("parquet").option("path", out).start()
        query.awaitTermination()
        return spark.read.schema(result.schema).parquet(out)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last[:] = [number]

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/{last[0]}") if last else spark.createDataFrame([], result.schema)


def polled(result: DataFrame, folder: str, every: str = "60 seconds", mode: str = "append"):
    """The running query that looks for new rows at fixed intervals and appends what follows from them to ``folder``."""
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every)
    return writer.format("parquet").option("path", f"{folder}/rows").start()


def write_split(batch: DataFrame, _: int, good: str, bad: str) -> None:
    """For foreachBatch: good readings and quarantined ones, each to its own table."""
    batch.persist()
    try:
        batch.filter("reason is null").drop("reason").write.mode("append").parquet(good)
        batch.filter("reason is not null").write.mode("append").parquet(bad)
    finally:
        batch.unpersist()
