"""Streaming queries over the event table, drained to the end; they must equal their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.functions import scalar as S
from slopeworks.operators import warnings
from slopeworks.plans import checks, hazard
from slopeworks.runtime import shared_folder, table
from slopeworks.streaming import sensors


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value")
    return sensors.run_to_end(sensors.latest_stream(rows, ["user_id"], ["ts", "event_id"]), _folder(spark, "latest"), "complete").drop("ts")


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in the order of their ids, which is that of their times."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_key"), "event_id", S.moisture_band(F.col("value")).alias("band"))
    out = sensors.run_to_end(sensors.change_stream(rows, "user_key", "event_id", "band"), _folder(spark, "history"), "append")
    return out.select(F.col("user_key").cast("long").alias("user_id"), "event_id", "band")


def stream_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change-only history of warnings by all eight fields of their signature."""
    rows = checks.evaluated(_stream(spark, sf_dir)).select(F.col("user_id").cast("string").alias("user_key"), "event_id", warnings.signature().alias("signature"))
    out = sensors.run_to_end(sensors.change_stream(rows, "user_key", "event_id", "signature"), _folder(spark, "warnings"), "append")
    return out.select(F.col("user_key").cast("long").alias("user_id"), "event_id")


QUERIES = {"stream_latest": stream_latest, "stream_history": stream_history, "stream_warnings": stream_warnings}
ORACLE = {
    "stream_latest": hazard.ORACLE["latest_reading"], "stream_history": hazard.ORACLE["change_history"].replace("order by ts, event_id", "order by event_id"),
    "stream_warnings": hazard.ORACLE["warning_history"].replace("order by ts, event_id", "order by event_id"),
}
