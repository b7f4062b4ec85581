"""Table access and materialised steps."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SETTLED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one is set here only where the session has none and all runs on one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="slopeworks-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept as a table in the shared folder, which a lost executor rereads.

    A written table has its own size. A checkpoint keeps the estimate of what it was made from, which a loop of joins
    multiplies until planning a round takes longer than running it.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SETTLED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is dealt out by its key and never broadcast.

    What is small enough for a broadcast is told from sizes of files, which are compressed and do not know of what is exploded or
    derived from them: a million cells look like two megabytes, and take the driver a hundred times that.
    """
    return df.hint("merge")


def forget(spark: SparkSession) -> None:
    """Deletes the settled tables of this process; for when nothing that rests on them is read any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    while _SETTLED:
        path = hadoop.Path(_SETTLED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def on_workers(spark: SparkSession) -> SparkSession:
    """Makes this package importable on workers, wherever the driver was started; clusters that ship it are left as they are."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark
