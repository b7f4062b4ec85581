"""Sharding by Karmarkar-Karp differencing: groups of equal texts go whole to shards of near equal bytes.

Groups too small to matter alone are bundled by their hash; groups above one of BUNDLES of all bytes
stay items of their own. So there are at most 2 * BUNDLES items, whatever the size of the corpus, and
the differencing is one small task: it starts with a partial partition for each item and repeatedly
combines the two of largest spread, the heavier shards of one with the lighter shards of the other.
Shards come back to the documents by a broadcast of those items.

Defined cases: a null text is taken for an empty one, with size 1; repeated rows count each for itself
and share a shard; ties are broken by item; an empty table gives an empty result; slots follow the
order of ids, with null ids first and repeated rows in any order. Extra columns are not looked at.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slopeworks.llm import base

BUNDLES = 16_384


def difference(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """The shard of each item (name, size): sizes near equal, by repeated combination of partial partitions."""
    # a partial partition: its shards' sums in descending order, each with the tree of what it holds
    heap = [(-size, name, [size] + [0] * (shards - 1), [name] + [None] * (shards - 1)) for name, size in items]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, name, sums, trees = heapq.heappop(heap)
        _, _, other, leaves = heapq.heappop(heap)
        joined = sorted(
            ((a + b, k, x if y is None else y if x is None else (x, y)) for k, (a, x, b, y) in enumerate(zip(sums, trees, reversed(other), reversed(leaves)))),
            key=lambda t: (-t[0], t[1]),
        )
        sums = [x[0] for x in joined]
        heapq.heappush(heap, (sums[-1] - sums[0], name, sums, [x[2] for x in joined]))
    found: dict[int, int] = {}
    for shard, tree in enumerate(heap[0][3] if heap else []):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            elif x is not None:
                found[x] = shard
    return found


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, ``size`` (bytes + 1), ``text_crc32``, ``shard`` and ``slot`` (gapless in its shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"))
    slim = base.settled(slim.withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(BUNDLES))))
    total = slim.agg(F.sum("size")).first()[0] or 0
    groups = slim.groupBy("group", "bundle").agg(F.sum("size").alias("bytes"))
    items = groups.groupBy("bundle", F.when(F.col("bytes") * BUNDLES > total, F.col("group")).alias("own")).agg(F.sum("bytes").alias("bytes"))

    def partition(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        found = difference(list(zip(rows["item"].tolist(), rows["bytes"].tolist())), shards)
        return pd.DataFrame({"item": list(found), "shard": list(found.values())}).astype({"item": "int64", "shard": "int32"})

    items = base.settled(items.withColumn("item", F.monotonically_increasing_id()))
    shard_of = items.groupBy(F.lit(0).alias("all")).applyInPandas(lambda rows: partition(rows[["item", "bytes"]]), "item long, shard int")
    placed = base.settled(items.join(F.broadcast(shard_of), "item").select("bundle", "own", "shard"))
    own = placed.filter("own is not null").select(F.col("own").alias("group"), F.col("shard").alias("own_shard"))
    bundled = placed.filter("own is null").select("bundle", F.col("shard").alias("bundle_shard"))
    rows = slim.join(F.broadcast(own), "group", "left").join(F.broadcast(bundled), "bundle", "left")
    rows = rows.select("id", "size", "text_crc32", F.coalesce("own_shard", "bundle_shard").alias("shard"))
    return numbered(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumnRenamed("id", id_col)


def numbered(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with ``slot``, from 0 without gaps in each shard, by ranges of ids that are counted first."""
    ranged = base.settled(rows.repartitionByRange(parts, "id").withColumn("range", F.spark_partition_id()))
    before = ranged.groupBy("shard", "range").agg(F.count("*").alias("n"))
    up = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("shard", "range", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("before"))
    within = Window.partitionBy("range", "shard").orderBy("id", "text_crc32", "size")
    return ranged.withColumn("k", F.row_number().over(within)).join(before, ["range", "shard"]).withColumn("slot", F.col("before") + F.col("k") - 1).drop("k", "before", "range")
