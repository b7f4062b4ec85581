"""Hard negatives from exact scores of all anchors with all rows, by a two-dimensional block matrix multiply.

Rows are sorted by label in ranges and cut into blocks; so are anchors; and the components of each block are cut into chunks.
A block of anchors meets a block of rows chunk by chunk: each meeting gives a partial tile of 64-bit integer scores, the
partial tiles of a pair of blocks are added up after a shuffle, and the whole tile is reduced at once to the few best of each
anchor. Blocks are dealt to the cells of a grid, each block of anchors to a row of cells and each block of rows to a column,
so that a cell holds a bounded number of both, whatever the labels are.

Anchors and rows of one label are multiplied first, for the positives. What a positive scores bounds the scores of its
negatives, and the blocks of other labels are multiplied with these bounds at hand. As blocks are sorted by label, only a
block that holds several labels is multiplied in both rounds. Tiles are neither kept nor gathered.

Defined cases: a row with a null id, label or vector, or with a null or non-finite component, takes no part; shorter
vectors are filled up with zeros, an empty one scores 0 with all; rows that share the anchor's id are itself; of rows that
share an anchor's id the one of least label and vector is the anchor; as positives and negatives repeated rows are each
a row; ties go to the smaller id; an anchor without positives has no row, nor has a positive whose bounds no row satisfies,
as where its score is below zero; an empty table gives an empty result. Components are taken as the nearest that keep every score
under 2**55, which for 64 components is 2**24 and more. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slopeworks.llm import base
from slopeworks.llm.topk import best, matrix, products

#: Anchors and rows in a block: a tile of scores has 256 kB.
ANCHORS, ROWS = 64, 512
#: Components in a chunk.
CHUNK = 32
#: Blocks of anchors, and of rows, in a cell of the grid.
CELL = 8
#: Greatest score.
MOST = 2**55

_BLOCK = "block long, labels array<long>, k int, ids binary, label binary, windows binary, part binary"
_TILE = "a long, b long, q_ids binary, q_label binary, windows binary, ids binary, label binary, tile binary"
_PARTIAL = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((n, pa.binary()) for n in ("q_ids", "q_label", "windows", "ids", "label", "tile"))])


def _quantised(scale: int, limit: int):
    """Rows that take part, with their components as integers; ``limit`` bounds a component by its vector's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, raw = [], []
            for at, x in enumerate(batch.column(2)):
                if x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(v).all():
                    most = float(isqrt(limit // max(1, len(v))))
                    kept.append(at)
                    raw.append(np.clip(np.floor(scale * v), -most, most).astype("<i8").tobytes())
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(raw, pa.binary())], names=["id", "label", "vector"])

    return run


def _blocks(size: int, width: int):
    """Consecutive rows of a sorted partition as blocks, a row for each chunk of their components.

    Ids, labels and windows go with the first chunk only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, number = TaskContext.get().partitionId(), [], 0

        def cut(rows: list[tuple]) -> pa.RecordBatch:
            ids, labels = (np.array([r[k] for r in rows], "<i8") for k in (0, 1))
            x = matrix([r[2] for r in rows], width)
            out = []
            for k in range(-(-width // CHUNK)):
                meta = (ids.tobytes(), labels.tobytes(), _packed([r[3] for r in rows])) if k == 0 else (None, None, None)
                out.append(((part << 32) + number, np.unique(labels).tolist(), k, *meta, np.ascontiguousarray(x[:, k * CHUNK : (k + 1) * CHUNK]).tobytes()))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["block", "labels", "k", "ids", "label", "windows", "part"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= size:
                yield cut(held[:size])
                number, held = number + 1, held[size:]
        if held:
            yield cut(held)

    return run


def _packed(windows: list) -> bytes:
    """The positives of a block's anchors: (anchor's place, positive's place, id, score)."""
    flat = [(at, w["place"], w["id"], w["score"]) for at, found in enumerate(windows) for w in found or ()]
    return np.array(flat, "<i8").reshape(-1, 4).tobytes()


def blocks(rows: DataFrame, size: int, width: int) -> DataFrame:
    """``rows`` (id, label, vector, windows) in label order, as blocks of ``size``; only a partition's last one is smaller."""
    order = [F.col("label"), F.xxhash64("id"), F.col("_n")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return base.settled(ranged.select("id", "label", "vector", "windows").mapInArrow(_blocks(size, width), _BLOCK))


def _multiplied(width: int):
    """A partial tile for each meeting of a block of anchors and one of rows in one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, k, q_ids, q_label, windows, ids, label, q_part, part in zip(*(c.to_pylist() for c in batch.columns)):
                wide = min(CHUNK, width - k * CHUNK)
                tile = products(*(np.frombuffer(x, "<i8").reshape(-1, wide) for x in (q_part, part)))
                row = (a, b, q_ids, q_label, windows, ids, label, tile.astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _PARTIAL.types)], names=_PARTIAL.names)

    return run


def _whole(tiles: pa.Table) -> tuple[np.ndarray, ...]:
    """The sum of a pair's partial tiles, with what its first chunk carries."""
    known = {n: next(x for x in tiles.column(n).to_pylist() if x is not None) for n in ("q_ids", "q_label", "windows", "ids", "label")}
    q_ids, q_label, ids, label = (np.frombuffer(known[n], "<i8") for n in ("q_ids", "q_label", "ids", "label"))
    score = sum(np.frombuffer(t.as_py(), "<i8") for t in tiles.column("tile")).reshape(len(q_ids), len(ids))
    return q_ids, q_label, ids, label, score, np.frombuffer(known["windows"], "<i8").reshape(-1, 4)


def _table(names: list[str], columns: list[np.ndarray]) -> pa.Table:
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=names)


def _positives(most: int):
    def run(tiles: pa.Table) -> pa.Table:
        q_ids, q_label, ids, label, score, _ = _whole(tiles)
        a, b = np.nonzero((q_label[:, None] == label[None, :]) & (q_ids[:, None] != ids[None, :]))
        top = best(a, ids[b], score[a, b], most)
        a, b = a[top], b[top]
        return _table(["anchor_id", "positive_id", "score"], [q_ids[a], ids[b], score[a, b]])

    return run


def _negatives(most: int, low: int, high: int):
    """The best of a tile for each positive of its anchors, within the bounds that the positive sets."""

    def run(tiles: pa.Table) -> pa.Table:
        q_ids, q_label, ids, label, score, windows = _whole(tiles)
        at, place, positive, reached = windows.T
        own = score[at]
        fits = (q_label[at][:, None] != label[None, :]) & (q_ids[at][:, None] != ids[None, :])
        fits &= (low * reached[:, None] <= 100 * own) & (100 * own <= high * reached[:, None])
        w, b = np.nonzero(fits)
        top = best(w, ids[b], own[w, b], most)
        w, b = w[top], b[top]
        names = ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
        return _table(names, [q_ids[at[w]], place[w], positive[w], reached[w], ids[b], own[w, b]])

    return run


def _met(anchors: DataFrame, rows: DataFrame, same: bool, width: int) -> DataFrame:
    """The partial tiles of all pairs of blocks that share a label, or of those that differ in one."""
    n_anchors, n_rows = (max(1, -(-df.filter("k = 0").count() // CELL)) for df in (anchors, rows))
    cell = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    shared = F.explode("labels") if same else F.lit(0).cast("long")
    left = anchors.select(F.col("block").alias("a"), F.col("labels").alias("a_labels"), "k", F.col("ids").alias("q_ids"), F.col("label").alias("q_label"), "windows", F.col("part").alias("q_part"), cell(n_anchors).alias("g"), shared.alias("l"))
    right = rows.select(F.col("block").alias("b"), F.col("labels").alias("b_labels"), "k", "ids", "label", "part", cell(n_rows).alias("h"), shared.alias("l"))
    met = left.withColumn("h", every(n_rows)).join(right.withColumn("g", every(n_anchors)), ["k", "g", "h", "l"])
    # two blocks that share several labels meet at the first of them
    wanted = F.array_min(F.array_intersect("a_labels", "b_labels")) == F.col("l") if same else (F.size(F.array_union("a_labels", "b_labels")) > 1)
    pairs = met.filter(wanted).select("a", "b", "k", "q_ids", "q_label", "windows", "ids", "label", "q_part", "part")
    return pairs.mapInArrow(_multiplied(width), _TILE)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor's hard negatives.

    ``label`` is an expression on the table's columns, ``is_anchor`` a condition on the column ``id``. A negative is of another
    label than its anchor, and ``low`` to ``high`` percent of the positive's score, both included.
    """
    rows = vectors.select(F.col(id_col).try_cast("long").alias("id"), label.try_cast("long").alias("label"), F.col(vector_col).alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    rows = base.settled(rows.mapInArrow(_quantised(scale, MOST), "id long, label long, vector binary"))
    width = max(1, (rows.agg(F.max(F.octet_length("vector"))).first()[0] or 0) // 8)
    none = F.lit(None).cast("array<struct<place: int, id: long, score: long>>")
    sharded = blocks(rows.withColumn("windows", none), ROWS, width)
    chosen = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.*")
    by_label = blocks(chosen.withColumn("windows", none), ANCHORS, width)
    scored = _met(by_label, sharded, True, width).groupBy("a", "b").applyInArrow(_positives(n_positives), "anchor_id long, positive_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    first = scored.withColumn("place", place).filter(F.col("place") <= n_positives)
    found = first.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("place", F.col("positive_id").alias("id"), "score")).alias("windows"))
    bounded = blocks(chosen.join(found, "id").select("id", "label", "vector", "windows"), ANCHORS, width)
    kinds = "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    hits = _met(bounded, sharded, False, width).groupBy("a", "b").applyInArrow(_negatives(n_negatives, low, high), kinds)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = hits.withColumn("rank", rank).filter(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
