"""Exact top-k by inner product over a pivot-distance index.

Components are integers, floor(scale * x). One more component, the root of what a vector lacks to the
greatest norm, makes all norms equal, so that the greatest inner product is the least distance. A
vector is keyed by its nearest pivot and the annulus of its distance from it; annuli are split at
quantiles of a sample, and a directory holds the least and greatest distance in each. For a query, the
triangle inequality bounds from below its distance to all of an annulus. The annuli of least bounds are
searched first, which gives a score that the k-th best cannot be under; of all others, only those
are searched that this score does not rule out. Blocks of vectors meet blocks of queries in an equal
join on the annulus and a part of it that has a bounded number of blocks, and their scores are exact
integers.

What the bounds rule out depends on the data: of vectors in clusters most annuli, of independent
components in many dimensions none, and then each query meets every vector.

The pivots are fitted on SAMPLE vectors, those of the smallest hashed ids; every vector is indexed.

Defined cases: a null vector, or one with null or non-finite components, takes no part; shorter vectors
are taken as filled up with zeros; an all-zero vector has score 0 with all; rows that share a query's
id are its own, and the query is asked once; ties go to the smaller id; an empty table gives an empty
result; with fewer than k candidates all are returned. An id that is null or no integer takes no part.
Components and scores beyond 64 bits are taken as the nearest that fit. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slopeworks.llm import base

SAMPLE = 4096
PIVOTS = 32
#: Vectors in an annulus aimed at, and annuli of a pivot at most: the directory has at most PIVOTS * MOST rows.
ANNULUS, MOST = 16_384, 256
#: Vectors in a block of the index.
BLOCK = 512
#: Candidates that the first round looks at, at least.
FIRST = 256
#: The greatest double that fits 64 bits.
FAR = float(2**63 - 1024)


def _quantised(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, norms = [], [], []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                v = np.clip(np.floor(scale * v), -FAR, FAR).astype("<i8")
                ids.append(key)
                raw.append(v.tobytes())
                norms.append(float((v.astype(np.float64) ** 2).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(norms, pa.float64())], names=["id", "vector", "norm2"])

    return run


def matrix(raw: list[bytes], width: int) -> np.ndarray:
    if all(len(x) == 8 * width for x in raw):
        return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), width)
    out = np.zeros((len(raw), width), np.int64)
    for k, x in enumerate(raw):
        v = np.frombuffer(x, "<i8")
        out[k, : len(v)] = v
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in double precision where that is exact, in integers of any size where 64 bits are too few."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2**52:
        return np.rint(q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


class Index:
    """Pivots with their annuli: the edges they are split at and, once counted, the extent of each."""

    def __init__(self, sample: np.ndarray, n: int, norm2: float):
        self.norm2 = norm2
        self.width = sample.shape[1]
        x = self.lifted(sample)
        rng = np.random.Generator(np.random.PCG64(7))
        self.pivots = x[rng.permutation(len(x))[:PIVOTS]]
        for _ in range(8):
            near = self.distances(x).argmin(axis=1)
            self.pivots = np.array([x[near == p].mean(axis=0) if (near == p).any() else self.pivots[p] for p in range(len(self.pivots))])
        d = self.distances(x)
        near = d.argmin(axis=1)
        self.rings = int(min(MOST, max(4, -(-n // (PIVOTS * ANNULUS)))))
        inner = np.arange(1, self.rings) / self.rings
        self.edges = [np.quantile(d[near == p, p], inner) if (near == p).any() else np.zeros(self.rings - 1) for p in range(len(self.pivots))]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack((x, np.sqrt(np.maximum(0, self.norm2 - (x**2).sum(axis=1)))))

    def distances(self, x: np.ndarray) -> np.ndarray:
        d2 = (x**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(0, d2))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The annulus of each vector, and its distance from the pivot."""
        d = self.distances(self.lifted(x))
        near = d.argmin(axis=1)
        own = d[np.arange(len(d)), near]
        ring = np.array([np.searchsorted(self.edges[p], v) for p, v in zip(near, own)], np.int64)
        return near * self.rings + ring, own

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and each annulus of the directory: the least possible distance, the greatest possible score."""
        flat = np.column_stack((q.astype(np.float64), np.zeros(len(q))))
        d = self.distances(flat)[:, self.cell // self.rings]
        slack = 1e-6 * np.sqrt(self.norm2) + 1e-6  # for rounding of distances
        least = np.maximum(0, np.maximum(self.low - d, d - self.high) - slack)
        most = ((flat**2).sum(axis=1)[:, None] + self.norm2 - least**2) / 2 + 1 + 1e-9 * self.norm2
        return least, np.maximum(most, -(2.0**63))

    def direct(self, rows: list) -> None:
        self.cell, self.low, self.high, self.n = (np.array([r[k] for r in rows], t) for k, t in enumerate((np.int64, np.float64, np.float64, np.int64)))


def _keyed(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, own = index.value.cells(matrix(batch.column(1).to_pylist(), index.value.width))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(own)], names=["id", "vector", "cell", "distance"])

    return run


def _block(rows: pa.Table) -> pa.Table:
    raw = b"".join(rows.column("vector").to_pylist())
    return pa.table({"cell": rows.column("cell").slice(0, 1), "part": rows.column("part").slice(0, 1), "ids": pa.array([np.array(rows.column("id").to_pylist(), "<i8").tobytes()]), "vectors": pa.array([raw])})


def parts(n: int) -> int:
    """How many parts an annulus of n vectors has, each with ANNULUS vectors or so."""
    return max(1, -(-n // ANNULUS))


def _asked(index, k: int, first: bool):
    """Query blocks for the annuli that a round searches: (cell, part, ids, floors, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column(1).to_pylist(), x.width)
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            floors = np.array([-(2**63) if f is None else f for f in batch.column(2).to_pylist()], np.int64)
            least, most = x.bounds(q)
            if first:
                order = np.argsort(least, axis=1, kind="stable")
                before = np.cumsum(x.n[order], axis=1) - x.n[order]
                wanted = np.zeros(least.shape, bool)
                np.put_along_axis(wanted, order, before < max(FIRST, k + 1), axis=1)
            else:
                wanted = most >= floors[:, None]
            rows = []
            for c in np.flatnonzero(wanted.any(axis=0)):
                w = wanted[:, c]
                asked = ids[w].astype("<i8").tobytes(), floors[w].astype("<i8").tobytes(), q[w].astype("<i8").tobytes()
                rows += [(int(x.cell[c]), part, *asked) for part in range(parts(int(x.n[c])))]
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["cell", "part", "query_ids", "floors", "queries"])

    return run


def best(query: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each query, ties to the smaller key."""
    order = np.lexsort((key, ~score, query))  # the complement orders as the negative does, and always fits
    starts = np.flatnonzero(np.concatenate(([True], query[order][1:] != query[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _scored(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query_ids, floors, queries, ids, vectors in zip(*(batch.column(c).to_pylist() for c in range(5))):
                qid, floor, key = (np.frombuffer(x, "<i8") for x in (query_ids, floors, ids))
                score = products(np.frombuffer(queries, "<i8").reshape(-1, width), np.frombuffer(vectors, "<i8").reshape(-1, width))
                a, b = np.nonzero((score >= floor[:, None]) & (qid[:, None] != key[None, :]))
                top = best(qid[a], key[b], score[a, b], k)
                a, b = a[top], b[top]
                yield pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(key[b]), pa.array(score[a, b])], names=["query_id", "vec_id", "score"])

    return run


def _padded(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.ljust(8 * width, b"\0") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "vector"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best; ``is_query`` is a condition on the column ``id``."""
    context = vectors.sparkSession.sparkContext
    schema = "query_id long, rank int, vec_id long, score long"
    rows = vectors.select(F.col(id_col).try_cast("long").alias("id"), F.col(vector_col).alias("x"))
    rows = base.settled(rows.mapInArrow(_quantised(scale), "id long, vector binary, norm2 double"))
    n, norm2, longest = rows.agg(F.count("*"), F.max("norm2"), F.max(F.octet_length("vector"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    width = max(1, longest // 8)
    rows = rows.select("id", "vector").mapInArrow(_padded(width), "id long, vector binary")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    index = Index(matrix([bytes(r[0]) for r in sample], width), n, norm2)
    keyed = base.settled(rows.mapInArrow(_keyed(context.broadcast(index)), "id long, vector binary, cell long, distance double"))
    directory = keyed.groupBy("cell").agg(F.min("distance"), F.max("distance"), F.count("*").alias("n"))
    extent = directory.collect()  # at most PIVOTS * MOST rows
    index.direct(extent)
    shared = context.broadcast(index)
    sizes = vectors.sparkSession.createDataFrame([(r["cell"], -(-r["n"] // BLOCK), parts(r["n"])) for r in extent], "cell long, chunks long, parts long")
    chunked = keyed.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("chunks"))).withColumn("part", F.col("chunk") % F.col("parts"))
    blocks = base.settled(chunked.groupBy("cell", "part", "chunk").applyInArrow(_block, "cell long, part long, ids binary, vectors binary"))
    queries = base.settled(keyed.filter(is_query).select("id", "vector").dropDuplicates(["id"]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def found(asked: DataFrame, first: bool) -> DataFrame:
        ask = asked.mapInArrow(_asked(shared, k, first), "cell long, part long, query_ids binary, floors binary, queries binary")
        met = ask.join(blocks, ["cell", "part"]).select("query_ids", "floors", "queries", "ids", "vectors")
        hits = met.mapInArrow(_scored(width, k), "query_id long, vec_id long, score long")
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    floors = found(queries.withColumn("floor", F.lit(None).cast("long")), True).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    asked = base.settled(queries.join(floors, "id", "left").select("id", "vector", "floor"))
    return found(asked, False).select("query_id", "rank", "vec_id", "score")
