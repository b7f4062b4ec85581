"""What the corpus operators share: table access, worker set-up, materialised steps, what a worker remembers of strings."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch: with whole texts of any length, rows are what bounds a worker's memory.
BATCH_ROWS = 256
#: Bytes of text that one vectorised pass works on; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Makes this package importable on workers and bounds the rows of an Arrow batch."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one is set here only where the session has none and all runs on one machine, as in tests."""
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
    """The rows of ``df``, computed once and kept in the shared folder, which a lost executor rereads."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` clashes with it in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def parts(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``most`` bytes each; every row is in one."""
    first = size = 0
    for row, length in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size and size + length > most:
            yield first, row
            first, size = row, 0
        size += length
    if first < len(column):
        yield first, len(column)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """First and second columns, the second of strings, of batches put together to about ``most`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0

    def given() -> Iterator[tuple[pa.Array, pa.Array]]:
        keys, texts = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
        for a, b in parts(texts, most):
            yield keys.slice(a, b - a), texts.slice(a, b - a)

    for batch in batches:
        size_here = pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
        if held and size + size_here > most:
            yield from given()
            held, size = [], 0
        held.append(batch)
        size += size_here
    if held:
        yield from given()


class Ragged:
    """Lists of numbers in one flat array."""

    def __init__(self, dtype: np.dtype):
        self.flat = np.empty(0, dtype)
        self.starts = self.lengths = np.empty(0, np.int64)

    @classmethod
    def of(cls, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Ragged:
        out = cls(flat.dtype)
        out.flat, out.starts, out.lengths = flat, starts, lengths
        return out

    def add(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """More lists, that begin at ``starts`` of ``flat``."""
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def joined(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``which`` in turn, and where each of them begins, with the end of the last."""
        lengths = self.lengths[which]
        at = np.concatenate(([0], np.cumsum(lengths)))
        return self.flat[np.repeat(self.starts[which] - at[:-1], lengths) + np.arange(at[-1])], at

    def kept(self, which: np.ndarray) -> Ragged:
        """The lists of ``which`` alone."""
        flat, at = self.joined(which)
        return Ragged.of(flat, at[:-1], np.diff(at))


class Slots:
    """Numbers the strings that a worker meets, in order of learning, and forgets those not at hand when they are too many."""

    def __init__(self, most: int):
        self.most = most
        self.known = pa.array([], pa.string())

    def learn(self, unseen: pa.StringArray) -> None:
        """To be defined: remembers these strings' values after those of all known ones."""
        raise NotImplementedError

    def keep(self, slots: np.ndarray) -> None:
        """To be defined: forgets all values but these, which are numbered anew in this order."""
        raise NotImplementedError

    def slots(self, words: pa.StringArray) -> np.ndarray:
        """The number of each string."""
        at = pc.index_in(words, value_set=self.known)
        if not at.null_count:
            return at.to_numpy()
        lacking = at.is_null()
        missed = words.filter(lacking)
        unseen = missed.unique()
        slots = at.fill_null(0).to_numpy().copy()
        lacking = lacking.to_numpy(zero_copy_only=False)
        if len(self.known) + len(unseen) > self.most:
            used, slots[~lacking] = np.unique(slots[~lacking], return_inverse=True)
            self.keep(used)
            self.known = self.known.take(pa.array(used))
        slots[lacking] = pc.index_in(missed, value_set=unseen).to_numpy() + len(self.known)
        self.learn(unseen)
        self.known = pa.concat_arrays([self.known, unseen])
        return slots
