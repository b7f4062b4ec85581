"""Language identification by rank-order profiles of letter n-grams.

Letters are folded to lower case; everything else separates words. The profile of a language is the
RANKS most frequent n-grams (one to three letters, with a mark at either end of a word) of its
training documents, in the order of their counts. A document is compared by its own RANKS most
frequent n-grams: each counts how many places it is out of its place in the profile, RANKS if it is
not there. The least distance wins; the score is how far it is from the greatest possible distance.

Training takes at most SAMPLE labelled documents of each language, those whose hashed ids are the
smallest, whole, and for rows that share id and language the least text; prediction reads whole texts and nothing but the
text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties between languages go
to the first in alphabetical order, ties between n-grams to the smaller code; repeated rows are
predicted alike; without labelled documents all are ``und``; an empty table gives an empty result.
A null label or id takes no part in training. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from slopeworks.llm import base

#: Most labelled documents of a language that are learned from.
SAMPLE = 1500
#: Labels at most: each task holds the profiles of all. More are refused, none is left out.
LANGUAGES = 1000
RANKS = 300
#: Ids of a language that are put in order, as a multiple of SAMPLE: so many that fewer than SAMPLE never occur by chance.
MARGIN = 4
#: Bits of a letter's code: as many as there are code points, so an n-gram is a long.
BITS = 21
#: The code of what separates words; those of letters are greater.
MARK = 1
UNKNOWN = "und"
#: Documents of the sample that a task counts the n-grams of, or more.
TASK = 500


@lru_cache(maxsize=1)
def _folded() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and its lower case (itself, where that is longer than one)."""
    low = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            letter[k] = True
            x = c.lower()
            if len(x) == 1:
                low[k] = ord(x)
    return letter, low


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letter_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    letter, low = _folded()
    x = _points(text)
    return np.unique(low[x[letter[x]]], return_counts=True)


def _coded(text: str, codes: np.ndarray) -> np.ndarray:
    """The text as letter codes, with one MARK before, between and after its words; empty without letters."""
    letter, low = _folded()
    x = _points(text)
    mask = letter[x]
    out = np.where(mask, codes[low[x]], MARK).astype(np.int64)
    keep = mask.copy()
    keep[1:] |= mask[:-1]  # of a run of separators, the one right after a letter stays
    out = out[keep]
    return np.concatenate(([MARK], out, [MARK])) if mask.any() else np.zeros(0, np.int64)


def gram_counts(text: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the text's n-grams; letters only, or with marks at the ends of words."""
    c = _coded(text, codes)
    if not len(c):
        return c, c
    one = c[c > MARK]
    two = (c[:-1] << BITS | c[1:])[(c[:-1] > MARK) | (c[1:] > MARK)]
    three = (c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:])[c[1:-1] > MARK]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The RANKS most frequent n-grams, most frequent first."""
    if len(grams) > RANKS:
        least = np.partition(counts, -RANKS)[-RANKS]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:RANKS]


def _counted(codes: np.ndarray | None = None):
    """(lang, code, n) of the letters or the n-grams of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = total.setdefault(lang, {})
                keys, counts = letter_counts(text) if codes is None else gram_counts(text, codes)
                for k, n in zip(keys.tolist(), counts.tolist()):
                    mine[k] = mine.get(k, 0) + n
        for lang, mine in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], names=["lang", "code", "n"])

    return run


class Profiles:
    """Letter codes and, by language in alphabetical order, the place of each n-gram (RANKS if absent)."""

    def __init__(self, codes: np.ndarray, ranked_grams: dict[str, list[int]]):
        self.codes = codes
        self.langs = sorted(ranked_grams)
        self.grams = np.unique(np.array([g for x in ranked_grams.values() for g in x], np.int64))
        self.places = np.full((len(self.langs), len(self.grams) + 1), -RANKS, np.int64)
        for k, lang in enumerate(self.langs):
            order = np.array(ranked_grams[lang], np.int64)
            self.places[k, np.searchsorted(self.grams, order)] = np.arange(len(order))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranked(*gram_counts(text or "", self.codes))
        if not len(mine) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        at = np.where(self.grams[at] == mine, at, len(self.grams))
        there = self.places[:, at]
        distance = np.where(there < 0, RANKS, np.abs(there - np.arange(len(mine)))).sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (RANKS * len(mine))


def _sample(labelled: DataFrame) -> DataFrame:
    """(lang, text) of at most SAMPLE documents of each language.

    Hashes are tried below a bound that some MARGIN * SAMPLE ids of a language are under, so a frequent
    language brings no more rows to its window than a rare one.
    """
    ids = base.settled(labelled.select("lang", "id", F.xxhash64("id").alias("h")).distinct())
    total = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(total) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels: the column holds something else than languages")
    if not total:
        return labelled.select("lang", "text")
    share = F.create_map(*(F.lit(x) for lang, n in total.items() for x in (lang, min(1.0, MARGIN * SAMPLE / n))))
    low = ids.filter(F.col("h").cast("double") <= (2 * share[F.col("lang")] - 1) * float(2**63))
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = low.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLE).select("id", "lang")
    # at most LANGUAGES times SAMPLE ids
    return labelled.join(F.broadcast(chosen), ["id", "lang"], "left_semi").groupBy("lang", "id").agg(F.min("text").alias("text")).select("lang", "text")


def learn(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from the rows of ``docs`` for which ``training`` holds and that have a label."""
    labelled = docs.filter(training & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = base.settled(_sample(labelled))
    # each task counts n-grams for itself, so many tasks of few documents would send most of them once a task
    sample = sample.coalesce(1 + sample.count() // TASK)
    schema = "lang string, code long, n long"
    letters = sample.mapInArrow(_counted(), schema).groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").collect()
    # letters that no training document has share the last code, which is in no profile; at most as many rows as code points
    codes = np.full(0x110000, len(letters) + MARK + 1, np.uint32)
    codes[[r["code"] for r in letters]] = np.arange(MARK + 1, len(letters) + MARK + 1, dtype=np.uint32)
    grams = sample.mapInArrow(_counted(codes), schema).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    places = grams.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("k") <= RANKS)
    found: dict[str, list[int]] = {}
    for r in places.orderBy("lang", "k").collect():
        found.setdefault(r["lang"], []).append(r["code"])
    return Profiles(codes, found)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` and ``lang_score`` (underscores in front if the input has such)."""
    place = docs.columns.index(text_col)
    fresh = [base.free_name(docs, "lang_pred"), base.free_name(docs, "lang_score")]
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # of a fixed size: code points, languages times RANKS

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*docs_columns, *fresh])

    docs_columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(fresh[0], T.StringType()), T.StructField(fresh[1], T.DoubleType())])
    return docs.mapInArrow(predicted, schema)
