"""Quality rules as a ledger: every rule once per document, failures as bits of one long.

``ledger`` measures a document and evaluates all rules; ``apply_policy`` and ``ablations`` work on
the stored bits alone, so a new policy version or an ablation never reads a text again.

Defined cases: a null or empty text has no words, fails TOO_FEW_WORDS, and has zero in all
measures. Very long texts are measured whole. Repeated rows are measured each for itself. An empty
table gives an empty ledger. Columns of the input other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeworks.llm import base, words as W

#: Rules in the order of their bits.
RULES = ("too_few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines", "few_letters", "shouting", "stutter")
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": BIT["too_few_words"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
}
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_letters", "n_upper", "n_lower", "n_stutter")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
#: Bytes that count as letters: ASCII letters and the first byte of any character beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC2, 0xF5)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True


def _dup_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines)), len(lines)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All measures of the texts of a column, vectorised over its rows."""
    n = len(column)
    buf, at = W.flat(column)
    found = W.words(buf, at)
    inside = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask[buf])))[at])
    key, where = W.windows(found, WINDOW)
    covered = np.zeros(len(found.hash) + 1, np.int64)
    if len(key):
        key = W.mix(key + W.mix(found.row[where].astype(np.uint64)))  # alike only within a row
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at_words = where[again]
        np.add.at(covered, at_words, 1)
        np.add.at(covered, at_words + WINDOW, -1)
    repeated = np.cumsum(covered)[: len(found.hash)] > 0
    stutter = np.zeros(len(found.hash), bool)
    stutter[1:] = (found.hash[1:] == found.hash[:-1]) & (found.row[1:] == found.row[:-1])
    lines = [_dup_lines(x or "") for x in column.to_pylist()]
    return {
        "n_words": found.counts,
        "word_chars": found.chars,
        "n_symbols": inside(_SYMBOL),
        "n_dup_lines": np.array([x[0] for x in lines], np.int64),
        "n_lines": np.array([x[1] for x in lines], np.int64),
        "n_repeat_words": W.per_row(repeated, found.row, n),
        "n_letters": inside(_LETTER),
        "n_upper": inside(_UPPER),
        "n_lower": inside(_LOWER),
        "n_stutter": W.per_row(stutter, found.row, n),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in base.parts(batch.column(1)):
            m = measure(batch.column(1).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(m[k], pa.int64()) for k in MEASURES)], names=["id", *MEASURES])


def failures(m: dict[str, Column]) -> Column:
    """The failure bits; thresholds are wide, so that plain prose of any language fails none."""
    n = m["n_words"]
    failed = {
        "too_few_words": n < 20,
        "repeated_words": 100 * m["n_repeat_words"] > 30 * n,
        "short_words": m["word_chars"] < 2 * n,
        "long_words": m["word_chars"] > 20 * n,
        "symbols": 10 * m["n_symbols"] > n * 3,
        "repeated_lines": (m["n_dup_lines"] >= 3) & (2 * m["n_dup_lines"] > m["n_lines"]),
        "few_letters": 2 * m["n_letters"] < m["word_chars"],
        "shouting": m["n_upper"] > m["n_lower"],
        "stutter": 10 * m["n_stutter"] > n * 3,
    }
    bits = F.lit(0).cast("long")
    for name in RULES:
        bits = bits.bitwiseOR(F.when(failed[name], F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, all measures, and ``failed_bits``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_measured, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return rows.withColumn("failed_bits", failures({m: F.col(m) for m in MEASURES})).withColumnRenamed("id", id_col)


def apply_policy(rows: DataFrame, policy: str = "v1", out: str = "kept") -> DataFrame:
    """``rows`` of a ledger with the verdict of a policy version."""
    return rows.withColumn(out, F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone, and are kept without it."""
    mask = POLICIES[policy]
    by_bits = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if BIT[r] & mask]
    counts = [
        F.struct(
            F.lit(r).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(BIT[r])) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == BIT[r], F.col("n"))), F.lit(0)).alias("n_failed_alone"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(mask & ~BIT[r])) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
        for r in rules
    ]
    return by_bits.agg(F.array(*counts).alias("x")).select(F.inline("x"))


def filter_documents(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns as they were."""
    columns = docs.columns
    place = columns.index(text_col)
    name = base.free_name(docs, "kept_bits")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in base.parts(batch.column(place)):
                part = batch.slice(a, b - a)
                m = measure(part.column(place))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m[k], pa.int64()) for k in MEASURES)], names=[*columns, *fresh])

    fresh = [base.free_name(docs, f"measured_{m}") for m in MEASURES]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(m, T.LongType()) for m in fresh)])
    rows = docs.mapInArrow(judged, schema).withColumn(name, failures({m: F.col(c) for m, c in zip(MEASURES, fresh)}))
    return rows.filter(F.col(name).bitwiseAND(F.lit(POLICIES[policy])) == 0).select(*columns)
