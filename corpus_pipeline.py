"""From raw documents to packed training sequences: five stages, each a table of its own.

Each stage works on all that the one before it kept, and returns the columns of its input as they are, whatever they are
called, in the same order; only packing returns columns of its own. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.llm import base, langid, linededup, quality, queries, simjoin


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter; a null label is filled with the prediction, if there are labels to learn from.

    A null or empty text has no letter and goes; repeated rows are kept or go alike; a null id is kept by its text as any
    other; ties between languages go to the first in alphabetical order; texts of any length are read whole.
    """
    base.prepare(spark)
    profiles = langid.learn(docs, F.lit(True))
    if not profiles.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = langid.predict(docs, profiles)
    name = rows.columns[-2]
    kept = rows.filter(F.col(name) != langid.UNKNOWN)
    if "lang" in docs.columns:
        kept = kept.withColumn("lang", F.coalesce("lang", name))
    return kept.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 fails.

    A null or empty text has no words and fails the base rules; repeated rows fare alike; ids are not looked at; there are no ties.
    """
    base.prepare(spark)
    return quality.filter_documents(docs, "v1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of smaller id holds; ``n_chars`` follows the text.

    A document all of whose lines are held elsewhere stays with an empty text: this stage takes lines, not documents. A null text
    stays null; a null id is one document greater than any other; rows that share an id do not drop each other's lines.
    """
    base.prepare(spark)
    rows = linededup.kept_texts(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of near duplicates, as they are after line deduplication.

    Repeated rows stay once. A document without words is in no component but its own and stays. Documents without an id
    cannot be told apart: they stay if one of them is in no component with an id.
    """
    base.prepare(spark)
    return simjoin.first_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.

    A null or empty text is the one id that ends a document; a long text is cut into pieces; repeated rows and rows without
    an id are packed each for itself; between sequences of equal cost the first one with room is taken.
    """
    base.prepare(spark)
    return queries.packed_pieces(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Language profiles, exact similarity links and library token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written to the shared folder and read again."""
    docs = base.table(spark, sf_dir, "documents")
    folder = f"{base.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
