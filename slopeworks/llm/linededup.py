"""Exact removal of lines that other documents hold too, with DataFrame operations only.

Lines are reduced to two 64-bit hashes of their key (stripped of blanks at both ends, A-Z in lower
case). Hashes that many rows share are settled first, from counts that are pre-aggregated before
their shuffle; they are few (see HOT), so they are broadcast. All other hashes are
range-partitioned and sorted by hash, document and position, and a window that runs along that order
sees for each line the first document that holds it. What comes out is no text: a sparse bitmap per
document of the lines to drop, as a map from word number to the 64 bits of that word.

Defined cases: a null or empty text is one empty line and drops nothing; a null id counts as one
document greater than any other; rows that share an id are one document, whose lines do not drop
each other; repeated rows get the same bitmap; ties cannot occur, as the smallest id keeps its
lines; an empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slopeworks.llm import base

#: Keys shorter than this many code points stay.
LEAST = 10
#: A hash is hot when it has more than one of HOT of all lines, or of as many as there are partitions if these are more, so there are
#: fewer hot ones than that, and no other hash has more lines than a partition's share.
HOT = 2000
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    stripped = F.trim(line, F.lit(_BLANKS))
    # for ASCII the two ways agree, and lower() is the faster
    return F.when(F.length(stripped) == F.octet_length(stripped), F.lower(stripped)).otherwise(F.translate(stripped, _UPPER, _LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line whose key is long enough: document, text's hash, position, and the key's two hashes."""
    lines = docs.select("id", "part", F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).select("id", "part", "pos", line_key(F.col("line")).alias("key"))
    return lines.filter(F.length("key") >= LEAST).select("id", "part", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, words): a map from word number to its 64 bits, set for each line to drop; ``part`` is the text's hash.

    Only documents that lose a line have a row.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("part", F.xxhash64(F.coalesce("text", F.lit(""))))
    lines = base.settled(_lines(docs))  # hashes only: texts are split once
    first = F.min(F.struct(F.col("id").isNull(), "id")).alias("first")
    last = F.max(F.struct(F.col("id").isNull(), "id")).alias("last")
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), first, last)
    counts = base.settled(counts.filter("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = counts.filter(F.col("n") * max(HOT, parts) > total)
    hot = hot.select("h1", "h2", F.col("first.id").alias("first_id"), (F.col("first") != F.col("last")).alias("shared"), F.lit(True).alias("hot"))
    marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    known = marked.filter("hot and shared and not (id <=> first_id)").select("id", "part", "pos")
    ranged = marked.filter("hot is null").select("h1", "h2", "id", "part", "pos").repartitionByRange(parts, "h1", "h2")
    along = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("id"), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = ranged.withColumn("first_id", F.first(F.struct("id")).over(along)).filter("not (id <=> first_id.id)").select("id", "part", "pos")
    drops = known.union(streamed).select("id", "part", F.expr("pos div 64").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    words = drops.groupBy("id", "part", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("id", "part").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the dropped lines out of the text, and how many lines there were and went.

    The two counts are the columns n_lines and n_dropped, with underscores in front if the input has such.
    """
    key, part, words, lines = (base.free_name(docs, x) for x in ("line_key", "line_part", "line_words", "line_array"))
    n_lines, n_dropped = base.free_name(docs, "n_lines"), base.free_name(docs, "n_dropped")
    # a null id needs a key of its own that joins
    as_key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    drops = dropped_lines(docs, id_col, text_col).select(as_key(F.col("id")).alias(key), F.col("part").alias(part), F.col("words").alias(words))
    rows = docs.withColumn(key, as_key(F.col(id_col))).withColumn(part, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.join(drops, [key, part], "left").withColumn(lines, split_lines(F.col(text_col)))
    left = F.expr(f"filter(`{lines}`, (x, i) -> coalesce(shiftright(try_element_at(`{words}`, i div 64), i % 64) & 1L, 0L) = 0L)")
    rows = rows.withColumn(n_lines, F.size(lines).cast("long")).withColumn(lines, F.when(F.col(words).isNull(), F.col(lines)).otherwise(left))
    rows = rows.withColumn(n_dropped, F.col(n_lines) - F.size(lines)).withColumn(text_col, F.when(F.col(n_dropped) == 0, F.col(text_col)).otherwise(F.array_join(lines, "\n")))
    return rows.select(*docs.columns, n_lines, n_dropped)
