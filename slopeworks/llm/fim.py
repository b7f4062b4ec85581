"""Fill-in-middle documents by splitting at zero-width boundaries.

The grammar of a unit is a list of pairs of character classes that may not stand next to each other within a unit. Each pair
becomes a lookbehind and a lookahead, so the alternative of all pairs matches nothing but the places between units, and
Spark's ``split`` gives the units with every character kept. An empty text has no units, where ``split`` gives one empty
piece, so it is handled apart. All work is expressions on one row: nothing is shuffled, and a text is looked at whole.

Where the two cuts lie and which order the parts take follows from a hash of the seed and the id, so a row has the same
outcome wherever and however often it is computed.

Defined cases: a null text is an empty one; a null id is hashed as an empty text; repeated rows, and rows that share an id,
are cut by the same hash, each in its own text; equal cuts leave an empty middle; a text that holds a sentinel stays plain;
a text of any length is cut whole; an empty table gives an empty one. Columns of the table other than id and text go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of neighbouring classes with a boundary between them, for each unit.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "characters": [(r"[\s\S]", r"[\s\S]")],
    "lines": [(r"\n", r"[\s\S]")],
    # a word with the white space before it
    "words": [(r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]")],
    # white space and what is none take turns
    "tokens": [(r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"), (r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]")],
}
#: What marks the start of the prefix, of the suffix and of the middle.
SENTINELS = ("<P>", "<S>", "<M>")


def boundary(unit: str) -> str:
    """The zero-width regular expression of the places between two units."""
    return "|".join(f"(?<={left})(?={right})" for left, right in GRAMMARS[unit])


def units(text: Column, unit: str) -> Column:
    """The text's units in order; joined they are the text."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.octet_length(text), F.lit(0)) == 0, none).otherwise(F.split(text, boundary(unit), -1))


def _draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits that follow from the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, unit: str = "lines", seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, ``n`` units, ``form`` (plain, psm or spm), ``prefix``, ``middle`` and ``suffix`` (null if plain), and ``output``.

    ``rate`` and ``spm_rate`` are percentages: of documents that are cut, and of those the share with the suffix first.
    """
    pre, suf, mid = map(F.lit, sentinels)
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.select("_id", text.alias("_text"), units(text, unit).alias("_units"), F.array(*_draws(F.col("_id"), seed)).alias("_h"))
    ends = [F.col("_h")[k] % (F.size("_units") + 1) for k in (0, 1)]
    marked = F.contains("_text", pre) | F.contains("_text", suf) | F.contains("_text", mid)
    plain = (F.col("_text") == "") | marked | (F.col("_h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("_h")[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("_id", "_text", "_units", form.alias("form"), F.least(*ends).cast("int").alias("_a"), F.greatest(*ends).cast("int").alias("_b"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start, length), ""))
    a, b, n = F.col("_a"), F.col("_b"), F.size("_units")
    rows = rows.select("_id", "_text", n.cast("long").alias("n"), "form", part(F.lit(1), a).alias("prefix"), part(a + 1, b - a).alias("middle"), part(b + 1, n - b).alias("suffix"))
    psm, spm = F.concat(pre, "prefix", suf, "suffix", mid, "middle"), F.concat(suf, "suffix", pre, "prefix", mid, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text"))
    return rows.select(F.col("_id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from nothing but the output and its form.

    No part holds a sentinel, so the first of each kind is the one that was put there. Sentinels have to be such that none
    can begin within another.
    """
    pre, suf, mid = map(F.lit, sentinels)
    at = lambda mark: F.position(mark, output)
    between = lambda mark, end: F.substr(output, at(mark) + F.length(mark), end - at(mark) - F.length(mark))
    rest = lambda mark: F.substr(output, at(mark) + F.length(mark))
    psm = F.concat(between(pre, at(suf)), rest(mid), between(suf, at(mid)))
    spm = F.concat(between(pre, at(mid)), rest(mid), between(suf, at(pre)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
