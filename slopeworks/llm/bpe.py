"""Word-level BPE by a minimal acyclic transducer of frequent words and exact merges of all others.

The lexicon is compiled once: the frequent words of the whole corpus, counted by Spark, are put in
order into a minimal acyclic automaton whose states of equal futures are one. Each arc carries how many
words of the lexicon come before those behind it, so that the sum along a word is its number, and the
ids of that number stand in one flat array. The automaton is a file of flat arrays that Spark hands to
every executor, where workers map it into memory. Words that it lacks are merged exactly, pair by pair
in order of rank. Decoding joins the tokens' strings as a tokenizer without a decoder does.

Which characters are letters, digits or lower case depends on the Unicode version of who is asked. So
a character beyond ASCII is first compared, once a worker: chunks of characters that the tokenizer library
treats as Python does, and that never join others in normal form, are split here; each distinct chunk with any other
character is put in normal form and split into words by the library. Its words then take the same way as all others.

Defined cases: a null or empty text has no ids and decodes to nothing; special tokens in a text keep
their own ids; repeated rows are encoded each for itself; an empty table gives an empty result and an
empty lexicon; a text of any length is encoded whole. Extra columns are not looked at.
"""

from __future__ import annotations

import atexit
import itertools
import json
import os
import tempfile
import unicodedata
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm import base

#: Words in the lexicon at most.
LEXICON = 1 << 17
#: Bytes of text whose words are counted before the counts are emitted.
COUNTED = 16 << 20
#: Bytes of text that are split, looked up and decoded together; a longer text is a pass of its own.
TOGETHER = 8 << 20
#: Distinct chunks, and distinct words, whose ids a worker remembers; beyond that it keeps those of the texts at hand only.
REMEMBERED = 400_000
#: Separators to str.split() that the tokenizer takes for ordinary characters.
_KEPT = regex.compile("[\x1c-\x1f]")
_GAP = regex.compile(r"[^\S\x1c-\x1f]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """The parts of a tokenizer file that word-level BPE needs, read from the file."""

    def __init__(self, path: str):
        import tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        # of the library, only the steps before its model are asked
        self.library = tokenizers.Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: By the two ids of a pair: its rank and, in the last 20 bits, the id of what they make.
        self.merges = {self.vocab[a] << 20 | self.vocab[b]: rank << 20 | self.vocab[a + b] for rank, (a, b) in enumerate(merges)}
        chars = byte_chars()
        self.first = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.suffix] for c in chars]
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.known: dict[str, bool] = {}  # by character: whether it is split here; at most one entry a code point
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.words_or_ends = regex.compile(split["pattern"]["Regex"] + "|\n")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def words_in(self, chunk: str) -> list[str]:
        """The normalised words of text without white space."""
        if chunk.isascii() or self.safe(chunk):
            return self.words.findall(chunk.lower() if "Σ" not in chunk else "".join(c.lower() for c in chunk))
        return self.asked(chunk)

    def words_of(self, chunks: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """The words of many chunks in one go, the chunks' order in which they come, and how many each has in that order; a special token is one word."""
        special, safe = self.special, self.safe
        plain = np.array([c not in special and (c.isascii() or ("Σ" not in c and safe(c))) for c in chunks], bool)
        found = pa.array(self.words_or_ends.findall("\n".join([*itertools.compress(chunks, plain), ""]).lower()), pa.string())
        ends = np.flatnonzero(pc.equal(found, "\n").to_numpy(zero_copy_only=False))
        others = [[c] if c in special else self.words_in(c) for c in itertools.compress(chunks, ~plain)]
        words = pa.concat_arrays([found.filter(pc.not_equal(found, "\n")), pa.array([w for ws in others for w in ws], pa.string())])
        return words, np.argsort(~plain, kind="stable"), np.concatenate([np.diff(ends, prepend=-1) - 1, np.array([len(ws) for ws in others], np.int64)])

    def asked(self, chunk: str) -> list[str]:
        """The words by the library's own steps."""
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes([self.byte_of[c] for c in piece]).decode() for piece, _ in pieces]

    def safe(self, chunk: str) -> bool:
        """Whether all characters are known to be treated alike here and by the library, whatever is next to them."""
        known = self.known
        for c in set(chunk):
            if c not in known:
                known[c] = c.isascii() or self.alike(c)
            if not known[c]:
                return False
        return True

    def alike(self, c: str) -> bool:
        """Marks, Hangul jamo and what is beyond the first plane may join others, and what Python does not know is not compared."""
        if c > "\uffff" or "\u1100" <= c <= "\u11ff" or unicodedata.category(c)[0] in "MC":
            return False
        low = c.lower()
        text = f"a{low}b{low}{low}1{low}.{low}"
        return self.library.normalizer.normalize_str(f"a{c}b{c}") == f"a{low}b{low}" and self.asked(text) == self.words.findall(text)

    def merge(self, word: str) -> list[int]:
        """The ids of one word: of all neighbours the pair of lowest rank is merged, from the left, until none is left."""
        raw = word.encode("utf-8", "surrogatepass")
        first, get = self.first, self.merges.get
        ids = [first[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        none = 1 << 50
        pairs = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            k = pairs.index(best)
            ids[k] = best & 0xFFFFF
            del ids[k + 1], pairs[k]
            if k:
                pairs[k - 1] = get(ids[k - 1] << 20 | ids[k], none)
            if k < len(pairs):
                pairs[k] = get(ids[k] << 20 | ids[k + 1], none)
        return ids


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """Flat arrays of the minimal automaton of ``entries``, which are sorted and distinct words with their ids.

    ``arcs``: state << 8 | byte of each arc, sorted; ``to`` its state; ``skip`` the words before those
    behind it; ``final`` marks states that end a word; ``offsets`` and ``ids`` are the ids by word number.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []  # final, arcs, words from here

    def state(final: bool, arcs: list[tuple[int, int]]) -> int:
        """The one state with this future."""
        future = (final, tuple(arcs))
        if future not in known:
            known[future] = len(states)
            states.append((final, future[1], final + sum(states[t][2] for _, t in arcs)))
        return known[future]

    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]  # open states along the last word
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], state(final, arcs)))

    for word, _ in entries:
        common = len(os.path.commonprefix((word, last)))
        close(common)
        path += [(False, []) for _ in word[common:]]
        path[-1] = (True, path[-1][1])
        last = word
    close(0)
    root = state(*path[0])
    arcs, to, skip = [], [], []
    for k, (final, out, _) in enumerate(states):
        before = int(final)
        for byte, t in out:
            arcs.append(k << 8 | byte)
            to.append(t)
            skip.append(before)
            before += states[t][2]
    lengths = [len(ids) for _, ids in entries]
    return {
        "root": np.array([root], np.int64), "arcs": np.array(arcs, np.int64), "to": np.array(to, np.int64), "skip": np.array(skip, np.int64),
        "final": np.array([s[0] for s in states], np.int64), "offsets": np.concatenate(([0], np.cumsum(lengths))).astype(np.int64), "ids": np.array([i for _, ids in entries for i in ids], np.int64),
    }


_PARTS = ("root", "arcs", "to", "skip", "final", "offsets", "ids")


def write_lexicon(parts: dict[str, np.ndarray], path: str) -> None:
    """One file: the lengths of the arrays, then the arrays, all 64-bit integers."""
    with open(path, "wb") as f:
        np.array([len(parts[p]) for p in _PARTS], np.int64).tofile(f)
        for p in _PARTS:
            parts[p].tofile(f)


class Lexicon:
    """A compiled lexicon, mapped into memory; words are looked up together, a byte of each at a time."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, "r").view(np.ndarray)  # still mapped, but sliced as any array
        ends = np.cumsum([len(_PARTS), *data[: len(_PARTS)]])
        for p, a, b in zip(_PARTS, ends[:-1], ends[1:]):
            setattr(self, p, data[a:b])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 if the lexicon lacks it."""
        if not len(self.arcs):
            return np.full(len(words), -1, np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        buf = np.frombuffer(b"".join(words), np.uint8)
        at = np.full(len(words), int(self.root[0]), np.int64)
        number = np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        for depth in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > depth]
            if not len(live):
                break
            wanted = at[live] << 8 | buf[starts[live] + depth]
            arc = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            there = self.arcs[arc] == wanted
            at[live[~there]] = -1
            live, arc = live[there], arc[there]
            at[live], number[live] = self.to[arc], number[live] + self.skip[arc]
        return np.where((at >= 0) & (self.final[at] == 1), number, -1)


class Words(base.Slots):
    """From a normalised word to its ids: from the lexicon, or else merged."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon | None):
        super().__init__(REMEMBERED)
        self.tokenizer, self.lexicon = tokenizer, lexicon
        self.ids = base.Ragged(np.dtype("<i4"))

    def learn(self, unseen: pa.StringArray) -> None:
        tokenizer = self.tokenizer
        numbers = self.lexicon.numbers(unseen.cast(pa.binary()).to_pylist()) if self.lexicon else np.full(len(unseen), -1, np.int64)
        lacking = numbers < 0
        merged = [[tokenizer.special[w]] if w in tokenizer.special else tokenizer.merge(w) for w in unseen.filter(pa.array(lacking)).to_pylist()]
        starts, lengths = np.empty(len(unseen), np.int64), np.empty(len(unseen), np.int64)
        lengths[lacking] = [len(x) for x in merged]
        starts[lacking] = np.cumsum(lengths[lacking]) - lengths[lacking]
        flat = np.fromiter(itertools.chain.from_iterable(merged), "<i4")
        if self.lexicon:
            found, offsets = numbers[~lacking], self.lexicon.offsets
            listed, at = base.Ragged.of(self.lexicon.ids, offsets[:-1], np.diff(offsets)).joined(found)
            starts[~lacking], lengths[~lacking] = at[:-1] + len(flat), np.diff(at)
            flat = np.concatenate([flat, listed.astype("<i4")])
        self.ids.add(flat, starts, lengths)

    def keep(self, slots: np.ndarray) -> None:
        self.ids = self.ids.kept(slots)


class Coder(base.Slots):
    """From a chunk between white space to its ids; texts are split, looked up, put together and decoded by whole columns."""

    def __init__(self, tokenizer_path: str, lexicon_path: str | None):
        super().__init__(REMEMBERED)
        self.tokenizer = Tokenizer(tokenizer_path)
        self.words = Words(self.tokenizer, Lexicon(lexicon_path) if lexicon_path else None)
        self.ids = base.Ragged(np.dtype("<i4"))
        strings = self.tokenizer.strings
        self.strings = pa.array([strings.get(i) for i in range(max(strings, default=-1) + 1)], pa.string())

    def chunks(self, text: str) -> list[str]:
        """The text between white space and special tokens; special tokens are chunks of their own."""
        special = self.tokenizer.specials
        if special and "<|" in text and special.search(text):
            return [c for k, part in enumerate(special.split(text)) for c in ([part] if k % 2 else self.chunks(part))]
        return [c for c in _GAP.split(text) if c] if _KEPT.search(text) else text.split()

    def chunked(self, texts: pa.StringArray) -> pa.ListArray:
        """The chunks of each text; null is as empty. An empty chunk, where white space begins or ends a text, has no ids."""
        texts = pc.fill_null(texts, "")
        lists = pc.utf8_split_whitespace(texts)
        odd = pc.match_substring_regex(texts, r"[\x1C-\x1F]|<\|")
        if not pc.any(odd).as_py():
            return lists
        others = pa.array([self.chunks(x) for x in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
        mask = odd.to_numpy(zero_copy_only=False)
        rows = np.where(mask, len(texts) + np.cumsum(mask) - 1, np.arange(len(texts)))
        return pa.concat_arrays([lists.cast(others.type), others]).take(pa.array(rows))

    def learn(self, unseen: pa.StringArray) -> None:
        words, order, counts = self.tokenizer.words_of(unseen.to_pylist())
        slots = self.words.slots(words)
        flat, at = self.words.ids.joined(slots)
        at = at[np.concatenate(([0], np.cumsum(counts)))]
        starts, lengths = np.empty(len(unseen), np.int64), np.empty(len(unseen), np.int64)
        starts[order], lengths[order] = at[:-1], np.diff(at)
        self.ids.add(flat, starts, lengths)

    def keep(self, slots: np.ndarray) -> None:
        self.ids = self.ids.kept(slots)

    def columns(self, texts: pa.StringArray) -> tuple[pa.ListArray, pa.StringArray]:
        """The ids of each text, and what they decode to."""
        lists = self.chunked(texts)
        slots = self.slots(lists.flatten())
        ids, at = self.ids.joined(slots)
        ends = pa.array(at[lists.offsets.to_numpy()].astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(ids)), pc.binary_join(pa.ListArray.from_arrays(ends, self.strings.take(pa.array(ids))), " ")

    def of(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """The ids of each text as bytes, and what they decode to."""
        ids, decoded = self.columns(pa.array(texts, pa.string()))
        raw, ends = ids.values.to_numpy().tobytes(), ids.offsets.to_pylist()
        return [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:])], decoded.to_pylist()


_coders: dict[tuple, Coder] = {}


def coder(tokenizer_path: str, lexicon_path: str | None) -> Coder:
    key = (tokenizer_path, lexicon_path)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(*key)
    return _coders[key]


def frequent_words(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> list[str]:
    """The most frequent words of all texts, at most LEXICON, by counts over the whole corpus."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = coder(tokenizer_path, None)
        tokenizer = splitter.tokenizer
        for _, texts in base.gathered((pa.RecordBatch.from_arrays([b.column(0)] * 2, names=["text", "again"]) for b in batches), COUNTED):
            chunks = splitter.chunked(texts).flatten().value_counts()
            distinct, n = chunks.field("values"), chunks.field("counts").to_numpy()
            if tokenizer.special:
                usual = pc.invert(pc.is_in(distinct, value_set=pa.array(list(tokenizer.special), pa.string())))
                distinct, n = distinct.filter(usual), n[usual.to_numpy(zero_copy_only=False)]
            words, order, counts = tokenizer.words_of(distinct.to_pylist())
            words = words.dictionary_encode()
            total = np.zeros(len(words.dictionary), np.int64)
            np.add.at(total, words.indices.to_numpy(), np.repeat(n[order], counts))
            yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), pa.array(total)], names=["word", "n"])

    words = docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = base.settled(words.filter("n > 1"))
    # the least count that no more than LEXICON words reach, from a histogram by eighths of an octave
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, room = None, LEXICON
    for at, n in sizes:
        if n > room:
            break
        least, room = at, room - n
    return [bytes(r["word"]) for r in words.filter(step >= least).select("word").collect()] if least is not None else []


def _remove(path: str) -> None:
    with suppress(OSError):
        os.unlink(path)


def build_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> str:
    """The name of the compiled lexicon among the files that Spark hands to executors."""
    tokenizer = Tokenizer(tokenizer_path)
    words = sorted(frequent_words(docs, tokenizer_path, text_col))
    entries = [(w, tokenizer.merge(w.decode("utf-8", "surrogatepass"))) for w in words]
    fd, path = tempfile.mkstemp(prefix="lexicon-", suffix=".bin")
    os.close(fd)
    atexit.register(_remove, path)  # executors fetch it from here as long as the driver lives
    write_lexicon(compile_lexicon(entries), path)
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(docs: DataFrame, tokenizer_path: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, ``ids`` and ``decoded``, the text that they decode to."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = coder(tokenizer_path, SparkFiles.get(lexicon) if lexicon else None)
        for keys, texts in base.gathered(batches, TOGETHER):
            ids, decoded = tokens.columns(texts)
            for a, b in base.parts(decoded):
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), ids.slice(a, b - a), decoded.slice(a, b - a)], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encoded, f"id {kind}, ids array<int>, decoded string")
    return rows.withColumnRenamed("id", id_col)
