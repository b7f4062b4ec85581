"""Cost-balanced packing of tokenised documents into sequences of fixed length.

Each document's ids are followed by one end id. Whole stretches of ``capacity`` ids are sequences
of their own; what is left of each document is packed with the rest of up to ``group`` others:
documents in descending order of length go to the sequence of lowest cost (linear plus quadratic
attention cost of its pieces) that still has room, and are cut only where none has room for all of
it. A group opens just as many sequences as its ids fill, so all its padding is below one sequence.
Groups lie within a task, so nothing is shuffled, and a task run anew packs the same rows alike.

Defined cases: a null or empty text is the end id alone; a null id stays null; repeated rows are
packed each for itself; ties in length keep the order of rows; an empty table gives no pieces; a
text of any length is cut over as many sequences as it fills. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm import base

CAPACITY = 1024
END_ID = 0
#: Documents whose rests are packed together.
GROUP = 4096
#: Cost of a piece of n ids: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
#: Distinct words whose ids a worker remembers; beyond that it keeps those of the texts at hand only.
REMEMBERED = 600_000
#: Bytes of text that are split and looked up together; a longer text is looked up alone.
TOGETHER = 8 << 20
_OTHER = r"\x09\x0B-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A key that is no whole word: white space or nothing stands where a word begins or ends.
_UNEVEN = rf"^\n?\z|^[{_OTHER}]|^\n[\n{_OTHER}]|[\n{_OTHER}]\z"
#: Keys that only the tokenizer's own library encodes: special tokens, what the faster one separates words by, and
#: characters beyond the end of Latin Extended-B.
_OWN = rf"{_UNEVEN}|<\||\x0B|[^\x00-\x{{24F}}]"
#: A place where a blank may be cut from the word before without any change of ids.
_BLANK = re.compile(r"(?<=\S) (?=\S)")


class WordIds(base.Slots):
    """The ids of texts, as little-endian 32-bit integers, by those of their words.

    The byte-level tokenizer never joins a blank to what stands before it, and a single line feed between
    two words is a piece of its own, so the ids of a text are those of its words in turn. A word is
    remembered under itself if a blank is before it, and with the line feed if that is; the first word of a text is
    taken as if a line feed were before it, whose id is then left out. All words of many texts are split, looked
    up and put together by whole columns. Words not seen before are encoded by the tokenizer's
    own library or, for plain Latin words, by the faster one with the same merges.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        super().__init__(REMEMBERED)
        self._whole = Tokenizer.from_file(tokenizer_path)
        self._whole.no_truncation()
        self._whole.no_padding()
        self._fast: Callable[[str], np.ndarray] | None = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._fast = lambda text: words.encode_to_numpy(text, disallowed_special=())
            self._mark = ranks[b"\x0b"]
        self.ids = base.Ragged(np.dtype("<u4"))
        self.uneven = np.empty(0, bool)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, unseen: pa.StringArray) -> None:
        """Encodes words; plain ones in one go, split again at the vertical tabs put between them."""
        led = pc.binary_join_element_wise(pc.if_else(pc.starts_with(unseen, "\n"), "", " "), unseen, "")
        own = pc.match_substring_regex(unseen, _OWN).to_numpy(zero_copy_only=False) if self._fast else np.ones(len(unseen), bool)
        lengths = np.zeros(len(unseen), np.int64)
        alone = [self.encode(w) for w in led.filter(pa.array(own)).to_pylist()]
        lengths[own] = [len(x) for x in alone]
        ids = np.concatenate(alone) if alone else np.empty(0, "<u4")
        if not own.all():
            found = self._fast("\x0b" + "\x0b".join(led.filter(pa.array(~own)).to_pylist()) + "\x0b")
            lengths[~own] = np.diff(np.flatnonzero(found == self._mark)) - 1
            ids = np.concatenate([ids, found[found != self._mark]])
        # the library's words come first in ids
        order = np.argsort(~own, kind="stable")
        starts = np.empty(len(unseen), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        self.ids.add(ids, starts, lengths)
        self.uneven = np.concatenate([self.uneven, pc.match_substring_regex(unseen, _UNEVEN).to_numpy(zero_copy_only=False)])

    def keep(self, slots: np.ndarray) -> None:
        self.ids, self.uneven = self.ids.kept(slots), self.uneven[slots]

    def of(self, texts: pa.StringArray) -> Iterator[bytes]:
        """The ids of each text; null is as empty."""
        texts = pc.fill_null(texts, "")
        words = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        ends = words.offsets.to_numpy()
        slots = self.slots(words.flatten())
        ids, at = self.ids.joined(slots)
        odd = np.concatenate(([0], np.cumsum(self.uneven[slots])))[ends]
        uneven = odd[1:] > odd[:-1]
        others = iter(self.cut(texts.filter(pa.array(uneven)).to_pylist()))
        raw, at = ids.tobytes(), at[ends].tolist()
        for k, other in enumerate(uneven.tolist()):
            yield next(others) if other else raw[4 * at[k] + 4 : 4 * at[k + 1]]

    def cut(self, texts: list[str]) -> list[bytes]:
        """The ids of texts with white space elsewhere than singly between words, cut at what blanks are between words."""
        split = [_BLANK.split(x) for x in texts]
        slots = self.slots(pa.array([w for words in split for w in words[1:]], pa.string()))
        ids, at = self.ids.joined(slots)
        at = at[np.cumsum([0, *(len(words) - 1 for words in split)])].tolist()
        return [self.encode(words[0]).tobytes() + ids[a:b].tobytes() for words, a, b in zip(split, at, at[1:])]


_coders: dict[tuple, WordIds] = {}


def coder(*paths: str | None) -> WordIds:
    if paths not in _coders:
        _coders[paths] = WordIds(*paths)
    return _coders[paths]


def balance(lengths: list[int], capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items into the fewest sequences that hold them."""
    n = -(-sum(lengths) // capacity)
    room = np.full(n, capacity, np.int64)
    cost = np.zeros(n)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            seq = int(np.where(fits, cost, np.inf).argmin())
            size = min(left, int(room[seq]))
            yield item, start, size, seq, capacity - int(room[seq])
            room[seq] -= size
            cost[seq] += LINEAR * size + QUADRATIC * size * size
            start, left = start + size, left - size


class _Out:
    """Pieces gathered into record batches of a few megabytes."""

    NAMES = ("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")

    def __init__(self, id_type: pa.DataType):
        self.types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.size += len(row[3]) + 64

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), self.types)], names=[*self.NAMES])
            self.rows, self.size = [], 0


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, start, length, ids (binary, 32-bit little-endian), doc_tokens, sequence_id, offset."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = coder(tokenizer_path, ranks_path)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], "<u4").tobytes()
        rest: list[tuple] = []
        out = None

        def settle() -> None:
            nonlocal sequence
            last = -1
            for item, start, length, seq, offset in balance([len(x[2]) // 4 for x in rest], capacity):
                key, before, ids, total = rest[item]
                out.add(key, before + start, length, ids[4 * start : 4 * (start + length)], total, sequence + seq, offset)
                last = max(last, seq)
            sequence += last + 1
            rest.clear()

        for keys, texts in base.gathered(batches, TOGETHER):
            out = out or _Out(keys.type)
            for key, ids in zip(keys.to_pylist(), ids_of.of(texts)):
                ids += end
                total = len(ids) // 4
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    out.add(key, start, capacity, ids[4 * start : 4 * (start + capacity)], total, sequence, 0)
                    sequence += 1
                if whole < total:
                    rest.append((key, whole, ids[4 * whole :], total))
                if len(rest) >= group:
                    settle()
                yield from out.flush(4 << 20)
        if out:
            settle()
            yield from out.flush()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(packed, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
