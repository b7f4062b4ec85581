"""Token counts of a unigram model by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a run of characters other than ASCII blanks, with the word mark in front. A worker keeps
one trie of all pre-tokens it has met: each node holds the best score and the token count of its
prefix, which are computed once, when a pre-token first takes that way, from the nodes above it. The node
at which a pre-token ends holds its count, and a document's count is the sum over its pre-tokens.

The pieces are those of a SentencePiece file; as scores in a unigram model they get the logarithm of
a Zipf prior over their order in the file. A character that is no piece costs one token per UTF-8 byte,
at ten below the least score. Between segmentations of equal score the one of fewer tokens counts.

Defined cases: a null or empty text, or one of blanks only, has no tokens; repeated rows are counted
each for itself; an empty table gives an empty result; whole texts of any length are counted. Extra
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm import base

MARK = "▁"
#: Nodes of a worker's trie; beyond that it starts afresh.
NODES = 1_000_000


def piece_scores(model_path: str) -> dict[str, float]:
    """The ordinary pieces of a SentencePiece file in their order, with scores from a Zipf prior."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    total = sum(1 / (k + 1) for k in range(len(pieces)))
    return {p: -log((k + 1) * total) for k, p in enumerate(pieces)}


class Counter:
    """Token counts of pre-tokens under the best segmentation, from a trie of those met so far."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - 10
        self.longest: dict[str, int] = {}  # of the pieces that end in a character
        for p in scores:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 0), len(p))
        self.clear()

    def clear(self) -> None:
        """The trie with its root only: a node's child by ``node << 21 | code point``, and each node's values."""
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.known: dict[bytes, int] = {}  # terminal counts

    def insert(self, word: str) -> int:
        """The count of a word, after whatever its way through the trie lacked is there."""
        child = self.child
        node, way = 0, [0]
        for c in word:
            following = child.get(node << 21 | ord(c))
            if following is None:
                break
            node = following
            way.append(node)
        if len(way) <= len(word):
            self.extend(word, way)
            node = way[-1]
        return self.tokens[node]

    def extend(self, word: str, way: list[int]) -> None:
        """Nodes for the rest of the word after the nodes of ``way``: the best score and the token count of each prefix by those before it."""
        child, best, tokens, get, longest, unknown = self.child, self.best, self.tokens, self.scores.get, self.longest.get, self.unknown
        scores, counts = [best[k] for k in way], [tokens[k] for k in way]
        for at in range(len(way) - 1, len(word)):
            c, end = word[at], at + 1
            top, n = -inf, 0
            for start in range(max(0, end - longest(c, 0)), end):
                score = get(word[start:end])
                if score is not None:
                    score += scores[start]
                    if score > top or score == top and counts[start] + 1 < n:
                        top, n = score, counts[start] + 1
            if c not in self.scores:
                score = scores[at] + unknown
                if score > top:
                    top, n = score, counts[at] + len(c.encode("utf-8", "surrogatepass"))
            scores.append(top)
            counts.append(n)
            child[way[-1] << 21 | ord(c)] = len(best)
            way.append(len(best))
            best.append(top)
            tokens.append(n)

    def of(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        """Tokens and pre-tokens of each text."""
        split = [x.split() for x in texts]
        if len(self.best) > NODES:
            self.clear()
        known, insert = self.known, self.insert
        for w in {w for ws in split for w in ws}.difference(known):
            known[w] = insert(MARK + w.decode("utf-8", "surrogatepass"))
        return [sum(map(known.__getitem__, ws)) for ws in split], [len(ws) for ws in split]


_counters: dict[str, Counter] = {}


def counter(model_path: str) -> Counter:
    if model_path not in _counters:
        _counters[model_path] = Counter(piece_scores(model_path))
    return _counters[model_path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, ``n_tokens`` and ``n_pretokens``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for batch in batches:
            for a, b in base.parts(batch.column(1)):
                texts = batch.column(1).slice(a, b - a).cast(pa.binary()).to_pylist()
                tokens, words = count.of([x or b"" for x in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.array(tokens, np.int64)), pa.array(np.array(words, np.int64))], names=["id", "n_tokens", "n_pretokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(counted, f"id {kind}, n_tokens long, n_pretokens long")
    return rows.withColumnRenamed("id", id_col)
