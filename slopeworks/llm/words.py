"""Vectorised words of many texts at once.

A word is ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes, so no multi-byte character is ever cut. Word
identities are 64-bit hashes: a random value per byte, weighted by the byte's place in the word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20260101))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE[SPACE] = 0
_FOLDED = _VALUE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd multiplier, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        x = np.full(max(n, 256), _STEP, np.uint64)
        x[0] = 1
        _powers = np.cumprod(x, dtype=np.uint64)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in one array, and each row's place in it (nulls are empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


@dataclass
class Words:
    """``row``: of each word; ``first``: each row's first word, and the total at the end."""

    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray
    chars: np.ndarray  # code points in the words of each row

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(buf: np.ndarray, at: np.ndarray, fold: bool = False) -> Words:
    """The words of every row; ``fold`` takes A-Z for a-z."""
    n = len(at) - 1
    if not len(buf):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(n, np.int64))
    inside = ~SPACE[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    begins[heads] = inside[heads]  # a row's first byte begins a word though the last row ended in one
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, at)
    lead = inside & ((buf & 0xC0) != 0x80)
    total = np.concatenate(([0], np.cumsum(lead)))
    chars = total[at[1:]] - total[at[:-1]]
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), first, chars)
    buf, starts = buf[starts[0] :], starts - starts[0]
    place = np.arange(len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf))))
    value = (_FOLDED if fold else _VALUE)[buf] * powers(int(place.max()) + 1)[place]
    return Words(mix(np.add.reduceat(value, starts)), np.repeat(np.arange(n), np.diff(first)), first, chars)


def windows(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a row, and the index of each run's first word."""
    h = found.hash
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _STEP + h[k : k + n]
    where = np.flatnonzero(found.row[:n] == found.row[width - 1 :])
    return mix(total[where]), where


def per_row(flags: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many flags each of ``n`` rows has."""
    return np.bincount(row[flags], minlength=n).astype(np.int64)
