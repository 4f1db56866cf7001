"""Whole Arrow batches of text as byte arrays: words, hashes and prefixes without a Python loop.

Used inside tasks only. A batch is worked off in parts of about ``PART_BYTES`` of text,
so memory does not grow with the batch; a longer text is a part of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_WORD = np.zeros(256, dtype=bool)  # digits, ASCII letters and every byte of other characters
IS_WORD[ord("0") : ord("9") + 1] = True
IS_WORD[ord("A") : ord("Z") + 1] = True
IS_WORD[ord("a") : ord("z") + 1] = True
IS_WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 to n-1, modulo 2**64."""
    if not _powers or len(_powers["p"]) < n:
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 2**64))):
            factors = np.full(max(n, PART_BYTES + 1), base, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["p"][:n], _powers["i"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX1
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offset of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    column = pc.fill_null(column, b"")
    large = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def parts(offsets: np.ndarray, limit: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of some texts: byte ranges, hashes and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD):
        self.data, self.offsets = LOWER[data], offsets
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = is_word[data]
        opens = inside[1:] & ~inside[:-1]
        closes = inside[:-1] & ~inside[1:]
        # A text's first byte opens a word, and its end closes one, whatever the neighbour holds.
        edges = offsets[(offsets > 0) & (offsets < n)]
        opens[edges] = inside[1:][edges]
        closes[edges] = inside[:-1][edges]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes)
        self.first = np.searchsorted(self.starts, offsets)
        p, self._inverse = powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
        self._sums = sums

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return mixed((self._sums[self.ends] - self._sums[self.starts]) * self._inverse[self.starts])

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of at least ``k`` bytes, and hashes of their first ``k``."""
        long = np.flatnonzero(self.ends - self.starts >= k)
        at = self.starts[long]
        return long, mixed((self._sums[at + k] - self._sums[at]) * self._inverse[at] + np.uint64(k))


def word_parts(column: pa.Array, is_word: np.ndarray = IS_WORD) -> Iterator[tuple[int, int, Words]]:
    """The words of a column, part by part, with the rows of the part."""
    data, offsets = flat(column)
    for lo, hi in parts(offsets):
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], is_word)


def word_hash(word: str) -> int:
    """The hash that ``Words.hashes`` gives a word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)]), np.ones(256, dtype=bool)).hashes()[0])
