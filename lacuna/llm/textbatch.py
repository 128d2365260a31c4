"""Whole texts of an Arrow batch as flat numpy arrays: words, word hashes and shingles without a Python loop over words.

Words are maximal runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return. Texts are
taken whole; a batch is worked through in slices of about ``SLICE_BYTES`` so that the arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
WORDS_PER_SHINGLE = 5

_random = np.random.default_rng(20240607)
_BYTE_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_CODES = _BYTE_CODES.copy()
_LOWER_CODES[65:91] = _BYTE_CODES[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACES = _random.integers(1, 2**63, WORDS_PER_SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64; kept for the next call."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(steps)
    return have[:n]


class Texts:
    """Some whole texts: ``data`` bytes, ``bounds`` (n + 1 byte offsets), word ``start``/``end`` and ``first_word`` (n + 1)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        space = _IS_SPACE[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = space[1:] != space[:-1]
        edge[bounds] = True  # a word never runs on into the next text
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        words = ~space[start] if len(start) else np.zeros(0, bool)
        self.start, self.end = start[words], end[words]
        self.first_word = np.searchsorted(self.start, bounds)
        self.n_words = np.diff(self.first_word)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def word_hashes(self, lower: bool = True) -> np.ndarray:
        """Equal words (A-Z lower-cased if ``lower``) have equal hashes."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER_CODES if lower else _BYTE_CODES)[self.data] * powers(_BASE, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * powers(_BASE_INVERSE, n + 1)[self.start] + (self.end - self.start).astype(np.uint64))

    def shingles(self) -> list[np.ndarray]:
        """The distinct 5-word shingles of each text, sorted; fewer words: the whole sequence as one; no words: empty."""
        words = self.word_hashes()
        windows = np.zeros(max(0, len(words) - WORDS_PER_SHINGLE + 1), np.uint64)
        for k in range(WORDS_PER_SHINGLE):
            windows += words[k : k + len(windows)] * _PLACES[k]
        windows, out = mix(windows), []
        for a, b in zip(self.first_word[:-1], self.first_word[1:], strict=True):
            if b - a >= WORDS_PER_SHINGLE:
                out.append(np.unique(windows[a : b - WORDS_PER_SHINGLE + 1]))
            elif b > a:
                out.append(mix((words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def slices(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SLICE_BYTES, "right")) - 1)
        yield a, b, Texts(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        a = b
