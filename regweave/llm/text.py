"""Vectorised views of Arrow text columns: words, word hashes, windows and line hashes in numpy.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Texts are processed in slices of about a
megabyte, so memory is bounded by the slice (or by one longer text), not by the Arrow batch.
Hashes have 64 bits: two different words, windows or lines of one text collide with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WINDOW = np.random.Generator(np.random.PCG64(31)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CONTINUATION = np.zeros(256, bool)
CONTINUATION[0x80:0xC0] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[0xC3:0xF5] = True  # lead bytes of letters outside ASCII count as letters
LOWER_MAP = np.arange(256, dtype=np.uint8)
LOWER_MAP[65:91] += 32


def table(chars: str) -> np.ndarray:
    """Membership table of ASCII characters."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE_BYTES + 4096)
        steps = np.full(size, _BASE, np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        steps[0] = back[0] = 1
        _pow, _inv = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    return _pow, _inv


class Texts:
    """Some texts laid end to end, with per-text sums, words, windows and lines."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False):
        self.raw = data
        self.data = LOWER_MAP[data] if lower else data
        self.start, self.end, self.n = start, end, len(start)
        self._prefix: np.ndarray | None = None
        self._words: tuple | None = None

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Per text, how many positions of a byte mask are set."""
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.end] - c[self.start]

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            power, _ = _powers(len(self.data) + 1)
            p = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=p[1:])
            self._prefix = p
        return self._prefix

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
        p, (_, inv) = self.prefix(), _powers(len(self.data) + 1)
        return mix((p[end] - p[start]) * inv[start])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, word ends, first word of each text, number of words of each text."""
        if self._words is None:
            w = ~SPACE[self.data]
            before, after = np.zeros_like(w), np.zeros_like(w)
            before[1:], after[:-1] = w[:-1], w[1:]
            real = self.end > self.start
            before[self.start[real]] = False
            after[self.end[real] - 1] = False
            starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
            first = np.searchsorted(starts, self.start)
            self._words = starts, ends, first, np.searchsorted(starts, self.end) - first
        return self._words

    def word_hashes(self) -> np.ndarray:
        starts, ends, _, _ = self.words()
        return self.hash_spans(starts, ends)

    def windows(self, width: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and first word of every window of ``width`` words inside one text, and windows per text."""
        h = self.word_hashes() if hashes is None else hashes
        _, _, first, n = self.words()
        per = np.maximum(n - width + 1, 0)
        at = ranges(first, per)
        if not len(at):
            return np.zeros(0, np.uint64), at, per
        g = h[at] * _WINDOW[0]
        for k in range(1, width):
            g = g + h[at + k] * _WINDOW[k]
        return mix(g), at, per

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every ``\\n``-separated line that has a word, and the text it is in."""
        cut = np.flatnonzero(self.data == 10)
        real = np.flatnonzero(self.end > self.start)
        ls = np.concatenate([self.start[real], cut + 1])
        le = np.concatenate([cut, self.end[real]])
        ls.sort()
        le.sort()
        # a break at the very end of a text opens a line that starts where the next text does; pairing by rank stays right
        starts = self.words()[0]
        has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
        ls, le = ls[has], le[has]
        return ls, le, np.searchsorted(self.end, ls, side="right")


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i] .. first[i] + count[i] - 1`` for all i, concatenated."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    offset = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return offset + np.arange(total)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the key occurs more than once; the key occurred before (in position order)."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) over a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(off, off[row] + limit, side="right")) - 1)
        lo, hi = off[row], off[stop]
        yield row, stop, Texts(raw[lo:hi], off[row:stop] - lo, off[row + 1 : stop + 1] - lo, lower)
        row = stop


def shingles(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text as (text index, hash), sorted; a text of fewer words is one shingle."""
    h = t.word_hashes()
    _, _, first, n = t.words()
    g, _, per = t.windows(width, h)
    doc = np.repeat(np.arange(t.n), per)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = n[short].astype(np.uint64) * _WINDOW[width]
        for k in range(width - 1):
            has = n[short] > k
            whole[has] += h[first[short[has]] + k] * _WINDOW[k]
        doc, g = np.concatenate([doc, short]), np.concatenate([g, mix(whole)])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], g[new]


def within(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys that are equal only inside the same text."""
    return mix(keys + text.astype(np.uint64) * _WINDOW[40])
