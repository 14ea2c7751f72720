"""Words, lines and their hashes for a batch of texts at once, on the UTF-8 bytes.

Words are the maximal runs without space or control white space (0x20, 0x09 to 0x0D); those
bytes occur in UTF-8 only as themselves. Hashes are 64 bits: a polynomial over a random
table of the bytes, taken from running sums, so a batch costs a fixed number of array
operations however many words it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_TABLE = _TABLE.copy()
_LOWER_TABLE[65:91] = _TABLE[97:123]
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(which: str, size: int) -> np.ndarray:
    have = _POWERS[which]
    if len(have) < size:
        steps = np.full(max(size, 1 << 20), _BASE if which == "up" else _BASE_INVERSE, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 1 << 22:  # longer ones serve one long text and are not kept
            _POWERS[which] = have
    return have[:size]


def arrow_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more for the end)."""
    wide = texts.cast(pa.large_string())
    if isinstance(wide, pa.ChunkedArray):
        wide = wide.combine_chunks()
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def counts_per(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between neighbouring bounds."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


class Texts:
    """One batch: raw bytes, text bounds, and its words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.raw, self.bounds = arrow_bytes(texts)
        self.size = len(texts)
        raw, bounds = self.raw, self.bounds
        self._prefix = None
        self._lower = lower
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        self.inside = inside
        before = np.zeros(len(raw), bool)
        after = np.zeros(len(raw), bool)
        if len(raw):
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            filled = bounds[:-1] < bounds[1:]
            before[bounds[:-1][filled]] = False
            after[bounds[1:][filled] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: First word of each text (one more for the end).
        self.word_bounds = np.searchsorted(self.starts, bounds)
        self.docs = np.repeat(np.arange(self.size), np.diff(self.word_bounds))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range."""
        if self._prefix is None:
            table = _LOWER_TABLE if self._lower else _TABLE
            parts = table[self.raw] * _powers("up", len(self.raw))
            self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])
        down = _powers("down", len(self.raw) + 1)
        span = (self._prefix[ends] - self._prefix[starts]) * down[starts]
        return mix(span + (ends - starts).astype(np.uint64) * _BASE)

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k neighbouring words of one text, and the index of the first word."""
        words = self.word_hashes()
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(self.docs[:n] == self.docs[k - 1 :])
        return mix(_combine([words[first + j] for j in range(k)], k)), first

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds per text) of the distinct k-word windows, ascending in each text;
        a text with fewer words has one for its whole sequence, one without words none."""
        hashes, first = self.windows(k)
        docs = self.docs[first]
        counts = np.diff(self.word_bounds)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            words = self.word_hashes()
            more = []
            for d in short:
                a, b = self.word_bounds[d], self.word_bounds[d + 1]
                more.append(mix(_combine([words[i : i + 1] for i in range(a, b)], b - a))[0])
            hashes = np.concatenate([hashes, np.array(more, np.uint64)])
            docs = np.concatenate([docs, short])
        order = np.lexsort((hashes, docs))
        hashes, docs = hashes[order], docs[order]
        fresh = np.ones(len(hashes), bool)
        if len(hashes):
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
        hashes, docs = hashes[fresh], docs[fresh]
        return hashes, np.searchsorted(docs, np.arange(self.size + 1))


def _combine(words: list[np.ndarray], k: int) -> np.ndarray:
    total = np.full(len(words[0]), np.uint64(k), np.uint64)
    for w in words:
        total = total * _BASE + w
    return total


def repeats(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, whether its (group, value) occurs more than once, and whether it
    occurred at an earlier place."""
    order = np.lexsort((np.arange(len(values)), values, groups))
    g, v = groups[order], values[order]
    same = np.zeros(len(values), bool)
    if len(values):
        same[1:] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    several = same.copy()
    if len(values):
        several[:-1] |= same[1:]
    out = np.zeros((2, len(values)), bool)
    out[0][order], out[1][order] = several, same
    return out[0], out[1]
