"""Words and shingles of whole texts as 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np

from glossmill.llm.common import BLOCK, IS_SPACE

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """Hashes of words, runs of bytes other than ASCII white space, in the order of texts."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, 1), _powers(_INVERSE, 1)

    def of(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False, shapes: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, and the n + 1 borders between texts; fold: A-Z count as a-z.

        With shapes, a power of two, the lowest bits of a hash tell by the word's first two bytes which of so many groups it is in.
        """
        hashes, places = [], []
        low = 0
        while low < len(data):
            high = min(len(data), low + BLOCK)
            while high < len(data) and not IS_SPACE[data[high]] and high - low < 16 * BLOCK:
                gap = np.flatnonzero(IS_SPACE[data[high : high + 4096]])
                high = high + int(gap[0]) if len(gap) else min(len(data), high + 4096)
            inner = offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, high, "left")] - low
            h, at = self._block(data[low:high], inner, fold, shapes)
            hashes.append(h)
            places.append(at + low)
            low = high
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        starts = np.concatenate(places)
        return np.concatenate(hashes), np.searchsorted(starts, offsets, "left")

    def _block(self, data: np.ndarray, borders: np.ndarray, fold: bool, shapes: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if len(self.up) <= n:
            self.up, self.down = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
        word = ~IS_SPACE[data]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        if len(borders):  # a word ends with its text
            begin[borders] |= word[borders]
            end[borders - 1] |= word[borders - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if fold:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_OF_BYTE[data] * self.up[:n], out=total[1:])
        out = mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        if shapes:
            second = np.where(ends - starts > 1, data[np.minimum(starts + 1, n - 1)], np.uint8(0))
            out &= ~np.uint64(shapes - 1)
            out |= mix(data[starts].astype(np.uint64) << np.uint64(8) | second) & np.uint64(shapes - 1)
        return out, starts


def shingles(words: np.ndarray, borders: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct hashes of size words in a row of each text, sorted; a text of fewer words has one for all of them, one without words none."""
    out = []
    step = np.array([pow(_BASE, 2 * j + 1, 1 << 64) for j in range(size)], np.uint64)
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(size):
        rolled += words[j : j + n] * step[j]
    rolled = mix(rolled)
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * step[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(words[:0])
    return out
