"""Words of many texts at once, as arrays.

A word is a run of bytes other than the ASCII white space 09-0D and 20; texts are UTF-8, so
that is also a run of such characters. Words and their n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
GROUP_BYTES = 1 << 19
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < size:
        for_one = np.full(size, BASE, np.uint64)
        for_one[0] = 1
        _powers = np.multiply.accumulate(for_one)
        for_one[1:] = pow(BASE, -1, 1 << 64)
        _inverses = np.multiply.accumulate(for_one)
    return _powers[:size], _inverses[:size]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over their range, one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of some texts: ``doc`` (index of the text), ``start``, ``end``, ``hash``."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.space = (self.bytes == 32) | ((self.bytes >= 9) & (self.bytes <= 13))
        inside = np.concatenate([[False], ~self.space, [False]])
        edges = np.nonzero(inside[1:] != inside[:-1])[0]
        self.start, self.end = edges[::2], edges[1::2]
        self.doc = np.searchsorted(self.bounds, self.start, "right") - 1
        powers, inverses = _tables(len(self.bytes) + 1)
        total = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=total[1:])
        self.hash = mixed((total[self.end] - total[self.start]) * inverses[self.start])
        self.per_doc = np.bincount(self.doc, minlength=len(texts))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every n-gram that lies within one text."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = len(self.hash) - n + 1
        first = np.nonzero(self.doc[:last] == self.doc[n - 1 :])[0]
        h = self.hash[first]
        for k in range(1, n):
            h = mixed(h * np.uint64(BASE) + self.hash[first + k])
        return first, h

    def per_text(self, counted: np.ndarray) -> np.ndarray:
        """Sum over each text of a value for each byte."""
        total = np.concatenate([[0], np.cumsum(counted)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``GROUP_BYTES`` bytes together, one text at least."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        held += len(text)
        if held >= GROUP_BYTES:
            yield start, at + 1
            start, held = at + 1, 0
    if start < len(texts):
        yield start, len(texts)
