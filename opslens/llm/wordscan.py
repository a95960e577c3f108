"""Words of many texts at once, over their UTF-8 bytes.

A word is a longest run of ASCII digits, letters and characters outside ASCII, with A-Z read as a-z. In UTF-8 every byte
of a character outside ASCII is at least 0x80, so byte classes decide. Each word gets a 64-bit polynomial hash.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def word_hash(word: str) -> int:
    """The hash of one word, as Words has it."""
    h = sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(word.encode())) & (2**64 - 1)
    return h ^ (h >> 29)


class Words:
    """buf: lower-cased bytes; start, end: byte places; doc: whose word it is; hash."""

    def __init__(self, bodies: list[bytes], powers: Powers):
        raw = np.frombuffer(b"\n".join(bodies), np.uint8)
        self.buf = LOWER[raw]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = IN_WORD[self.buf]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = np.array([len(b) for b in bodies], np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        first = np.searchsorted(self.start, self.at)
        self.count = np.diff(np.append(first, len(self.start)))
        self.doc = np.repeat(np.arange(len(bodies)), self.count)
        self.index = np.arange(len(self.start)) - np.repeat(first, self.count)
        power, inverse = powers.upto(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=total[1:])
        h = (total[self.end] - total[self.start]) * inverse[self.start]
        self.hash = h ^ (h >> np.uint64(29))


class Powers:
    """Powers of the hash base and of its inverse, kept for a task."""

    def __init__(self):
        self.made = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.made[0]) < n:
            steps = np.full((2, n), [[BASE], [_INVERSE]], np.uint64)
            steps[:, 0] = 1
            self.made = tuple(np.cumprod(steps, axis=1))
        return self.made


class Lookup:
    """Finds which of a few known words each word is (-1: none of them)."""

    def __init__(self, words: list[str]):
        h = np.array([word_hash(w) for w in words], np.uint64)
        self.order = np.argsort(h).astype(np.int32)
        self.sorted = h[self.order]
        self.bit = np.zeros(1 << 16, bool)
        self.bit[(self.sorted & np.uint64(0xFFFF)).astype(np.int64)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.bit[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        h = hashes[maybe]
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        same = self.sorted[at] == h
        out[maybe[same]] = self.order[at[same]]
        return out
