"""Small Arrow/numpy helpers that run inside Spark tasks on one batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCORE_DIGITS = 9


def java_hash(text: str) -> int:
    """32-bit string hash over UTF-16 units: h = 31*h + unit, wrapping."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.uint32)
    if not len(units):
        return 0
    powers = np.cumprod(np.concatenate(([1], np.full(len(units) - 1, 31))).astype(np.uint32), dtype=np.uint32)[::-1]
    h = int(np.sum(units * powers, dtype=np.uint32))
    return h - (1 << 32) if h >= 1 << 31 else h


def fake_vectors(texts: list[str], dim: int) -> np.ndarray:
    """Deterministic stand-in vectors: seed = seed*31 + i in wrapping 64 bits, remainder by 1000 over 1000."""
    seed = np.array([java_hash(t) for t in texts], dtype=np.int64)
    out = np.empty((len(texts), dim), dtype=np.float32)
    with np.errstate(over="ignore"):
        for i in range(dim):
            seed = seed * np.int64(31) + np.int64(i)
            out[:, i] = np.fmod(seed, 1000).astype(np.float32) / np.float32(1000)
    return out


def list_matrix(col: pa.Array) -> np.ndarray:
    """A column of equal-length number lists as a float64 matrix; a missing list is a zero row."""
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    n = int(valid.sum())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(col), len(flat) // n if n else 0))
    out[valid] = flat.reshape(n, -1) if n else 0
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN, which ranks last everywhere."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norm > 0, m / norm, np.nan)


NEAR_ROWS, NEAR_PAIRS = 4_096, 65_536


def nearest_rows(q: np.ndarray, c: np.ndarray, k: int, bound: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, distance), among them each query's ``k`` nearest rows of ``c``; all rows have length one.

    Single precision rules rows out, with room for its error; those left are measured in double. With ``bound``, a
    distance for each query, farther rows are left out.
    """
    slack = (q.shape[1] + 16) * 2.5e-7
    q32, bar = q.astype(np.float32), None if bound is None else 1.0 - bound
    for at in range(0, len(c), NEAR_ROWS):
        s = q32 @ c[at:at + NEAR_ROWS].astype(np.float32).T
        least = np.full(len(q), -np.inf) if bar is None else bar
        if s.shape[1] > k and not (least > -np.inf).all():
            least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            bar = least
        r, j = np.nonzero(s >= (least - slack).astype(np.float32)[:, None])
        for i in range(0, len(r), NEAR_PAIRS):
            a, b = r[i:i + NEAR_PAIRS], j[i:i + NEAR_PAIRS] + at
            yield a, b, np.round(1.0 - np.einsum("ij,ij->i", q[a], c[b]), SCORE_DIGITS) + 0.0


class CosineScorer:
    """Cosine distance of a fixed block of query vectors to corpus rows; lower is better."""

    def __init__(self, vectors: pa.Array):
        self.q = unit_rows(list_matrix(vectors))

    def scores(self, feature: pa.Array, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        c = unit_rows(list_matrix(feature.take(pa.array(rows))))
        if not c.size or not self.q.size:
            return np.full((len(rows), len(queries)), np.nan)
        return np.round(1.0 - c @ self.q[queries].T, SCORE_DIGITS) + 0.0  # no negative zero

    def keep(self, scores: np.ndarray) -> np.ndarray:
        return np.ones_like(scores, dtype=bool)


class TrigramScorer:
    """Negated trigram similarity (shared / united); rows at or under the threshold are not candidates."""

    BLOCK = 256

    def __init__(self, grams: pa.Array, threshold: float):
        self.threshold = threshold
        flat = grams.flatten()
        self.vocab = pc.unique(flat)
        self.q_size = np.diff(grams.offsets.to_numpy()).astype(np.int64)
        self.q = np.zeros((len(grams), max(len(self.vocab), 1)), dtype=np.float32)
        if len(flat):
            at = pc.index_in(flat, value_set=self.vocab).to_numpy(zero_copy_only=False)
            self.q[np.repeat(np.arange(len(grams)), self.q_size), at] = 1.0

    def scores(self, feature: pa.Array, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        lists = feature.take(pa.array(rows))
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        at = pc.index_in(lists.flatten(), value_set=self.vocab)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(rows)), size)[known]
        at = at.drop_null().to_numpy(zero_copy_only=False)
        q = self.q[queries]
        out = np.empty((len(rows), len(queries)))
        for lo in range(0, len(rows), self.BLOCK):
            hi = min(lo + self.BLOCK, len(rows))
            a, b = np.searchsorted(owner, [lo, hi])
            dense = np.zeros((hi - lo, q.shape[1]), dtype=np.float32)
            dense[owner[a:b] - lo, at[a:b]] = 1.0
            shared = np.rint(dense @ q.T).astype(np.float64)
            united = size[lo:hi, None] + self.q_size[queries][None, :] - shared
            with np.errstate(invalid="ignore", divide="ignore"):
                out[lo:hi] = np.where(united > 0, -(shared / united), 0.0)
        return out

    def keep(self, scores: np.ndarray) -> np.ndarray:
        return -scores > self.threshold
