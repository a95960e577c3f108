"""Packed id matrices: best-fit-decreasing with a segment tree over the free room of the open sequences.

Documents longer than a sequence are split losslessly into full sequences and a rest; the rests of a window are placed
in descending length, each in the fullest sequence that still has room, else in a new one. The tree holds, for every
amount of free room, how many open sequences have it, so the tightest fit is found in log2(capacity) steps.

Each output row is one row of the id matrix: ``capacity`` little-endian unsigned 16-bit ids (padded), the documents in
it with the first id of each piece, the cumulative segment lengths, and the places where positions start again. Rows are
written by Spark's own writers, so they may go to any store; ``matrix`` turns the ids of collected rows into an array.

Null and empty texts hold the end token alone; repeated rows are packed as often as they occur; ties go to the earlier
document and the sequence opened last; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from opslens.llm.rows import record, texts
from opslens.llm.tokens import worker_cache

CAPACITY = 2048
END_ID = 49407
ROWS = ("sequence_id long, n_tokens int, ids binary, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, "
        "position_resets array<int>")
ARROW = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
                   ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
                   ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32()))])


class Rooms:
    """Open sequences by free room; finds the least room that is large enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, sequence: int) -> None:
        if room:
            self.open[room].append(sequence)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(sequence, its room) with the least room >= need; it leaves the tree."""
        i, count = need + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length)."""
    sequences, rest, rooms = [], [], Rooms(capacity)
    for d, n in enumerate(lengths):
        whole = n // capacity
        sequences += [[(d, i * capacity, capacity)] for i in range(whole)]
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    for n, d, at in sorted(rest, key=lambda r: (-r[0], r[1])):
        got = rooms.take(n)
        if got is None:
            got = len(sequences), capacity
            sequences.append([])
        s, room = got
        sequences[s].append((d, at, n))
        rooms.put(room - n, s)
    return sequences


def pack_matrix(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = 0,
                window_tokens: int = 4 << 20, vocabulary: str | None = None, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """One row per packed sequence."""

    def run(batches):
        cache, base, window, held = worker_cache(vocabulary), TaskContext.get().partitionId() << 33, [], 0

        def close():
            nonlocal base, window, held
            done = best_fit([len(ids) for _, ids in window], capacity)
            for at in range(0, len(done), 1024):
                part = done[at:at + 1024]
                out = {f.name: [] for f in ARROW}
                for k, pieces in enumerate(part):
                    cu = np.cumsum([0, *(n for _, _, n in pieces)]).tolist()
                    row = np.full(capacity, pad_id, "<u2")
                    row[:cu[-1]] = np.concatenate([window[d][1][s:s + n] for d, s, n in pieces])
                    for name, x in zip(out, (base + at + k, cu[-1], row.tobytes(), [window[p[0]][0] for p in pieces],
                                             [p[1] for p in pieces], cu, cu[:-1])):
                        out[name].append(x)
                yield record(out, ARROW)
            base, window, held = base + len(done), [], 0

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(np.frombuffer(cache.ids(body.as_py()), "<u4"), end_id).astype("<u2")
                window.append((doc, ids))
                held += len(ids)
                if held >= window_tokens:
                    yield from close()
        if window:
            yield from close()

    return texts(docs, key, text).mapInArrow(run, ROWS)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Writes the rows as Parquet, the ids of a file's rows one after another: a matrix of ``capacity`` columns."""
    packed.write.mode("overwrite").parquet(path)


def matrix(ids: list[bytes], capacity: int = CAPACITY) -> np.ndarray:
    return np.frombuffer(b"".join(ids), "<u2").reshape(-1, capacity)
