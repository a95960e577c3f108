"""Cost-balanced packing of documents into sequences of bounded length.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention stays inside a piece). Each task reads its
documents in windows of ``window_tokens``; within a window, documents longer than a sequence give whole sequences first,
and what remains of each document is placed in descending length on the sequence of the lowest cost among those with
room for it. A window opens as many sequences as its tokens need, so fewer than ``capacity`` tokens of a window are
padding. Where no sequence has room for a whole document, it is cut: the roomiest sequence is filled and the rest goes
on. Nothing is shuffled; a lost task is simply run again over its part of the input and gives the same sequences.

Null and empty texts hold the end token alone; repeated rows are packed as often as they occur; ties go to the earlier
document and the lower sequence; an empty table gives no rows. ``sequence_id`` numbers the windows of each partition.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from opslens.llm.rows import record, texts
from opslens.llm.tokens import worker_cache

CAPACITY = 2048
END_ID = 1
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "cost double")
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                   ("cost", pa.float64())])


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float):
    """Places documents of these lengths; returns (pieces, sequences used).

    A piece is (document, start, length, sequence, offset).
    """
    pieces, rest = [], []
    used = 0
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            pieces.append((d, at, capacity, used, 0))
            used, at = used + 1, at + capacity
        if n > at:
            rest.append((at - n, d, at))
    open_ = -(-sum(-r[0] for r in rest) // capacity)
    room, cost = np.full(open_, capacity), np.zeros(open_)
    heapq.heapify(rest)
    while rest:
        n, d, at = heapq.heappop(rest)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        s = int(fits.argmin())
        if not np.isfinite(fits[s]):
            s = int(room.argmax())
            heapq.heappush(rest, (int(room[s]) - n, d, at + int(room[s])))
            n = int(room[s])
        pieces.append((d, at, n, used + s, capacity - int(room[s])))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
    return pieces, used + open_


def pack(docs: DataFrame, *, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / 1024,
         end_id: int = END_ID, window_tokens: int = 4 << 20, vocabulary: str | None = None, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per piece: its document, its place there, its checksum, its sequence and its place in that."""

    def run(batches):
        cache, end = worker_cache(vocabulary), np.array([end_id], "<u4").tobytes()
        base, window, held = TaskContext.get().partitionId() << 33, [], 0

        def close():
            nonlocal base, window, held
            pieces, n = balance([len(ids) // 4 for _, ids in window], capacity, linear, quadratic)
            out = {f.name: [] for f in ARROW}
            for d, at, size, seq, off in pieces:
                doc, ids = window[d]
                for name, x in zip(out, (doc, at, size, zlib.crc32(memoryview(ids)[4 * at:4 * (at + size)]),
                                         len(ids) // 4, base + seq, off, linear * size + quadratic * size * size)):
                    out[name].append(x)
            base, window, held = base + n, [], 0
            return record(out, ARROW)

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = cache.ids(body.as_py()) + end
                window.append((doc, ids))
                held += len(ids) // 4
                if held >= window_tokens:
                    yield close()
        if window:
            yield close()

    return texts(docs, key, text).mapInArrow(run, PIECES)
