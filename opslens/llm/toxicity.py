"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (lengths 3 to 5, lower case, everything but letters and digits read as a
blank) in a hashed bucket. Its value is the log-count ratio of the bucket between toxic and other training texts; a
logistic regression with a ridge penalty weighs these values. Training sees labelled rows outside the held-out fold only:
``crc32(doc_id as text) mod 5 = 0`` is held out. At most ``sample_rows`` labelled rows are used (documented bound, rows
of the least hash of their id); counts and fit all come from them. The sample stays in the tasks: each pass of the fit
sends out one number a bucket and sums what comes back. Scoring reads every text whole, in blocks, with a table of one
number per bucket.

Null and empty texts score as the bias alone; rows without doc_id are scored, and count as held out is null; repeated
rows are scored alike; ids labelled twice with different marks are left out of training; with no labelled row of both
kinds, or no bucket that enough of them hold, every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.rows import cut, record, texts

BITS = 18
BUCKETS = 1 << BITS
LENGTHS = (3, 4, 5)
BLOCK = 1 << 20
FIT_TASKS = 8
STEP_ROWS = 200
_BLANK = np.array([ord(chr(i)) if chr(i).isalnum() else 32 for i in range(0x3000)], np.uint32)


def buckets(text: str):
    """Hashed n-grams of a whole text, block by block; the last n-grams of a block reach into the next one."""
    text = f" {text.lower()} "
    for at in range(0, len(text), BLOCK):
        raw = np.frombuffer(text[at:at + BLOCK + LENGTHS[-1] - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        c = np.where(raw < len(_BLANK), _BLANK[np.minimum(raw, len(_BLANK) - 1)], raw).astype(np.uint32)
        h = c * np.uint32(0x9E3779B1)
        for n in range(2, LENGTHS[-1] + 1):
            if len(h) < 2:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1:]
            if n >= LENGTHS[0]:
                got = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
                yield got[:BLOCK]


def present(text: str) -> np.ndarray:
    parts = [np.unique(b) for b in buckets(text)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


def packed(cols: np.ndarray) -> bytes:
    """Ascending bucket numbers in two bytes each: how many there are in each run of 2^16, then the rest of them."""
    runs = np.searchsorted(cols, np.arange(1 + (BUCKETS >> 16)) << 16)
    return np.diff(runs).astype("<i4").tobytes() + cols.astype("<u2").tobytes()


def unpacked(row: pa.Scalar) -> np.ndarray:
    held, runs = row.as_buffer(), BUCKETS >> 16
    each = np.frombuffer(held, "<i4", runs)
    return np.frombuffer(held, "<u2", offset=4 * runs) + np.repeat(np.arange(runs, dtype=np.int32) << 16, each)


def plain(row: pa.Scalar) -> np.ndarray:
    return np.frombuffer(row.as_buffer(), "<i4")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_ids(labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, toxic) of at most ``sample_rows`` labelled rows outside the held-out fold."""
    one = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(
        ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    same = one.where("toxic = most").select("doc_id", "toxic")
    return same.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def _passed(sample: DataFrame, scale: np.ndarray, weigh: tuple[float, float], point: np.ndarray, read) -> tuple[float, np.ndarray]:
    """Loss and gradient over the sample at ``point`` (weights, bias last), summed in tasks.

    A task sends one array of a number a column; the documents stay where they are.
    """
    m = len(scale)
    block = sample.sparkSession.sparkContext.broadcast((scale * point[:m], point[m]))  # a number a bucket

    def part(batches):
        (scaled, bias), loss, grad = block.value, 0.0, np.zeros(m + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                b = batch.slice(at, STEP_ROWS)
                lists = [read(x) for x in b.column(1)]
                size = np.array([len(x) for x in lists])
                y = b.column(0).to_numpy(zero_copy_only=False).astype(float)
                cols = np.concatenate(lists)
                sums = np.concatenate(([0.0], np.cumsum(scaled[cols])))
                end = np.cumsum(size)
                z = sums[end] - sums[end - size] + bias
                share = np.where(y > 0, weigh[1], weigh[0])
                loss += float((share * (np.logaddexp(0.0, z) - y * z)).sum())
                g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
                grad[:m] += np.bincount(cols, weights=np.repeat(g, size), minlength=m)
                grad[m] += g.sum()
        yield pa.RecordBatch.from_pydict({"loss": [loss], "grad": [grad.astype("<f8").tobytes()]})

    sums = sample.mapInArrow(part, "loss double, grad binary").collect()  # a row a task, FIT_TASKS of them
    block.unpersist()
    grad = sum((np.frombuffer(r["grad"], "<f8") for r in sums), np.zeros(m + 1))
    grad[:m] *= scale
    return sum(r["loss"] for r in sums), grad


def logistic(sample: DataFrame, scale: np.ndarray, counts: np.ndarray, ridge: float, rounds: int, memory: int = 8, read=plain) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression over (toxic, cols) rows; a row has the value scale[j] in its
    columns j, and both classes weigh the same. ``read`` takes a row's columns from its bytes.

    Limited-memory quasi-Newton steps, halved until the loss falls; at most ``rounds`` passes over the sample.
    """
    m, weigh = len(scale), (0.5 / counts[0], 0.5 / counts[1])

    def at(point):
        loss, grad = _passed(sample, scale, weigh, point, read)
        grad[:m] += ridge * point[:m]
        return loss + 0.5 * ridge * float(point[:m] @ point[:m]), grad

    point, pairs, passes, step = np.zeros(m + 1), [], 1, 1.0
    loss, grad = at(point)
    while passes < rounds and np.abs(grad).max() > 1e-6:
        way, told = grad.copy(), []
        for s, d, r in reversed(pairs):
            told.append(r * (s @ way))
            way -= told[-1] * d
        way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1.0 / max(1.0, np.abs(grad).sum())
        for (s, d, r), a in zip(pairs, reversed(told)):
            way += (a - r * (d @ way)) * s
        slope, step, better = float(grad @ way), 1.0, None
        while passes < rounds:
            there = point - step * way
            new_loss, new_grad = at(there)
            passes += 1
            if new_loss <= loss - 1e-4 * step * slope:
                better = there
                break
            step /= 2
        if better is None:
            break
        s, d = better - point, new_grad - grad
        if s @ d > 1e-12:
            pairs = [*pairs, (s, d, 1.0 / (s @ d))][-memory:]
        small = loss - new_loss <= 1e-7 * abs(loss)
        point, loss, grad = better, new_loss, new_grad
        if small:
            break
    return point[:m], float(point[m])


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 16_000, least_docs: int = 10,
          smooth: float = 1.0, ridge: float = 0.03, rounds: int = 60) -> tuple[np.ndarray, float] | None:
    """(one number per bucket, bias), from a bounded sample of labelled rows; None without rows of both kinds or features.

    Every bucket that ``least_docs`` rows of the sample hold is a feature. ``least_docs`` and ``ridge`` were chosen on a
    fold of the training rows.
    """
    ids = cut(training_ids(labels, sample_rows))
    # the sample's ids are at most sample_rows pairs of numbers: a bounded broadcast
    rows = texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("toxic").cast("int"))

    def listed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(2), "cols": pa.array(
                [packed(present(body.as_py())) for body in batch.column(1)], pa.binary())})

    # each text is read once; the written rows hold at most a number a bucket and are read in every pass
    sample = cut(rows.repartition(FIT_TASKS).mapInArrow(listed, "toxic int, cols binary"))

    def counts(batches):
        got = np.zeros((2, BUCKETS), np.int64)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for y, cols in zip(batch.column(0).to_pylist(), batch.column(1)):
                got[y, unpacked(cols)] += 1
                n[y] += 1
        if n.any():
            yield pa.RecordBatch.from_pydict({"n": [n.astype("<i8").tobytes()], "got": [got.astype("<i4").tobytes()]})

    sums = sample.mapInArrow(counts, "n binary, got binary").collect()  # an array of counts a task
    n = sum((np.frombuffer(r["n"], "<i8") for r in sums), np.zeros(2, np.int64))
    got = sum((np.frombuffer(r["got"], "<i4").reshape(2, BUCKETS) for r in sums), np.zeros((2, BUCKETS)))
    if not n.all():
        return None
    ratio = np.log((got[1] + smooth) / (n[1] + 2 * smooth)) - np.log((got[0] + smooth) / (n[0] + 2 * smooth))
    feature = np.flatnonzero(got.sum(0) >= least_docs)
    if not len(feature):
        return None
    number = np.full(BUCKETS, -1, np.int32)
    number[feature] = np.arange(len(feature))
    sent = docs.sparkSession.sparkContext.broadcast(number)  # a number a bucket

    def numbered(batches):
        for batch in batches:
            own = [sent.value[unpacked(x)] for x in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(0), "cols": pa.array(
                [packed(x[x >= 0]) for x in own], pa.binary())})

    # the passes read, and send, a number a feature instead of one a bucket
    slim = cut(sample.mapInArrow(numbered, "toxic int, cols binary"))
    w, b = logistic(slim, ratio[feature], n, ridge, rounds, read=unpacked)
    weights = np.zeros(BUCKETS, np.float32)
    weights[feature] = w * ratio[feature]
    return weights, b


class Scorer:
    """Sum of the table over the distinct buckets of a text."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias
        self.seen = np.zeros(BUCKETS, np.int64)
        self.turn = 0

    def score(self, text: str) -> float:
        z = self.bias
        self.turn += 1
        for b in buckets(text):
            b = b[self.table[b] != 0]
            b = b[self.seen[b] != self.turn]
            if len(b):
                b = np.unique(b)
                self.seen[b] = self.turn
                z += float(self.table[b].astype(np.float64).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, *, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        scorer = Scorer(*model) if model else None
        for batch in batches:
            yield record({"doc_id": batch.column(0),
                          "score": [scorer.score(b.as_py()) if scorer else 0.0 for b in batch.column(1)]}, schema)

    got = texts(docs, key, text).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float] | None, *, text: str = "text",
               reject_from: float = 0.5) -> DataFrame:
    """The rows whose text scores under ``reject_from``, with all their columns."""
    if model is None:
        return docs

    def clean(batches):
        scorer = Scorer(*model)
        for batch in batches:
            body = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([scorer.score(b or "") < reject_from for b in body], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
