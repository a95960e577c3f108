"""Ranked lexical search over document trees that share term paths.

A document is reduced to its terms that some item asks for, most frequent first, with their occurrences (tf) and its
length factor m. In each task documents stream in blocks; a block's vectors are sorted by their paths, equal prefixes
share trie nodes, and a run of nodes without a branch is one step. A node keeps, for each term, the greatest tf below it,
and the least m below it. A term's part of a score grows with tf and falls with m, so these bound every document of the
subtree. Each item descends depth first from the root and leaves a subtree whose bound is under its 50th score so far
(or equals it, where no smaller id can be below); all items walk together, each node with those that are still alive.
Subtrees of few documents are leaves, whose documents are scored exactly. Scores are whole numbers far under 2^53, so
sums in doubles are exact. Documents alike in path, tf and m are one row with their least ``k`` ids.

Counts (N, L, df) come from all documents. Items go out in waves of at most ``WAVE_BYTES`` of text. What a task sends
on is at most ``k`` rows per item, and the tasks of the search are at most four per core.

Null texts have no term; documents without an asked term score 0 and are not returned; items that are null, empty or
without a known term return nothing; rows of one item_id are one item with the terms of all; each row of a repeated
doc_id is a document; a null doc_id comes after all others of its score; other columns, whatever their names, are not
read. A term is told by a 64-bit hash and its length. A text goes through a task in about 60 bytes of memory per byte.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.llm.rows import cut, slices, texts
from opslens.llm.wordscan import Lookup, Powers, Words

# What a term is, which letters are lowered.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WAVE_BYTES = 1 << 20
BLOCK_DOCS, LEAF_DOCS = 4096, 24
NO_ID = np.iinfo(np.int64).max
VECTORS = "doc_id long, n long, terms binary, tf binary"
HITS = "item long, doc_id long, score long"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def waves(items: DataFrame, key: str, text: str, wave_bytes: int = WAVE_BYTES):
    """Blocks of items [(item_id, terms)], streamed to the driver; a wave ends at ``wave_bytes`` of text."""
    rows = items.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull()).groupBy(
        F.col(f"`{key}`").cast("long").alias("item")).agg(F.array_join(F.collect_list(f"`{text}`"), "\n").alias("body"))
    held, size = [], 0
    for r in rows.orderBy("item").toLocalIterator():
        found = sorted(set(terms_of(r["body"])))
        if not found:
            continue
        held.append((r["item"], found))
        size += sum(map(len, found))
        if size >= wave_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def vectors(docs: DataFrame, words: list[str], key: str, text: str) -> DataFrame:
    """Per document its number of terms and, of ``words``, those that occur (by number) and how often."""
    sizes = np.array([len(w.encode()) for w in words], np.int64)

    def run(batches):
        lookup, powers, k = Lookup(words), Powers(), len(words)
        for batch in batches:
            body = batch.column(1).cast(pa.binary())
            for a, b in slices(batch, 1):
                w = Words(body.slice(a, b - a).to_pylist(), powers)
                ids = lookup.ids(w.hash)
                hit = np.flatnonzero(ids >= 0)
                hit = hit[(w.end - w.start)[hit] == sizes[ids[hit]]]
                cell, tf = np.unique(w.doc[hit] * k + ids[hit], return_counts=True)
                at = np.searchsorted(cell, np.arange(b - a + 1) * k)
                term, tf = (cell % k).astype("<i4"), tf.astype("<i4")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(w.count.astype(np.int64)),
                    pa.array([term[lo:hi].tobytes() for lo, hi in zip(at, at[1:])], pa.binary()),
                    pa.array([tf[lo:hi].tobytes() for lo, hi in zip(at, at[1:])], pa.binary())],
                    names=["doc_id", "n", "terms", "tf"])

    return texts(docs, key, text).mapInArrow(run, VECTORS)


def statistics(rows: DataFrame, k: int) -> tuple[int, int, np.ndarray]:
    """(N, L, df) over all rows; every task sends one array of counts."""

    def run(batches):
        df, docs, total = np.zeros(k, np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            for body in batch.column(1):
                df[np.frombuffer(body.as_py(), "<i4")] += 1
        yield pa.RecordBatch.from_pydict({"term": pa.array(range(-2, k), pa.int32()),
                                          "n": pa.array([docs, total, *df.tolist()], pa.int64())})

    sums = rows.select("n", "terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.collect()}  # a row per asked term
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(i, 0) for i in range(k)], np.int64)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score, without its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Best:
    """The ``k`` best (score, doc) pairs of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.full((items, k), -1, np.int64)
        self.doc = np.full((items, k), NO_ID, np.int64)
        self.floor = np.zeros(items, np.int64)  # the least score that is still of use
        self.last = np.full(items, NO_ID, np.int64)

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        s, d = np.concatenate([self.score[item], scores]), np.concatenate([self.doc[item], docs])
        at = np.lexsort((d, -s))[:self.k]
        self.score[item], self.doc[item] = s[at], d[at]
        if s[at[-1]] > 0:
            self.floor[item], self.last[item] = s[at[-1]], d[at[-1]]

    def alive(self, bound: np.ndarray, least_id: int, items: np.ndarray) -> np.ndarray:
        floor = self.floor[items]
        return (bound > floor) | ((bound == floor) & (floor > 0) & (least_id < self.last[items]))


class Tree:
    """The trie of one block of documents: (path, tf, m, ids), sorted by path."""

    def __init__(self, rows: list[tuple[bytes, bytes, int]], ids: list[np.ndarray], k: int, leaf_docs: int):
        self.ids = ids
        self.least = np.array([x[0] for x in ids], np.int64)
        self.m = np.array([r[2] for r in rows], np.int64)
        sizes = np.array([len(r[0]) // 4 for r in rows], np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = np.frombuffer(b"".join(r[0] for r in rows), ">i4").astype(np.int64)
        self.tf = np.frombuffer(b"".join(r[1] for r in rows), "<i4").astype(np.int64)
        self.shared = self._shared()
        self.leaf_docs = leaf_docs
        self.k = k

    def _shared(self) -> np.ndarray:
        """How many terms each path has in common with the one before."""
        out = np.zeros(len(self.m), np.int64)
        for i in range(1, len(out)):
            a, b = self.terms[self.at[i - 1]:self.at[i]], self.terms[self.at[i]:self.at[i + 1]]
            n = min(len(a), len(b))
            other = np.flatnonzero(a[:n] != b[:n])
            out[i] = other[0] if len(other) else n
        return out

    def children(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The subtrees of the node that holds documents [lo, hi): they part where the shared path is shortest.

        Neighbouring subtrees of few documents stay together in one leaf; a node with many thin branches is halved.
        """
        inner = self.shared[lo + 1:hi]
        edge = lo + 1 + np.flatnonzero(inner == inner.min())
        edge = np.concatenate([[lo], edge, [hi]])
        out, start = [], lo
        for a, b in zip(edge, edge[1:]):
            if b - start > self.leaf_docs and a > start:
                out.append((start, int(a)))
                start = int(a)
        out.append((start, hi))
        if len(out) == 1:
            mid = (lo + hi) // 2
            return [(lo, mid), (mid, hi)]
        return out

    def bounds(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(terms, greatest part of each below this node)."""
        a, b = self.at[lo], self.at[hi]
        top = np.zeros(self.k, np.int64)
        np.maximum.at(top, self.terms[a:b], self.tf[a:b])
        terms = np.flatnonzero(top)
        return terms, part(top[terms], self.m[lo:hi].min())

    def search(self, weights: np.ndarray, best: Best) -> None:
        """All items from the root down, depth first; ``weights`` is terms x items."""
        stack = [(0, len(self.m), np.arange(weights.shape[1]))]
        while stack:
            lo, hi, items = stack.pop()
            terms, most = self.bounds(lo, hi)
            bound = np.rint(most.astype(float) @ weights[np.ix_(terms, items)]).astype(np.int64)
            items = items[best.alive(bound, int(self.least[lo:hi].min()), items)]
            if not len(items):
                continue
            if hi - lo > self.leaf_docs:
                stack += [(a, b, items) for a, b in reversed(self.children(lo, hi))]
                continue
            self.score(lo, hi, terms, items, weights, best)

    def score(self, lo: int, hi: int, terms: np.ndarray, items: np.ndarray, weights: np.ndarray, best: Best) -> None:
        a, b = self.at[lo], self.at[hi]
        doc = np.repeat(np.arange(hi - lo), np.diff(self.at[lo:hi + 1]))
        value = np.zeros((hi - lo, len(terms)))
        value[doc, np.searchsorted(terms, self.terms[a:b])] = part(self.tf[a:b], self.m[lo:hi][doc])
        got = np.rint(value @ weights[np.ix_(terms, items)]).astype(np.int64)
        use = (got > best.floor[items]) | ((got == best.floor[items]) & (got > 0) & (self.least[lo:hi, None] < best.last[items]))
        for j in np.flatnonzero(use.any(axis=0)):
            rows = np.flatnonzero(use[:, j])
            ids = [self.ids[lo + r] for r in rows]
            best.add(int(items[j]), np.repeat(got[rows, j], [len(x) for x in ids]), np.concatenate(ids))


def block_rows(batch: pa.RecordBatch, place: np.ndarray, docs: int, total: int, k: int):
    """Rows (path, tf, m) of a batch with the least ``k`` ids of each, sorted by path."""
    n = batch.column(1).to_numpy()
    m = np.array([50 + (50 * x * docs) // total for x in n.tolist()], np.int64)  # whole numbers of any size
    ids = pc.fill_null(batch.column(0), int(NO_ID)).to_numpy()
    alike: dict[tuple[bytes, bytes, int], list[int]] = {}
    for i, (terms, tf) in enumerate(zip(batch.column(2), batch.column(3))):
        t = place[np.frombuffer(terms.as_py(), "<i4")]
        if len(t):
            order = np.argsort(t)
            path = t[order].astype(">i4").tobytes()
            alike.setdefault((path, np.frombuffer(tf.as_py(), "<i4")[order].tobytes(), int(m[i])), []).append(int(ids[i]))
    rows = sorted(alike)
    return rows, [np.array(sorted(alike[r])[:k], np.int64) for r in rows]


def candidates(rows: DataFrame, held, df: np.ndarray, docs: int, total: int, words: dict[str, int], k: int,
               block_docs: int, leaf_docs: int) -> DataFrame:
    """(item, doc_id, score): each task's best ``k`` documents of every item."""
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(df), np.int64)
    place[order] = np.arange(len(df))
    asked = [(item, [(int(place[words[t]]), weight(docs, int(df[words[t]]))) for t in found if df[words[t]]])
             for item, found in held]
    sent = rows.sparkSession.sparkContext.broadcast((place, asked))  # a wave of items: bounded by its bytes

    def run(batches):
        place, asked = sent.value
        weights = np.zeros((len(place), len(asked)))
        for j, (_, found) in enumerate(asked):
            for t, w in found:
                weights[t, j] = w
        best, names = Best(len(asked), k), np.array([item for item, _ in asked], np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, block_docs):
                own, ids = block_rows(batch.slice(a, block_docs), place, docs, total, k)
                if own:
                    Tree(own, ids, len(place), leaf_docs).search(weights, best)
        kept = best.score > 0
        doc = best.doc[kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, k)[kept.ravel()]), pa.array(doc, mask=doc == NO_ID), pa.array(best.score[kept])],
            names=["item", "doc_id", "score"])

    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(4 * cores).mapInArrow(run, HITS)


def rank(docs: DataFrame, items: DataFrame, *, k: int = 50, key: str = "doc_id", text: str = "text",
         item_key: str = "item_id", item_text: str = "text", wave_bytes: int = WAVE_BYTES,
         block_docs: int = BLOCK_DOCS, leaf_docs: int = LEAF_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    out = None
    for held in waves(items, item_key, item_text, wave_bytes):
        words = {t: i for i, t in enumerate(sorted({t for _, found in held for t in found}))}
        rows = cut(vectors(docs, list(words), key, text))
        n, total, df = statistics(rows, len(words))
        some = rows.where(F.octet_length("terms") > 0)
        found = candidates(some, held, df, n, total, words, k, block_docs, leaf_docs)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    by = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        F.col("item").alias("item_id"), "rank", "doc_id", "score")
