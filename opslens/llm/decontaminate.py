"""Benchmark passages in documents: q-gram lemma, diagonal bands, banded alignment.

Texts are compared in lower case with every run of characters other than letters and digits read as one blank. An item
of m characters may occur with up to ``k = floor(edit_rate * m)`` edits. An occurrence then shares at least
``m - q + 1 - k q`` q-grams with it, all on at most ``2k + 1`` neighbouring diagonals (document place minus item place).
Diagonals are cut into bands of twice that width, overlapping by half, so every occurrence lies whole in a band. Bands
with enough shared q-grams are kept and their regions aligned inside the band; an alignment within the budget is a
match. If the bound would fall under one q-gram, q is lowered for the item.

What is looked for depends on an item's length in that form. Under ``exact_under`` characters it must stand word for
word, between word limits, as so short a text resembles too much within edits. Up to ``segment_chars`` it is looked for
whole, and by its core, the middle ``core`` of it, in whose own budget it must stand: every quote of the item's middle,
and so every quote of ``(1 + core) / 2`` of it, is found. A longer item is looked for by segments of that length which
overlap by half, each with its own budget; an item within its budget as a whole has a segment within its own, and no
alignment is longer than a segment.

The benchmark is a stated query set: its items pass through the driver in blocks of at most ``block_bytes`` of text, and
each block is held against all documents in one scan. Documents are never shuffled.

Null and empty texts and items match nothing (nor do items under ``least_chars`` characters, if that is set); repeated
rows match each time; an item found in a document gives one row: the whole item before its parts, then least edits, then
the first place; an item without id has a null item_id; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.rows import texts

Q = 8
BITS = 20
EXACT_UNDER = 40
CORE = 0.7
SEGMENT_CHARS = 1000
MATCHES = "doc_id long, item_id long, edits int, start long, end long, part string"
_RUN = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _RUN.sub(" ", text.lower()).strip()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams of a text."""
    if len(c) < q:
        return np.zeros(0, np.uint32)
    h = c[:len(c) - q + 1] * np.uint32(0x9E3779B1)
    for i in range(1, q):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[i:len(c) - q + 1 + i]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(13))


class Block:
    """Needles with a common q and their q-gram postings; ``items`` are pairs of any name and a text."""

    def __init__(self, items: list[tuple[object, str]], q: int, edit_rate: float):
        self.q, self.items = q, items
        self.codes = [codes(t) for _, t in items]
        self.size = np.array([len(c) for c in self.codes])
        self.budget = np.floor(edit_rate * self.size).astype(np.int64)
        self.need = self.size - q + 1 - self.budget * q
        each = [grams(c, q) for c in self.codes]
        g = np.concatenate(each)
        item = np.repeat(np.arange(len(items)), [len(x) for x in each])
        place = np.concatenate([np.arange(len(x)) for x in each])
        by = np.argsort(g, kind="stable")
        self.gram, self.first, self.count = np.unique(g[by], return_index=True, return_counts=True)
        self.item, self.place = item[by].astype(np.int32), place[by].astype(np.int32)
        self.bit = np.zeros(1 << BITS, bool)
        self.bit[self.gram >> np.uint32(32 - BITS)] = True

    def matches(self, c: np.ndarray):
        """(item, edits, first, end) of the best occurrence of each item in a text."""
        g = grams(c, self.q)
        at = np.flatnonzero(self.bit[g >> np.uint32(32 - BITS)])
        if len(at) < self.need.min():
            return
        k = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
        same = self.gram[k] == g[at]
        at, k = at[same], k[same]
        n = self.count[k]
        if n.sum() < self.need.min():
            return
        posting = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, where = self.item[posting], np.repeat(at, n)
        often = np.bincount(item, minlength=len(self.items)) >= self.need
        chosen = np.flatnonzero(often[item])
        if not len(chosen):
            return
        item, where = item[chosen], where[chosen]
        place = self.place[posting[chosen]]
        by = np.argsort(item, kind="stable")
        bounds = np.searchsorted(item[by], np.flatnonzero(often), side="left").tolist() + [len(by)]
        for i, lo, hi in zip(np.flatnonzero(often), bounds, bounds[1:]):
            found = self.best(int(i), c, where[by[lo:hi]], place[by[lo:hi]])
            if found:
                yield int(i), *found

    def best(self, i: int, c: np.ndarray, where: np.ndarray, place: np.ndarray):
        """(edits, first, end) of the best alignment of item i over the bands with enough shared q-grams."""
        budget, need, m = int(self.budget[i]), int(self.need[i]), int(self.size[i])
        wide = 2 * budget + 1
        diagonal = where - place
        low = int(diagonal.min()) - wide
        half = (diagonal - low) // wide
        per = np.bincount(half)
        band = per + np.append(per[1:], 0)  # two neighbouring halves make a band
        best = None
        for b in np.flatnonzero(band >= need):
            own = (half == b) | (half == b + 1)
            # shared q-grams pair off: they take as many different places in the item as in the document
            if min(len(np.unique(place[own])), len(np.unique(where[own]))) < need:
                continue
            got = align(self.codes[i], c, low + int(b) * wide, low + int(b + 2) * wide, budget)
            if got and (best is None or got < best):
                best = got
        return best


def align(p: np.ndarray, c: np.ndarray, d0: int, d1: int, budget: int):
    """(edits, first, end): the item p whole against any stretch of c on diagonals [d0, d1), within the budget."""
    m, width = len(p), d1 - d0
    for d in range(max(d0, 0), min(d1, len(c) - m + 1)):  # word for word, the common case
        if c[d] == p[0] and c[d + m - 1] == p[-1] and np.array_equal(c[d:d + m], p):
            return 0, d, d + m
    far = budget + 1
    # row i holds, for each diagonal j, the edits of p[:i] against c ending before place i + d0 + j
    place = np.arange(d0, d1)
    inside = (place >= 0) & (place <= len(c))
    cost = np.where(inside, 0, far)
    start = place.copy()
    step = np.arange(width)
    padded = np.concatenate([np.full(max(0, -d0) + 1, 0xFFFFFFFF, np.uint32), c,
                             np.full(max(0, d1 + m - len(c)) + 1, 0xFFFFFFFF, np.uint32)])
    shift = max(0, -d0) + 1
    for i in range(1, m + 1):
        row = padded[shift + i - 1 + d0:shift + i - 1 + d1]
        new, origin = cost + (row != p[i - 1]), start
        up = np.append(cost[1:], far) + 1  # an item character without a partner: the next diagonal of the row above
        less = up < new
        new, origin = np.where(less, up, new), np.where(less, np.append(start[1:], 0), origin)
        run = np.minimum.accumulate(new - step)  # text characters without a partner
        src = np.maximum.accumulate(np.where(new - step == run, step, 0))
        cost, start = np.minimum(run + step, far), origin[src]
        ends = place + i
        cost = np.where((ends >= 0) & (ends <= len(c)), cost, far)
        if cost.min() > budget:
            return None
    j = int(cost.argmin())
    return (int(cost[j]), int(start[j]), int(place[j] + m)) if cost[j] <= budget else None


def blocks(benchmark: DataFrame, least_chars: int, block_bytes: int, key: str, text: str):
    """Blocks of items, at most ``block_bytes`` of text each (or one longer item), streamed to the driver one after
    another."""
    held, size = [], 0
    rows = benchmark.select(F.col(f"`{key}`").cast("long").alias("item"), F.col(f"`{text}`").alias("text")).where(
        "text is not null")
    for r in rows.toLocalIterator():
        t = normal(r["text"])
        if len(t) < max(1, least_chars):
            continue
        own = len(t.encode("utf-8", "surrogatepass"))
        if held and size + own > block_bytes:
            yield held
            held, size = [], 0
        held.append((r["item"], t))
        size += own
    if held:
        yield held


def parts(t: str, exact_under: int, core: float, segment_chars: int) -> list[tuple[str, int, int]]:
    """(part, first, end): the stretches of an item of ``exact_under`` characters or more that are looked for."""
    m = len(t)
    if m > segment_chars:
        ends = [*range(segment_chars, m, max(1, segment_chars // 2)), m]
        return [("segment", e - segment_chars, e) for e in ends]
    cut = int((1 - core) / 2 * m)
    short = cut < 1 or m - 2 * cut < exact_under
    return [("whole", 0, m)] + ([] if short else [("core", cut, m - cut)])


def by_q(needles, q: int, edit_rate: float) -> list[Block]:
    """The needles by the largest q <= q that leaves them a bound of at least an eighth of their q-grams."""
    groups: dict[int, list] = {}
    for name, t in needles:
        m, k, own = len(t), int(edit_rate * len(t)), min(q, len(t))
        while own > 2 and m - own + 1 - k * own < max(1, (m - own + 1) // 8):
            own -= 1
        groups.setdefault(own, []).append((name, t))
    return [Block(g, own, edit_rate) for own, g in sorted(groups.items())]


class Finder:
    """The items of a block, ready to be looked for."""

    def __init__(self, items, edit_rate: float, q: int, exact_under: int, core: float, segment_chars: int):
        self.items = items
        near, exact = [], []
        for i, (_, t) in enumerate(items):
            if len(t) < exact_under:
                exact.append(((i, "whole"), f" {t} "))
            else:
                near += [((i, part), t[a:b]) for part, a, b in parts(t, exact_under, core, segment_chars)]
        self.near, self.exact = by_q(near, q, edit_rate), by_q(exact, q, 0.0)

    def hits(self, text: str):
        """(item, part, edits, first, end) of every needle in a text; several of one item are possible."""
        t = normal(text)
        if not t:
            return
        padded = codes(f" {t} ")
        for block in self.exact:
            for n, edits, a, b in block.matches(padded):
                yield *block.items[n][0], edits, a, b - 2  # places without the blanks
        c = padded[1:-1]
        for block in self.near:
            for n, edits, a, b in block.matches(c):
                yield *block.items[n][0], edits, a, b

    def rows(self, text: str) -> list[tuple]:
        """(item id, edits, first, end, part) once for each item found."""
        best: dict[int, tuple] = {}
        for i, part, edits, a, b in self.hits(text):
            got = (part != "whole", edits, a, b, part)
            if i not in best or got < best[i]:
                best[i] = got
        return [(self.items[i][0], *got[1:]) for i, got in sorted(best.items())]


def find(docs: DataFrame, benchmark: DataFrame, *, edit_rate: float = 0.1, least_chars: int = 1, q: int = Q,
         exact_under: int = EXACT_UNDER, core: float = CORE, segment_chars: int = SEGMENT_CHARS,
         block_bytes: int = 4 << 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, end, part) of every item found in a document; places in its normal form."""
    spark, out = docs.sparkSession, None
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in MATCHES.split(", ")]
    for items in blocks(benchmark, least_chars, block_bytes, item_key, item_text):
        sent = spark.sparkContext.broadcast(items)  # at most block_bytes of text

        def run(batches, sent=sent):
            finder = Finder(sent.value, edit_rate, q, exact_under, core, segment_chars)
            for batch in batches:
                rows = []
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    rows += [(doc, *hit) for hit in finder.rows(body.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)],
                                                 names=names)

        found = texts(docs, key, text).mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], MATCHES) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, edit_rate: float = 0.1, least_chars: int = 1, q: int = Q,
               exact_under: int = EXACT_UNDER, core: float = CORE, segment_chars: int = SEGMENT_CHARS,
               block_bytes: int = 4 << 20, text: str = "text", item_key: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """The rows in whose text no item is found, all columns kept; one scan for each block of items."""
    for items in blocks(benchmark, least_chars, block_bytes, item_key, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)  # at most block_bytes of text

        def run(batches, sent=sent):
            finder = Finder(sent.value, edit_rate, q, exact_under, core, segment_chars)
            for batch in batches:
                body = batch.column(batch.schema.get_field_index(text))
                clean = [next(finder.hits(b.as_py() or ""), None) is None for b in body]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
