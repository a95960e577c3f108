"""Near-duplicates by DartMinHash over weighted sets of five-word shingles.

A document is the weighted set of its shingles, the weight being how often a shingle occurs; texts of fewer than five
words are one shingle. Each unit of weight of a shingle is a region on which darts fall at hashed times, one after
another at exponential distances, the same in every document. Darts that fall before ``t / weight`` (t = k ln k + 2k of
them on average) are thrown at k coordinates, and each coordinate keeps its earliest dart; two documents keep the same
dart with the probability of their weighted Jaccard similarity. A document with an empty coordinate throws again with t
doubled. The k = bands x rows coordinates are joined by bands.

Documents of equal shingle sets are joined first, by their hash, and one of them goes on. In every band bucket all
documents are held against two of them (the least id, and the least hashed id); such candidates are verified on the
exact weighted sets, and verified links are followed to classes. A bucket that then still holds several classes is
settled exactly: its documents outside its largest class are held, in blocks, against all of its documents, which stream
past; a block reports the links that join classes, at most one for each join. So every pair that shares a bucket ends in
one class if it is similar, and no pair within a class is looked at again. Counts per bucket meet map-side, so a large
group of copies is reduced before it is shuffled.

Chance of a pair of similarity 0.8 to share a bucket: 1 - (1 - 0.8**5)**24 = 0.9999.

Null texts are empty, texts without a word are equal to each other; rows without doc_id have a null class and are never
linked; rows of one id are one document, compared by
one of its texts if they differ; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.graph import components
from opslens.llm.rows import cut, slices, texts
from opslens.llm.wordscan import Powers, Words

WORDS = 5
BANDS, ROWS = 24, 5
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def units(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every unit of weight: a shingle and how often it occurred before."""
    n = w.count
    spread = np.minimum(n, WORDS)
    per = np.where(n > 0, n - spread + 1, 0)
    doc = np.repeat(np.arange(len(n)), per)
    first = np.cumsum(n) - n
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    shingle = np.zeros(len(at), np.uint64)
    for j in range(WORDS):
        more = spread[doc] > j
        h = w.hash[np.minimum(at + j, max(0, len(w.hash) - 1))] if len(w.hash) else shingle
        shingle = shingle * np.uint64(0xD6E8FEB86659FD93) + np.where(more, mix(h + np.uint64(j)), np.uint64(0))
    by = np.argsort(mix(shingle ^ (doc.astype(np.uint64) << np.uint64(32))))
    doc, shingle = doc[by], shingle[by]
    again = np.zeros(len(by), np.int64)
    if len(by):
        same = np.append(False, (shingle[1:] == shingle[:-1]) & (doc[1:] == doc[:-1]))
        order = np.arange(len(by))
        again = order - np.maximum.accumulate(np.where(same, 0, order))
    return doc, mix(shingle + again.astype(np.uint64) * GOLD)


def signatures(doc: np.ndarray, unit: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """k coordinates for each document that has units; 0 elsewhere."""
    weight = np.bincount(doc, minlength=n_docs)
    out = np.zeros((n_docs, k), np.uint64)
    todo, t = np.flatnonzero(weight), k * (np.log(k) + 2)
    while len(todo):
        part = np.full(n_docs, -1)
        part[todo] = np.arange(len(todo))
        on = np.flatnonzero(part[doc] >= 0)
        own, x, limit = part[doc[on]], unit[on], t / weight[doc[on]]
        when, cell, stamp, dart = np.zeros(len(on)), [], [], []
        turn = 0
        while len(x):
            turn += 1
            h = mix(x + np.uint64(turn * int(GOLD) % 2**64))
            when = when - np.log(((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53)
            hit = when < limit
            own, x, limit, when, h = own[hit], x[hit], limit[hit], when[hit], h[hit]
            d = mix(h ^ np.uint64(0xA0761D6478BD642F))
            cell.append(own * k + (d % np.uint64(k)).astype(np.int64))
            stamp.append(when)
            dart.append(d | np.uint64(1))
        cell, stamp, dart = map(np.concatenate, (cell, stamp, dart))
        least = np.full(len(todo) * k, np.inf)
        np.minimum.at(least, cell, stamp)
        won = stamp == least[cell]
        got = np.zeros(len(todo) * k, np.uint64)
        got[cell[won]] = dart[won]
        got = got.reshape(-1, k)
        full = (got != 0).all(1)
        out[todo[full]] = got[full]
        todo, t = todo[~full], 2 * t
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys * GOLD + sig.reshape(len(sig), bands, rows)[:, :, r])
    return mix(keys + np.arange(bands, dtype=np.uint64) * GOLD).view(np.int64)


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, set_hash, band keys) of every document; a text without words has no keys."""
    def run(batches):
        powers = Powers()
        for batch in batches:
            body = batch.column(1).cast(pa.binary())
            for a, b in slices(batch, 1):
                doc, unit = units(Words(body.slice(a, b - a).to_pylist(), powers))
                keys = band_keys(signatures(doc, unit, b - a, bands * rows), bands, rows)
                total = np.zeros((2, b - a), np.uint64)
                np.add.at(total[0], doc, unit)
                np.add.at(total[1], doc, mix(unit ^ GOLD))
                some = np.bincount(doc, minlength=b - a) > 0
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(a, b - a),
                    "set_hash": [f"{x:016x}{y:016x}" for x, y in total.T.tolist()],
                    "keys": pa.array([k if s else [] for k, s in zip(keys, some)], pa.list_(pa.int64()))})

    return texts(docs).mapInArrow(run, "doc_id long, set_hash string, keys array<long>")


def weighted_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, units): the units of each document as 32-bit hashes."""
    def run(batches):
        powers = Powers()
        for batch in batches:
            body = batch.column(1).cast(pa.binary())
            for a, b in slices(batch, 1):
                doc, unit = units(Words(body.slice(a, b - a).to_pylist(), powers))
                by = np.argsort(doc, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))])
                small = (unit[by] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(small))],
                    names=["doc_id", "units"])

    return texts(docs).mapInArrow(run, "doc_id long, units array<int>")


def links(docs: DataFrame, *, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, representatives of equal sets, verified links between representatives)."""
    made = cut(sketches(docs, bands, rows))
    reps = made.where("doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    # rows of equal sets have equal keys: those of the representative stand for all
    own = made.where("doc_id is not null").join(reps.withColumnRenamed("set_hash", "h"), F.col("rep") == F.col("doc_id"))
    keyed = cut(own.where("set_hash = h").select("doc_id", F.explode("keys").alias("key")).distinct())
    hashed = F.xxhash64("doc_id", "key")
    lead = keyed.groupBy("key").agg(F.min("doc_id").alias("one"), F.min(F.struct(hashed.alias("h"), "doc_id")).alias("s"),
                                    F.count("*").alias("n")).where("n > 1").select(
        "key", F.array_distinct(F.array("one", "s.doc_id")).alias("leads"))
    shared_keys = cut(keyed.join(lead, "key"))
    pairs = shared_keys.select("doc_id", F.explode("leads").alias("lead")).where("doc_id <> lead")
    pairs = cut(pairs.select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b")).distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = cut(weighted_sets(docs.join(nodes, "doc_id", "left_semi")).groupBy("doc_id").agg(F.max("units").alias("units")))
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("units").alias("ub")), "b").join(
        sets.select(F.col("doc_id").alias("a"), F.col("units").alias("ua")), "a")
    shared = F.size(F.array_intersect("ua", "ub"))
    alike = shared / (F.size("ua") + F.size("ub") - shared)
    # rows of one id with different texts are one document: their classes are joined
    several = made.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).where("lo <> hi").select("doc_id")
    same_id = made.join(several, "doc_id", "left_semi").join(reps, "set_hash").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = cut(both.where(alike >= threshold).select("a", "b").unionByName(same_id))
    return made, reps, cut(found.unionByName(between_classes(shared_keys, components(found), sets, threshold)))


def between_classes(keyed: DataFrame, label: DataFrame, sets: DataFrame, threshold: float,
                    block: int = 256, stream: int = 1024) -> DataFrame:
    """(a, b): verified links that join classes within buckets which hold several of them.

    ``keyed`` has (key, doc_id), ``label`` the classes so far (node, component), ``sets`` the weighted sets. A task
    holds about ``block`` documents and about ``stream`` pass it, however large the bucket is.
    """
    rows = cut(keyed.select("key", "doc_id").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("class")))
    mixed = rows.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("classes")).where(
        "classes > 1 and all > 2").select("key", F.col("top.class").alias("largest"),
                                          F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("tiles"),
                                          F.ceil(F.col("all") / stream).cast("int").alias("parts"))
    own = rows.join(mixed, "key")
    each = {k: F.explode(F.sequence(F.lit(0), F.col(f"{k}s") - 1)).alias(k) for k in ("tile", "part")}
    mine = {k: F.pmod(F.xxhash64("doc_id", F.lit(k)), f"{k}s").cast("int").alias(k) for k in ("tile", "part")}
    home = own.where("class <> largest").select("key", mine["tile"], each["part"], F.lit(0).alias("role"), "doc_id", "class")
    seen = own.select("key", each["tile"], mine["part"], F.lit(1).alias("role"), "doc_id", "class")
    sent = home.unionByName(seen).join(sets, "doc_id").select("key", "tile", "part", "role", "doc_id", "class", "units")

    def run(batches):
        at, homes, index, found = None, [], None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for k, (key, tile, part, role, doc, cls) in enumerate(zip(*cols)):
                if (key, tile, part) != at:
                    at, homes, index = (key, tile, part), [], None
                units_ = batch.column(6)[k].values.to_numpy()
                if role == 0:
                    homes.append((doc, cls, units_))
                elif homes:
                    index = index or Tile(homes)
                    found += index.visit(doc, cls, units_, threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
                found = []

    dealt = sent.repartition("key", "tile", "part").sortWithinPartitions("key", "tile", "part", "role", "doc_id")
    return dealt.mapInArrow(run, "a long, b long")


class Tile:
    """Documents of one block with an index of their units, and which classes have been joined here."""

    def __init__(self, homes):
        self.doc, self.cls = [h[0] for h in homes], np.array([h[1] for h in homes])
        self.size = np.array([len(h[2]) for h in homes])
        unit, home = np.concatenate([h[2] for h in homes]), np.repeat(np.arange(len(homes)), self.size)
        by = np.argsort(unit, kind="stable")
        self.unit, self.home, self.up = unit[by], home[by], {}

    def root(self, c):
        while c in self.up:
            c = self.up[c]
        return c

    def visit(self, doc, cls, units_, threshold: float):
        lo, hi = np.searchsorted(self.unit, units_, "left"), np.searchsorted(self.unit, units_, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.home[at], minlength=len(self.doc))
        alike = shared / (self.size + len(units_) - shared)
        for h in np.flatnonzero((alike >= threshold) & (self.cls != cls)):
            a, b = self.root(int(self.cls[h])), self.root(cls)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                yield self.doc[h], doc


def _named(docs: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """(doc_id, set_hash, class_id, kept) of every row."""
    made, reps, edges = links(docs, threshold=threshold, bands=bands, rows=rows)
    joined = reps.join(components(edges).withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_hash", F.coalesce("component", "rep").alias("class_id"))
    named = made.select("doc_id", "set_hash").join(joined, "set_hash", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.col("class_id"))
    return named.select("doc_id", "set_hash", class_id.alias("class_id"), F.coalesce(
        F.col("doc_id") == class_id, F.lit(False)).alias("kept"))


def classes(docs: DataFrame, *, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, kept) of every row: class_id is the least doc_id of its class, kept marks that document."""
    return _named(docs, threshold, bands, rows).drop("set_hash")


def keep_one(docs: DataFrame, *, text: str = "text", threshold: float = 0.8, bands: int = BANDS,
             rows: int = ROWS) -> DataFrame:
    """One document of each class, all columns kept; rows without doc_id stay.

    Repeated rows of an id become one. An id that stands for different sets of shingles names no single document: each
    of its different texts stays once, so that none is lost to a class that another text of the id is in.
    """
    each = cut(_named(docs, threshold, bands, rows).where("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("set_hash").alias("least"), F.max("set_hash").alias("most"),
        F.max("kept").alias("kept")).where("n > 1 or not kept"))
    drop = each.where("least = most and not kept").select("doc_id")
    left = docs.join(drop, "doc_id", "left_anti").select(docs.columns)
    again = each.where("n > 1 and (kept or least <> most)")
    if again.isEmpty():
        return left
    out = left.join(again, "doc_id", "left_anti").select(docs.columns)
    for which, key in (("least = most", ["doc_id"]), ("least <> most", ["doc_id", text])):
        rows_ = left.join(again.where(which), "doc_id", "left_semi").select(docs.columns)
        out = out.unionByName(rows_.dropDuplicates(key))
    return out
