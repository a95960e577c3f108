"""Phrase collocations counted in tiles of frequency-ranked ids.

Words with ``least`` occurrences in their language get ids by falling frequency. A pair of ids is a cell of a square cut
into tiles; a task counts the crowded tiles by direct address (dense ``bincount``) and the rest as sorted coordinates
with run lengths, and Spark adds the tasks' cells up. Frequent pairs are ranked anew by their frequency, so a phrase of
three words is again a pair: (pair id, word id), counted in the same way, where both of its pairs are frequent.

At most ``RANKED`` words or pairs carry ids, which bounds what tasks are sent. Beyond these, words and pairs go by a
62-bit hash of theirs in the same tables, as sorted coordinates; a bit table of fixed size leaves out most that cannot be
frequent. So the result is the same whatever the number of words. Texts are read three times, in blocks of 1 MB; a
block of a longer text ends where a piece ends, or else goes on with the last two words.

A null text is empty, a null lang is ``und``; repeated rows count each time; an empty table gives an empty result; texts
without words only have no say; ids and other columns, whatever their names, are not read. Ties of score and count go by
the phrase's UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.llm.rows import SLICE_BYTES, cut, slices
from opslens.llm.wordscan import LOWER, Powers, word_hash

# Bytes that end a piece, blanks between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
IS_END = np.zeros(256, bool)
IS_END[list(ENDS)] = True
IN_WORD = ~IS_END
IN_WORD[list(BLANKS)] = False

RANKED_BITS = 18
RANKED = 1 << RANKED_BITS
SIDE_BITS = 10  # a tile has 1024 x 1024 cells
TILES_BITS = RANKED_BITS - SIDE_BITS
DENSE_PAIRS, DENSE_TILES = 1 << 16, 16
FLUSH_PAIRS = 1 << 21
FLUSH_WORDS = 400_000
HASHED = np.int64(1 << 62)
TABLE_BITS = 23
CELLS = "p long, w long, n long"
_CELLS = pa.schema([("p", pa.int64()), ("w", pa.int64()), ("n", pa.int64())])


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key of 62 bits for two numbers; keys are told from ids by bit 62."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(2)).astype(np.int64) | HASHED


class Runs:
    """The words of texts in order: start, end, piece (no piece spans two texts), doc, key (of word and language)."""

    def __init__(self, bodies: list[bytes], langs: np.ndarray, powers: Powers):
        raw = np.frombuffer(b"\n".join(bodies), np.uint8)
        self.buf = LOWER[raw]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = IN_WORD[self.buf]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(IS_END[self.buf], dtype=np.int32)[self.start]
        at = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bodies])[:-1]])
        self.doc = np.searchsorted(at, self.start, side="right") - 1
        power, inverse = powers.upto(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=total[1:])
        h = (total[self.end] - total[self.start]) * inverse[self.start]
        self.key = mixed(h ^ (h >> np.uint64(29)), langs[self.doc])


def parts(body: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """(block, words at its start that the block before had as well) of a text longer than ``most`` bytes."""
    at, again, size = 0, 0, most
    while len(body) - at > size:
        window = body[at:at + size]
        end = max(window.rfind(e) for e in (bytes([e]) for e in ENDS))
        if end > 0:
            yield window[:end + 1], again
            at, again, size = at + end + 1, 0, most
            continue
        flags = np.zeros(len(window) + 1, np.int8)
        flags[1:] = IN_WORD[np.frombuffer(window, np.uint8)]
        starts = np.flatnonzero(np.diff(flags) == 1)
        stop = max(window.rfind(b) for b in (b" ", b"\t"))
        starts = starts[starts < stop]
        if len(starts) < 3 or starts[-2] == 0:
            size *= 2  # so few words that nothing would be won
            continue
        yield window[:stop], again
        at, again, size = at + int(starts[-2]), 2, most
    yield body[at:], again


def blocks(batches, powers: Powers) -> Iterator[tuple[Runs, np.ndarray, int]]:
    """(words, language of each text, words to skip) for batches of (lang, text)."""
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        body = batch.column(1).cast(pa.binary())
        for a, b in slices(batch, 1):
            own = names[a:b]
            made = {x: word_hash(x) for x in set(own)}
            langs = np.array([made[x] for x in own], np.uint64)
            held = body.slice(a, b - a).to_pylist()
            if b - a == 1 and len(held[0]) > SLICE_BYTES:
                for part, again in parts(held[0], SLICE_BYTES):
                    yield Runs([part], langs, powers), own, again
            else:
                yield Runs(held, langs, powers), own, 0


def word_counts(rows: DataFrame) -> DataFrame:
    """(key, lang, word, n) of every word; rows with a null key have each language's total."""
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def flush(seen, n):
        keys = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([seen[k][0] for k in keys], pa.string()),
             pa.array([seen[k][1].decode() for k in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64())],
            schema=schema)

    def run(batches):
        seen, n, totals = {}, {}, {}
        for w, langs, again in blocks(batches, Powers()):
            keys, first, count = np.unique(w.key[again:], return_index=True, return_counts=True)
            per = np.bincount(w.doc[again:], minlength=len(langs))
            for lang, c in zip(langs, per.tolist()):
                totals[lang] = totals.get(lang, 0) + c
            for k, i, c in zip(keys.tolist(), (first + again).tolist(), count.tolist()):
                if k in seen:
                    n[k] += c
                else:
                    seen[k] = langs[w.doc[i]], w.buf[w.start[i]:w.end[i]].tobytes()
                    n[k] = c
            if len(seen) >= FLUSH_WORDS:
                yield flush(seen, n)
                seen, n = {}, {}
        yield flush(seen, n)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(totals), pa.int64()), pa.array(list(totals), pa.string()),
                                          pa.array([None] * len(totals), pa.string()),
                                          pa.array(list(totals.values()), pa.int64())], schema=schema)

    got = rows.mapInArrow(run, "key long, lang string, word string, n long")
    return got.groupBy("key", "lang").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


class Level:
    """Ids of the most frequent keys of a table (key, n), and how to treat the others."""

    def __init__(self, rows: DataFrame, ranked: int = RANKED):
        step = F.floor(F.log2("n") * 8)
        shape = sorted(((r[0], r[1]) for r in rows.groupBy(step).count().collect()), reverse=True)  # at most 512 rows
        held, floor = 0, None
        for s, c in shape:
            if held + c > ranked:
                break
            held, floor = held + c, s
        self.complete = held == sum(c for _, c in shape)
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if held:
            top = rows.where(step >= floor).select("key", "n").toArrow()  # at most ``ranked`` pairs of numbers
            keys, n = top.column(0).to_numpy(), top.column(1).to_numpy()
        by_rank = np.lexsort((keys, -n))
        self.keys = keys[by_rank]  # id -> key
        self.ids = np.argsort(self.keys).astype(np.int32)
        self.sorted = self.keys[self.ids]
        self.bits = None if self.complete else _bit_table(rows)

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """A key's id; beyond the ids the key itself, if it may be frequent; else -1."""
        out = np.full(len(keys), -1, np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
            same = self.sorted[at] == keys
            out[same] = self.ids[at[same]]
        if not self.complete:
            low = (keys & ((1 << TABLE_BITS) - 1)).astype(np.uint64)
            may = (self.bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)
            more = (out < 0) & (may > 0) & (keys >= HASHED)
            out[more] = keys[more]
        return out


def _bit_table(rows: DataFrame) -> np.ndarray:
    """2^23 bits, one set for each key of the table."""
    word = F.shiftright(F.col("key").bitwiseAND((1 << TABLE_BITS) - 1), 6).cast("int")
    got = rows.groupBy(word.alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(key & 63 AS INT)))").alias("bits")).toArrow()  # at most 2^17 rows
    out = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def run_lengths(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and how often each occurs, by one sort."""
    at = np.lexsort(columns[::-1])
    sorted_ = [c[at] for c in columns]
    edge = np.ones(len(at), bool)
    edge[1:] = np.any([c[1:] != c[:-1] for c in sorted_], axis=0)
    first = np.flatnonzero(edge)
    return [c[first] for c in sorted_], np.diff(np.append(first, len(at)))


class TileCounter:
    """Counts pairs of ids: crowded tiles dense, at most ``DENSE_TILES`` of them held; the rest as sorted coordinates."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.waiting, self.size = [], 0

    def add(self, p: np.ndarray, w: np.ndarray):
        self.waiting.append((p, w))
        self.size += len(p)
        return self.flush() if self.size >= FLUSH_PAIRS else iter(())

    def flush(self):
        if not self.size:
            return
        p, w = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.size = [], 0
        ranked = (p < RANKED) & (w < RANKED)
        if not ranked.all():
            (a, b), n = run_lengths([p[~ranked], w[~ranked]])
            yield a, b, n
            p, w = p[ranked], w[ranked]
        tile = ((p >> SIDE_BITS) << TILES_BITS | (w >> SIDE_BITS)).astype(np.uint16)
        load = np.bincount(tile, minlength=1 << 2 * TILES_BITS)
        for t in np.argsort(-load, kind="stable")[:DENSE_TILES]:
            if load[t] >= DENSE_PAIRS and len(self.dense) < DENSE_TILES:
                self.dense.setdefault(int(t), np.zeros(1 << 2 * SIDE_BITS, np.int32))
        is_dense = np.zeros(1 << 2 * TILES_BITS, bool)
        is_dense[list(self.dense)] = True
        mine = is_dense[tile]
        for t in self.dense:
            if load[t]:
                at = np.flatnonzero(tile == t)
                low = (1 << SIDE_BITS) - 1
                self.dense[t] += np.bincount((p[at] & low) << SIDE_BITS | (w[at] & low), minlength=1 << 2 * SIDE_BITS).astype(np.int32)
        cell = np.sort((p[~mine] << RANKED_BITS) | w[~mine])
        if len(cell):
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            cell, n = cell[first], np.diff(np.append(first, len(cell)))
            yield cell >> RANKED_BITS, cell & (RANKED - 1), n

    def end(self):
        yield from self.flush()
        for t, cells in self.dense.items():
            at = np.flatnonzero(cells)
            yield ((t >> TILES_BITS) << SIDE_BITS) + (at >> SIDE_BITS), (
                (t & ((1 << TILES_BITS) - 1)) << SIDE_BITS) + (at & ((1 << SIDE_BITS) - 1)), cells[at]
        self.dense = {}


def phrase_counts(rows: DataFrame, levels: list[Level], least: int) -> DataFrame:
    """(p, w, n, key) of the phrases one word longer than the last of ``levels``: code of all but the last word, and of
    that. Only phrases whose first and last parts are frequent are counted."""
    sent = rows.sparkSession.sparkContext.broadcast(levels)  # tables of fixed size
    size = len(levels)

    def run(batches):
        levels, counter = sent.value, TileCounter()

        def out(found):
            for p, w, n in found:
                for a in range(0, len(p), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a:a + (1 << 16)].astype(np.int64)) for x in (p, w, n)],
                                                     schema=_CELLS)

        for words, _, again in blocks(batches, Powers()):
            word = levels[0].codes(words.key)
            code = word  # of the phrase that starts at each word
            for step, level in enumerate(levels[1:], 1):
                code = extend(level, code, word, words.piece, step)
            n = len(word) - size
            if n <= 0:
                continue
            ok = (code[:n] >= 0) & (code[1:n + 1] >= 0) & (word[size:] >= 0) & (words.piece[:n] == words.piece[size:])
            ok[:max(0, again - size)] = False
            yield from out(counter.add(code[:n][ok], word[size:][ok]))
        yield from out(counter.end())

    cells = rows.mapInArrow(run, CELLS).repartition("p", "w").groupBy("p", "w").agg(F.sum("n").alias("n"))
    schema = pa.schema([*_CELLS, ("key", pa.int64())])

    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mixed(b.column(0).to_numpy(), b.column(1).to_numpy()))],
                                             schema=schema)

    return cells.where(F.col("n") >= least).mapInArrow(keyed, f"{CELLS}, key long")


def extend(level: Level, code: np.ndarray, word: np.ndarray, piece: np.ndarray, size: int) -> np.ndarray:
    """Codes of the phrases one word longer than those of ``code`` (``size`` words), -1 where there is none or it is rare."""
    out = np.full(len(word), -1, np.int64)
    n = len(word) - size
    if n > 0:
        at = np.flatnonzero((code[:n] >= 0) & (word[size:] >= 0) & (piece[:n] == piece[size:]))
        out[at] = level.codes(mixed(code[at], word[at + size]))
    return out


def coded(rows: DataFrame, level: Level) -> DataFrame:
    """``rows`` with ``code``: what stands for the row's key in longer phrases."""
    sent = rows.sparkSession.sparkContext.broadcast(level)
    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.LongType())])

    def run(batches):
        for b in batches:
            code = sent.value.codes(b.column(b.schema.get_field_index("key")).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], names=[*b.schema.names, "code"])

    return rows.mapInArrow(run, schema)


def _score(a: str, left: str, right: str):
    big = "CAST({} AS DECIMAL(19,0))".format
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({big(a)} * {big(a)})) div ({big(left)} * {big(right)})")


def mine(docs: DataFrame, *, least: int = 10, top: int = 2000, cover: int = 50, lang: str = "lang", text: str = "text",
         ranked: int = RANKED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two and three words.

    A phrase within a longer one that has ``cover`` hundredths of its occurrences or more is left out.
    """
    if ranked > RANKED:
        raise ValueError(f"at most {RANKED} ids")
    c = F.col
    rows = docs.select(F.coalesce(c(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(c(f"`{text}`"), F.lit("")).alias("text"))
    found = cut(word_counts(rows).where((c("n") >= least) | c("key").isNull()))
    totals = found.where("key is null").select("lang", c("n").alias("total"))
    words = found.where("key is not null")
    levels = [Level(words, ranked)]
    words = coded(words, levels[0])
    pairs = cut(phrase_counts(rows, levels, least))
    levels.append(Level(pairs, ranked))
    triples = cut(phrase_counts(rows, levels, least))

    def word(i):
        return words.select(c("code").alias(f"w{i}"), c("word").alias(f"t{i}"), c("n").alias(f"n{i}"), *([c("lang")] if i == 1 else []))

    two = coded(pairs, levels[1]).select(c("p").alias("w1"), c("w").alias("w2"), c("n").alias("n12"), c("code").alias("w12"))
    two = cut(two.join(word(1), "w1").join(word(2), "w2"))
    rest = two.select(c("w1").alias("w2"), c("w2").alias("w3"), c("n12").alias("n23"), c("w12").alias("w23"))
    three = triples.select(c("p").alias("w12"), c("w").alias("w3"), c("n").alias("n123")).join(two, "w12").join(
        rest, ["w2", "w3"]).join(word(3), "w3")
    three = cut(three.withColumn("s1", _score("n123", "n1", "n23")).withColumn("s2", _score("n123", "n12", "n3")))
    longer = three.select(c("w12"), "n123").unionByName(three.select(c("w23").alias("w12"), "n123")).groupBy("w12").agg(
        F.max("n123").alias("most"))
    two = two.join(longer, "w12", "left").where(F.coalesce(100 * c("most") < cover * c("n12"), F.lit(True)))
    first = c("s1") <= c("s2")
    both = two.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), c("n12").alias("a"), c("n1").alias("l"),
                      c("n2").alias("r"), _score("n12", "n1", "n2").alias("score")).unionByName(
        three.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), c("n123").alias("a"),
                     F.when(first, c("n1")).otherwise(c("n12")).alias("l"), F.when(first, c("n23")).otherwise(c("n3")).alias("r"),
                     F.least("s1", "s2").alias("score")))
    by = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = both.withColumn("rank", F.row_number().over(by)).where(c("rank") <= top)
    return best.join(totals, "lang").select("lang", c("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                            c("total").alias("n"), "score")
