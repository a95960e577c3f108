"""Trigram search over a stored table of postings: work follows the rows that share rare trigrams with a query.

Two trigram sets with a similarity above t share more than t times the size of either one. So a row that similar to a
query holds one at least of the query's first ``size - floor(t * size)`` trigrams, commonest last, and their sizes lie
within a factor of t. A query asks the lists of these first trigrams; the rows they name often enough to reach the
similarity with the query's other trigrams are settled by the lists of those. The result is exact, as ``lexical_topk`` has
it, whatever the order is.

A trigram is a number, 21 bits a character. Postings lie in blocks: up to ``heavy`` rows of one class of sizes, with the
lists of their trigrams, made and read by one task each. A trigram of every row is so spread over all blocks, no posting
crosses the network, and a question skips the blocks of other sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions import text
from opslens.operators.retrieve import TOP_K, TRIGRAM_THRESHOLD, WAVE_BYTES, WAVE_ROWS, _Keeper, _objects, _plain, _ranked, _waves
from opslens.session import cut_lineage, spread

HEAVY = 100_000
BUCKETS = 64
NUMBER_ROWS = 1_000
COMMON = 65_536  # trigrams that are put in order of their frequency; rarer ones come before them, by their number


@dataclass
class Postings:
    """``grams``: (gram, df, parts), parts being the fewest lists that hold a trigram's rows; ``blocks``: a row is a block
    of rows in order of size (id, size and by are of one length) and trigrams, of which the i-th stands in the rows
    ``at[start[i]:start[i + 1]]``."""

    grams: DataFrame
    blocks: DataFrame
    threshold: float


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _as_lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)


def _trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number, size) of the distinct trigrams of rows of words, each word with two blanks before and one after it."""
    sizes, flat = _sizes(words), words.flatten().dictionary_encode()
    known = flat.dictionary.to_pylist()
    length = np.array([len(w) for w in known], dtype=np.int64) + 1  # trigrams of each known word
    units = np.array([ord(x) for w in known for x in f"  {w} "], dtype=np.int64)
    code = units[:-2] << 42 | units[1:-1] << 21 | units[2:] if len(known) else units
    inside = np.ones(len(code), bool)
    inside[np.cumsum(length + 2)[:-1] - 1] = inside[np.cumsum(length + 2)[:-1] - 2] = False  # these run into the next word
    grams, at = np.unique(code[inside], return_inverse=True)
    start = np.cumsum(length) - length
    word = flat.indices.to_numpy(zero_copy_only=False)
    each = length[word]
    place = np.repeat(start[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    owner = np.repeat(np.repeat(np.arange(len(sizes)), sizes), each)
    key = np.unique(owner * len(grams) + at[place])
    return grams[key % max(len(grams), 1)], np.bincount(key // max(len(grams), 1), minlength=len(sizes))


def _numbered(rows: DataFrame, content: str) -> DataFrame:
    """``rows`` with the distinct trigrams of ``content`` as ``members`` and their ``size``; rows without any are left out."""
    rest = [c for c in rows.columns if c != content]
    rows = rows.select(*rest, text.distinct_words(F.col(content)).alias("words")).filter(F.size("words") > 0)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, NUMBER_ROWS):
                b = whole.slice(low, NUMBER_ROWS)
                grams, sizes = _trigrams(b["words"])
                yield pa.record_batch([*b.columns[:-1], _as_lists(pa.array(grams), sizes), pa.array(sizes, pa.int32())],
                                      names=[*rest, "members", "size"])

    return rows.mapInArrow(number, f"{kinds}, members array<bigint>, size int")


def _common(grams: DataFrame) -> np.ndarray:
    """The most frequent trigrams, rarest of them first."""
    most = grams.orderBy(F.desc("df"), "gram").limit(COMMON).select("gram").toArrow()["gram"]
    return most.to_numpy()[::-1].astype(np.int64)


def _in_order(flat: np.ndarray, owner: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The members of each owner in the order of the index."""
    known, at = np.unique(flat, return_inverse=True)
    by_number = np.argsort(common)
    place = np.searchsorted(common, known, sorter=by_number).clip(max=max(len(common) - 1, 0))
    rank = np.full(len(known), -1)
    if len(common):
        hit = common[by_number[place]] == known
        rank[hit] = by_number[place[hit]]
    order = np.lexsort((known, rank))
    turn = np.empty(len(known), np.int64)
    turn[order] = np.arange(len(known))
    key = owner * len(known) + turn[at]
    key.sort()
    return known[order][key % max(len(known), 1)]


def build(corpus: DataFrame, threshold: float = TRIGRAM_THRESHOLD, by: str | None = None, heavy: int = HEAVY) -> Postings:
    """The postings of (id, content) rows of distinct ids; rows of equal ``by`` are found by their own questions only."""
    own = F.col(by).cast("string") if by else F.lit(None).cast("string")
    rows = spread(corpus.filter("id IS NOT NULL").select("id", own.alias("by"), "content"))
    sets = cut_lineage(_numbered(rows, "content"))
    # rows meet map-side; a row counts once per trigram as its members are distinct
    grams = sets.select(F.explode("members").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = whole["size"].to_numpy()
            order = np.argsort(size, kind="stable")
            for cut in np.split(order, np.flatnonzero(np.diff(_level(size[order]))) + 1) if len(order) else []:
                for low in range(0, len(cut), heavy):
                    b = whole.take(pa.array(cut[low:low + heavy]))
                    flat = b["members"].flatten().to_numpy(zero_copy_only=False)
                    owner = np.repeat(np.arange(b.num_rows), _sizes(b["members"]))
                    by_gram = np.lexsort((owner, flat))
                    known, start = np.unique(flat[by_gram], return_index=True)
                    columns = [b["id"], b["size"], b["by"], pa.array(known), pa.array(np.r_[start, len(flat)], pa.int32()), pa.array(owner[by_gram], pa.int32())]
                    yield pa.record_batch([pa.array(_level(b["size"].to_numpy()[:1]), pa.int32()), *[_as_lists(x, np.array([len(x)])) for x in columns]],
                                          names=["level", "id", "size", "by", "gram", "start", "at"])

    kind = corpus.schema["id"].dataType.simpleString()
    made = sets.mapInArrow(blocks, f"level int, id array<{kind}>, size array<int>, by array<string>, gram array<bigint>, start array<int>, at array<int>")
    return Postings(grams.withColumn("parts", F.ceil(F.col("df") / heavy)), made, threshold)


def _level(size: np.ndarray) -> np.ndarray:
    """The class of a size: sizes from a power of two up to the next."""
    return np.frexp(size)[1] - 1


def store(index: Postings, path: str, buckets: int = BUCKETS) -> None:
    """Write both tables; blocks lie by their class of sizes, in ``buckets`` folders at most."""
    index.grams.write.mode("overwrite").parquet(f"{path}/grams")
    at = F.least("level", F.lit(buckets - 1))
    index.blocks.withColumn("bucket", at).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")


def load(spark: SparkSession, path: str, threshold: float = TRIGRAM_THRESHOLD) -> Postings:
    """The stored tables, searched at ``threshold``."""
    return Postings(spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/blocks"), threshold)


def _asked(queries: DataFrame, by: str | None) -> DataFrame:
    own = F.col(by).cast("string") if by else F.lit(None).cast("string")
    return _numbered(queries.filter("query_id IS NOT NULL").select("query_id", own.alias("by"), "text"), "text")


def candidates(index: Postings, queries: DataFrame, by: str | None = None) -> DataFrame:
    """(query_id, id) pairs whose sizes and common first trigrams allow the similarity, each once."""
    return _met(index, _asked(queries, by), None).select("query_id", "id").distinct()


def _met(index: Postings, asked: DataFrame, k: int | None) -> DataFrame:
    """(query_id, id, score) of the candidates of numbered queries, score being the negated similarity; with ``k`` each
    task's ``k`` best above the threshold. Queries go out in waves, as those of a scan do."""
    spark, t = asked.sparkSession, index.threshold
    qtype, ctype = asked.schema["query_id"].dataType.simpleString(), index.blocks.schema["id"].dataType.elementType.simpleString()
    common = spark.sparkContext.broadcast(_common(index.grams))  # at most COMMON numbers
    out_schema = f"query_id {qtype}, id {ctype}, score double"

    def one(wave: pa.Table) -> DataFrame:
        block = spark.sparkContext.broadcast(wave)  # held to the wave's rows and bytes
        sizes = [len(x) for x in wave["feature"].to_pylist()]
        least, most = _level(np.array([max(min(sizes) * t - 1, 1), max(sizes) / t + 1 if t > 0 else 2.0**40]))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, qby, qids = _plain(block.value["feature"]), _objects(block.value["by"]), _plain(block.value["query_id"])
            qsize, numbers = _sizes(held), _objects(qids)
            owner = np.repeat(np.arange(len(qsize)), qsize)
            turns = np.split(_in_order(held.flatten().to_numpy(zero_copy_only=False), owner, common.value), np.cumsum(qsize)[:-1])
            keeper, ct = _Keeper(k) if k else None, None
            for b in batches:
                ct = b.schema.field("id").type.value_type
                for i in range(b.num_rows):
                    ids, size, own, gram, start, at = (b[x][i].values for x in ("id", "size", "by", "gram", "start", "at"))
                    size, gram, start, at = (x.to_numpy() for x in (size, gram, start, at))
                    ids, own, pairs = _objects(ids), _objects(own), [[], [], []]

                    def shared(asks: np.ndarray) -> np.ndarray:
                        place = np.searchsorted(gram, asks).clip(max=len(gram) - 1)
                        lists = [at[start[p]:start[p + 1]] for p in place[gram[place] == asks]]
                        return np.bincount(np.concatenate([at[:0], *lists]), minlength=len(size))

                    for q, n in enumerate(qsize):
                        low, high = np.searchsorted(size, n * t - 1e-9, "right"), np.searchsorted(size * t, n + 1e-9, "left")
                        if low >= high:
                            continue
                        behind = int(np.floor(n * t + 1e-9))  # the floor allows for the rounding of products
                        first = shared(turns[q][:n - behind])
                        # shared / (size + n - shared) > t, with the most that can be shared
                        met = (first > 0) & ((first + behind) * (1 + t) > t * (size + n) - 1e-6) & (own == qby[q])
                        met = np.flatnonzero(met[low:high]) + low
                        if len(met):
                            both = first[met] + shared(turns[q][n - behind:])[met]
                            score = -(both / (size[met] + n - both))
                            some = -score > t if k else slice(None)
                            for x, y in zip(pairs, (np.full(len(met), q), met, score), strict=True):
                                x.append(y[some])
                    q, met, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in pairs)
                    if keeper:
                        keeper.add(numbers[q], ids[met], score)
                    else:
                        yield pa.record_batch([qids.take(pa.array(q)), pa.array(ids[met], ct), pa.array(score, pa.float64())], names=["query_id", "id", "score"])
            best = keeper.result() if keeper else None
            if best is not None:
                yield pa.record_batch([pa.array(best[0], qids.type), pa.array(best[1], ct), pa.array(best[2], pa.float64())], names=["query_id", "id", "score"])

        fits = F.col("level").between(int(least), int(most))
        if "bucket" in index.blocks.columns:  # a folder holds the level of its name, the last one larger ones as well
            fits = fits & (F.col("bucket") <= int(most))
        return index.blocks.filter(fits).select("id", "size", "by", "gram", "start", "at").mapInArrow(meet, out_schema)

    done = [one(wave) for wave in _waves(asked.select("query_id", "by", F.col("members").alias("feature")), WAVE_ROWS, WAVE_BYTES)]
    if len(done) > 1:
        done = [cut_lineage(x) for x in done]  # each wave's rows are written once
    met = spark.createDataFrame([], out_schema) if not done else done[0]
    for rows in done[1:]:
        met = met.unionByName(rows)
    return met


def search(index: Postings, queries: DataFrame, k: int = TOP_K, by: str | None = None) -> DataFrame:
    """(query_id, id, similarity, rnk) of the ``k`` most similar rows above the threshold, ties broken by id.

    ``queries``: query_id (distinct), text.
    """
    out = _ranked(_met(index, _asked(queries, by), k), k)
    return out.select("query_id", "id", (-F.col("score")).alias("similarity"), "rnk")
