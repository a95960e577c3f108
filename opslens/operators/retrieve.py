"""Hybrid retrieval: exact vector top-k, trigram top-k, reciprocal rank fusion.

Queries go out in waves, blocks of checked size; the corpus is scanned where it lies, once for each wave
(trigram search spreads one of fewer splits than cores first). Each task keeps the best ``k`` per query over all its batches, so what leaves a task is
``k`` rows per query, never a pair per corpus row. Vector queries of more than one wave are dealt with the corpus over a
grid of blocks instead, one task a block, so that their number costs no further jobs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from opslens.functions import text
from opslens.functions.kernels import CosineScorer, TrigramScorer, list_matrix, nearest_rows, unit_rows
from opslens.session import cut_lineage, spread

RRF_K = 60
OVERFETCH = 5
TOP_K = 10
TRIGRAM_THRESHOLD = 0.3
WAVE_ROWS = 4_096
WAVE_BYTES = 64 << 20
SCORE_BLOCK = 512
MAX_WINNERS = 200_000
GRID_ROWS = 32_768  # of a side of a block
GRID_BYTES = 64 << 20

# Corpus names, their tables, content rules and the filters each one allows.
CORPORA: dict[str, tuple[str, Callable[[], Column], tuple[str, ...]]] = {
    "LOGS": ("log_embeddings", lambda: F.col("content"), ("fingerprint",)),
    "CODE": (
        "code_embeddings",
        lambda: F.coalesce(F.col("content"), F.concat(F.col("file_path"), F.lit(" "), F.col("fqn"))),
        ("repo", "git_sha", "file_path", "fqn"),
    ),
    "INCIDENTS": ("incident_embeddings", lambda: F.col("content"), ("incident_id",)),
}


def corpus_view(corpus: str) -> tuple[str, Callable[[], Column], tuple[str, ...]]:
    try:
        return CORPORA[corpus.upper()]
    except KeyError:
        raise ValueError(f"unknown corpus {corpus!r}; known: {', '.join(CORPORA)}") from None


def equality_filter(df: DataFrame, allowed: tuple[str, ...], filters: Mapping[str, object] | None) -> DataFrame:
    """Allow-listed equality filters, compared as text; unknown keys and null values are ignored."""
    for name, value in (filters or {}).items():
        if name in allowed and value is not None:
            df = df.filter(F.col(name).cast("string") == str(value))
    return df


def corpus_filter(df: DataFrame, corpus: str, filters: Mapping[str, object] | None) -> DataFrame:
    """The filtered rows of a corpus with the corpus' content rule applied."""
    _, content, allowed = corpus_view(corpus)
    return equality_filter(df, allowed, filters).withColumn("content", content())


def _best(qid: np.ndarray, cid: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best (score, id) per query; NaN scores come last."""
    order = np.lexsort((cid, score, qid))
    q = qid[order]
    start = np.r_[True, q[1:] != q[:-1]]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return order[rank < k]


class _Keeper:
    """Best rows per query over the batches of one task; holds at most a few times k rows per query."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [], 0

    def add(self, qid: np.ndarray, cid: np.ndarray, score: np.ndarray) -> None:
        if len(qid):
            best = _best(qid, cid, score, self.k)
            self.parts.append((qid[best], cid[best], score[best]))
            self.held += len(best)
            if self.held > 400_000:
                self.parts = [self._merged()]
                self.held = len(self.parts[0][0])

    def _merged(self):
        qid, cid, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        best = _best(qid, cid, score, self.k)
        return qid[best], cid[best], score[best]

    def result(self):
        return self._merged() if self.parts else None


def _score_batch(keeper: _Keeper, scorer, qids: np.ndarray, qby: np.ndarray | None, ids: np.ndarray,
                 feature: pa.Array, by: np.ndarray | None) -> None:
    groups = [(np.arange(len(ids)), np.arange(len(qids)))]
    if by is not None:
        groups = [(np.flatnonzero(by == v), np.flatnonzero(qby == v)) for v in set(by) & set(qby)]
    for rows, all_queries in groups:
        for at in range(0, len(all_queries) if len(rows) else 0, SCORE_BLOCK):
            queries = all_queries[at:at + SCORE_BLOCK]
            s = scorer.scores(feature, rows, queries)
            keep = scorer.keep(s)
            if len(rows) > keeper.k:
                # only rows at or under a query's k-th score in this batch can matter; ties stay in
                ranked = np.where(keep & ~np.isnan(s), s, np.inf)
                keep &= ranked <= np.partition(ranked, keeper.k - 1, axis=0)[keeper.k - 1]
            r, q = np.nonzero(keep)
            keeper.add(qids[queries[q]], ids[rows[r]], s[r, q])


def _objects(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.to_numpy(zero_copy_only=False)


def _plain(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _waves(queries: DataFrame, wave_rows: int, wave_bytes: int) -> Iterator[pa.Table]:
    """The queries as Arrow tables of at most ``wave_rows`` rows and about ``wave_bytes`` bytes, one at a time."""
    schema = to_arrow_schema(queries.schema)
    held, size = [], 0
    for row in queries.toLocalIterator():
        held.append(row.asDict())
        size += 64 + 24 * len(row["feature"] or ())
        if len(held) >= wave_rows or size >= wave_bytes:
            yield pa.Table.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.Table.from_pylist(held, schema)


def _topk(queries: DataFrame, corpus: DataFrame, make_scorer, k: int, by: str | None,
          narrow: Callable[[pa.Table], Callable[[Column], Column]] | None = None, wave_rows: int | None = None) -> DataFrame:
    """(query_id, id, score) of the ``k`` best corpus rows per query.

    Both sides have ``feature`` and, when set, ``by``; a query only sees corpus rows of equal ``by``.
    ``narrow`` gives a condition on ``feature`` that every corpus row which can match a query of the wave
    fulfils; other rows leave the JVM without their feature.
    """
    qtype, ctype = queries.schema["query_id"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()
    out_schema = f"query_id {qtype}, id {ctype}, score double"
    extra = [by] if by else []
    q = queries.select("query_id", "feature", *extra)
    c = corpus.select("id", "feature", *extra)
    spark = q.sparkSession

    def one(wave: pa.Table) -> DataFrame:
        block = spark.sparkContext.broadcast(wave)  # held to the wave's rows and bytes

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = block.value
            qids, qby = _objects(t["query_id"]), (_objects(t[by]) if by else None)
            scorer, keeper, ct = make_scorer(_plain(t["feature"])), _Keeper(k), None
            for b in batches:
                ct = b.schema.field("id").type
                b = b.filter(b["feature"].is_valid()) if narrow else b
                _score_batch(keeper, scorer, qids, qby, _objects(b["id"]), b["feature"], _objects(b[by]) if by else None)
            best = keeper.result()
            if best is not None:
                yield pa.record_batch([pa.array(best[0], type=t.schema.field("query_id").type), pa.array(best[1], type=ct),
                                       pa.array(best[2], type=pa.float64())], names=["query_id", "id", "score"])

        own = c
        if narrow:
            # inside one expression, so that the feature is made once; a filter would make it again
            fits = narrow(wave)
            own = c.withColumn("feature", F.transform(F.array("feature"), lambda x: F.when(fits(x), x))[0])
        return own.mapInArrow(scan, out_schema)

    # each wave's rows, k per query and task, are written once; a lone wave is not written at all
    done, last, partial = [], None, None
    for wave in _waves(q, wave_rows or WAVE_ROWS, WAVE_BYTES):
        if last is not None and make_scorer is CosineScorer:
            partial = _grid(q, c, k, by, out_schema, wave_rows or WAVE_ROWS)
            break
        if last is not None:
            done.append(cut_lineage(last))
        last = one(wave)
    if partial is None:
        partial = spark.createDataFrame([], out_schema) if last is None else cut_lineage(last) if done else last
    for rows in done:
        partial = partial.unionByName(rows)

    # two cuts: the first spreads a query's partial lists over several tasks
    order = [F.col("score").asc(), F.col("id").asc()]
    spread = F.pmod(F.xxhash64("id"), F.lit(32))
    first = partial.withColumn("_s", spread).withColumn("_r", F.row_number().over(W.partitionBy("query_id", "_s").orderBy(*order)))
    return first.filter(F.col("_r") <= k).select("query_id", "id", "score")


def vector_block(asked: pa.Table, rows: pa.Table, k: int, by: str | None, block: int) -> pa.Table:
    """(query_id, id, score) of the ``k`` best rows for each query; ``block`` queries are scored at a time."""
    # in the order of their ids rows are told by their place, and equal distances by the smaller one
    rows = rows.take(pc.sort_indices(rows, [("id", "ascending")], null_placement="at_start"))
    q, c = (unit_rows(list_matrix(_plain(x["feature"]))) for x in (asked, rows))
    groups = [(np.arange(len(q)), np.arange(len(c)))]
    if by:
        qby, cby = _objects(asked[by]), _objects(rows[by])
        groups = [(np.flatnonzero(qby == v), np.flatnonzero(cby == v)) for v in set(qby) & set(cby)]
    keeper = _Keeper(k)

    def unscored(some: np.ndarray, places: np.ndarray) -> None:
        keeper.add(np.repeat(some, len(places)), np.tile(places, len(some)), np.full(len(some) * len(places), np.nan))

    for mine, theirs in groups:
        known, found = (x[_has_length(m[x])] for x, m in ((mine, q), (theirs, c)))
        for at in range(0, len(known) if len(found) else 0, block):
            some = known[at:at + block]
            for r, j, score in nearest_rows(q[some], c[found], k):
                keeper.add(some[r], found[j], score)
        # rows without a distance come last
        unscored(known, np.setdiff1d(theirs, found)[:max(k - len(found), 0)])
        unscored(np.setdiff1d(mine, known), theirs[:k])
    at, place, score = keeper.result() or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table([asked["query_id"].take(pa.array(at)), rows["id"].take(pa.array(place)), pa.array(score, pa.float64())], names=["query_id", "id", "score"])


def _has_length(unit: np.ndarray) -> np.ndarray:
    return np.isfinite(unit).all(axis=1) & (unit.shape[1] > 0)


def _grid(q: DataFrame, c: DataFrame, k: int, by: str | None, out_schema: str, wave_rows: int) -> DataFrame:
    """(query_id, id, score) of the ``k`` best rows of each block for each query.

    Queries and rows are cut into parts by hash, and a task compares one part with one part: what it holds is bounded,
    and what is shuffled is each side once for every part of the other.
    """
    counted = [x.agg(F.count(F.lit(1)), F.max(F.size("feature"))).first() for x in (q, c)]  # four numbers
    (nq, wide), (nc, _) = counted
    cells = 4 * q.sparkSession.sparkContext.defaultParallelism
    most = max(1, min(GRID_ROWS, GRID_BYTES // (8 * max(wide or 1, 1)), math.ceil(math.sqrt(nq * nc / cells))))
    g, h = max(1, math.ceil(nq / most)), max(1, math.ceil(nc / most))
    part = lambda x, n: F.pmod(F.xxhash64(x, "feature"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))  # noqa: E731  # one kind, or equal numbers part by their hash
    left = q.withColumn("_q", part("query_id", g)).withColumn("_c", every(h))
    right = c.withColumn("_c", part("id", h)).withColumn("_q", every(g))

    def score(asked: pa.Table, rows: pa.Table) -> pa.Table:
        return vector_block(asked, rows, k, by, min(SCORE_BLOCK, wave_rows))

    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(score, out_schema)


def _ranked(df: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("query_id").orderBy(F.col("score").asc(), F.col("id").asc())
    return df.withColumn("rnk", F.row_number().over(by)).filter(F.col("rnk") <= k)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, by: str | None = None,
                wave_rows: int | None = None) -> DataFrame:
    """Exact nearest rows by cosine distance: (query_id, id, distance, rnk), ties broken by id.

    ``queries``: query_id, vector; ``corpus``: id, vector. Distances are rounded to nine digits so that
    ranks do not depend on the batching; a zero or missing vector has no distance and ranks last.
    """
    q = queries.withColumn("feature", F.col("vector"))
    c = corpus.withColumn("feature", F.col("vector"))
    out = _ranked(_topk(q, c, CosineScorer, k, by, wave_rows=wave_rows), k)
    return out.withColumnRenamed("score", "distance")


def lexical_topk(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, threshold: float = TRIGRAM_THRESHOLD,
                 by: str | None = None, wave_rows: int | None = None) -> DataFrame:
    """Most similar rows by trigrams above the threshold: (query_id, id, similarity, rnk).

    A similarity above t needs sizes within a factor of t, so rows outside the reach of a wave's smallest and
    largest query are left in the JVM.
    """
    q = queries.withColumn("feature", text.trigrams(F.col("text")))
    c = spread(corpus).withColumn("feature", text.trigrams(F.col("content")))

    def within(wave: pa.Table) -> Callable[[Column], Column]:
        sizes = [len(x) for x in wave["feature"].to_pylist() if x] or [0]
        least, most = threshold * min(sizes), max(sizes) / threshold if threshold > 0 else float("inf")
        return lambda grams: (F.size(grams) > least) & (F.size(grams) < most)

    out = _ranked(_topk(q, c, lambda grams: TrigramScorer(grams, threshold), k, by, within, wave_rows), k)
    return out.select("query_id", "id", (-F.col("score")).alias("similarity"), "rnk")


def rrf(left: DataFrame, right: DataFrame, k0: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; a missing side adds nothing."""
    l = left.select("query_id", "id", F.col("rnk").alias("vec_rank"))
    r = right.select("query_id", "id", F.col("rnk").alias("lex_rank"))

    def part(c: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(float(k0)) + F.col(c)), F.lit(0.0))

    return l.join(r, ["query_id", "id"], "full_outer").withColumn("rrf_score", part("vec_rank") + part("lex_rank"))


def hybrid_search(queries: DataFrame, corpus: DataFrame, top_k: int = TOP_K, overfetch: int = OVERFETCH,
                  corpus_name: str | None = None, filters: Mapping[str, object] | None = None,
                  allowed: tuple[str, ...] = (), threshold: float = TRIGRAM_THRESHOLD, k0: int = RRF_K,
                  by: str | None = None) -> DataFrame:
    """Filter, both top lists, fusion, final cut: (query_id, id, content, score, corpus, rnk).

    Filters go in before the ranking. The content is fetched last, for the winners only: ``top_k`` rows per
    query, which are sent to the corpus and not the reverse as long as their number is small.
    """
    c = corpus_filter(corpus, corpus_name, filters) if corpus_name else equality_filter(corpus, allowed, filters)
    k = top_k * overfetch
    queries = cut_lineage(queries)
    fused = rrf(vector_topk(queries, c, k, by), lexical_topk(queries, c, k, threshold, by), k0)
    win = W.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), F.col("id").asc())
    top = fused.withColumn("rnk", F.row_number().over(win)).filter(F.col("rnk") <= top_k)
    top = F.broadcast(top) if queries.count() * top_k <= MAX_WINNERS else top
    return c.select("id", "content").join(top, "id").select(
        "query_id", "id", "content", F.col("rrf_score").alias("score"),
        F.lit(corpus_view(corpus_name)[0] if corpus_name else None).cast("string").alias("corpus"), "rnk",
    )


def anomaly_context(anomalies: DataFrame, corpus: DataFrame, embed: Callable[[DataFrame], DataFrame],
                    top_k: int = TOP_K) -> DataFrame:
    """Code chunks for each anomaly: query text is its template, else its fingerprint; repo = service.

    Equal questions are asked once per (service, text) and the answers joined back.
    """
    asked = cut_lineage(anomalies.select("incident_id", "service", "fingerprint", "template")).withColumn(
        "text", F.when(F.length(F.trim(F.coalesce("template", F.lit("")))) > 0, F.col("template")).otherwise(F.col("fingerprint"))
    ).withColumn("query_id", F.sha2(F.concat_ws("\u0001", "service", "text"), 256))
    distinct = embed(asked.select("query_id", F.col("service").alias("repo"), "text").dropDuplicates(["query_id"]))
    found = hybrid_search(distinct, corpus, top_k, corpus_name="CODE", by="repo")
    return asked.select("incident_id", "query_id").join(found, "query_id").select(
        "incident_id", "id", "content", "score", "rnk"
    )
