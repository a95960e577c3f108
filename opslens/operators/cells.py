"""Exact nearest rows from stored cells: a query reads the parts of the corpus that can hold one of its ``k`` best.

Vectors of length one are points whose straight-line distance obeys the triangle inequality, and cosine distance is half
its square. Each row lies with its nearest centre, and within that cell in shells of its distance to the centre. A row of
a shell [lo, hi] around a centre at distance d of the query is no nearer than ``d - hi`` and ``lo - d``. A first round
visits each query's most promising shells until they hold ``k`` rows; the k-th of these bounds a second round, which
reads every shell that the bound does not rule out. The result is ``vector_topk``'s, whatever the centres are; they
decide how much is read.

Centres are picked from a bounded sample (``sample_rows``), every row is stored. In the first round shells are cut into
pieces of about ``heavy`` rows and their queries into blocks, so no task holds more than one piece and one block. In the
second, neighbouring cells make up chunks of about ``heavy`` rows, as do queries by their nearest cells; a task compares a
chunk of queries with a chunk of rows if a query of the one needs the other, so that even where nothing is ruled out, a
row is sent out once for each chunk of the other side, not for each query and shell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions.kernels import CosineScorer, list_matrix, nearest_rows, unit_rows
from opslens.operators.retrieve import SCORE_BLOCK, TOP_K, _Keeper, _objects, _plain, _ranked, _score_batch
from opslens.session import cut_lineage

SHELL_WIDTH = 0.1
SHELLS = 21  # of a cell: distances between points of length one go up to 2
MOST_CELLS = 1_024
CELL_ROWS = 256
SAMPLE_ROWS = 8_192
HEAVY = 16_384
QUERY_BLOCK = 4_096
SCORE_ROWS = 2_048
EMIT_ROWS = 4_096
SLACK = 1e-7  # of a distance, well over the rounding of its square


@dataclass
class Cells:
    """``rows``: (id, vector, shell, cell), cell -1 for vectors without a direction; ``centres``: one point a cell;
    ``shells``: (shell, n, lo, hi), at most ``SHELLS`` a cell."""

    rows: DataFrame
    centres: np.ndarray
    shells: np.ndarray
    heavy: int = HEAVY


def _has_direction(vector: Column) -> Column:
    norm = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.coalesce((norm > 0) & (norm < F.lit(math.inf)), F.lit(False))


def _spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the points, each the one farthest from those before it."""
    chosen, left = [0], np.full(len(points), np.inf)
    while len(chosen) < n:
        left = np.minimum(left, 1.0 - points @ points[chosen[-1]])
        at = int(np.argmax(left))
        if left[at] <= 1e-9:
            break
        chosen.append(at)
    return points[chosen]


def _centres(sound: DataFrame, cells: int | None, sample_rows: int) -> np.ndarray:
    total = sound.count()
    if not total:
        return np.zeros((0, 0))
    n = cells or min(MOST_CELLS, max(1, total // CELL_ROWS))
    share = min(1.0, 1.5 * sample_rows / total)
    picked = sound.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vector").limit(sample_rows)
    points = list_matrix(_plain(picked.toArrow()["vector"]))  # held to sample_rows
    return _spread_out(unit_rows(points), n) if len(points) else np.zeros((0, 0))


def build(corpus: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, heavy: int = HEAVY) -> Cells:
    """The cells of (id, vector) rows of distinct ids and one vector length. ``cells`` defaults to one for each
    ``CELL_ROWS`` rows, at most ``MOST_CELLS``."""
    c = corpus.select("id", "vector", _has_direction(F.col("vector")).alias("_ok"))
    sound = c.filter("_ok").select("id", "vector")
    centres = _centres(sound, cells, sample_rows)
    if not len(centres) and sound.limit(1).count():  # the sample met no row: any one will do
        centres = unit_rows(list_matrix(_plain(sound.select("vector").limit(1).toArrow()["vector"])))
    block = corpus.sparkSession.sparkContext.broadcast(centres)  # at most `cells` points

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = block.value
        for b in batches:
            if not b.num_rows:
                continue
            m = unit_rows(list_matrix(b["vector"]))
            cell = np.argmax(m @ at.T, axis=1)
            dist = np.sqrt(((m - at[cell]) ** 2).sum(axis=1))
            shell = cell * SHELLS + np.minimum((dist / SHELL_WIDTH).astype(np.int64), SHELLS - 1)
            yield pa.record_batch([b["id"], b["vector"], pa.array(shell, pa.int64()), pa.array(cell, pa.int64()), pa.array(dist)],
                                  names=["id", "vector", "shell", "cell", "dist"])

    kinds = {f.name: f.dataType.simpleString() for f in corpus.select("id", "vector").schema}
    placed = sound.mapInArrow(place, f"id {kinds['id']}, vector {kinds['vector']}, shell bigint, cell bigint, dist double")
    rest = c.filter("NOT _ok").select("id", "vector", F.lit(-1).cast("bigint").alias("shell"), F.lit(-1).cast("bigint").alias("cell"), F.lit(None).cast("double").alias("dist"))
    rows = cut_lineage(placed.unionByName(rest))
    found = rows.filter("shell >= 0").groupBy("shell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    table = np.array([tuple(r) for r in found.orderBy("shell").collect()], dtype=np.float64).reshape(-1, 4)  # cells x SHELLS at most
    return Cells(rows.drop("dist"), centres, table, heavy)


def _cell_rows(index: Cells) -> np.ndarray:
    """The rows of each cell."""
    return np.bincount((index.shells[:, 0] // SHELLS).astype(np.int64), index.shells[:, 1], minlength=len(index.centres)).astype(np.int64)


def store(index: Cells, path: str) -> None:
    """Write rows, centres and shells; rows lie in a folder for each cell, so that a search opens the cells it visits."""
    spark = index.rows.sparkSession
    pieces = spark.createDataFrame([(c, -(-n // index.heavy)) for c, n in enumerate(_cell_rows(index).tolist()) if n], "cell bigint, pieces bigint")
    piece = F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(64)))
    rows = index.rows.join(F.broadcast(pieces), "cell", "left").select(*index.rows.columns, piece.alias("_piece"))
    rows.repartition("cell", "_piece").drop("_piece").sortWithinPartitions("cell", "shell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame(list(enumerate(index.centres.tolist())), "cell bigint, point array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    spark.createDataFrame([(int(s), int(n), lo, hi) for s, n, lo, hi in index.shells.tolist()], "shell bigint, n bigint, lo double, hi double").write.mode(
        "overwrite").parquet(f"{path}/shells")


def load(spark: SparkSession, path: str, heavy: int = HEAVY) -> Cells:
    centres = [r["point"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]
    shells = [tuple(r) for r in spark.read.parquet(f"{path}/shells").orderBy("shell").collect()]
    rows = spark.read.parquet(f"{path}/rows").withColumn("cell", F.col("cell").cast("bigint"))
    return Cells(rows, np.array(centres, dtype=np.float64).reshape(len(centres), -1), np.array(shells, dtype=np.float64).reshape(-1, 4), heavy)


def _visits(index: Cells, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vector, shell, pieces) of the shells a query visits.

    With a column ``bound`` (a cosine distance) these are all shells that can hold a row as near as that, without it the
    most promising ones up to ``k`` rows.
    """
    block = index.rows.sparkSession.sparkContext.broadcast((index.centres, index.shells))  # see Cells
    heavy, bounded = index.heavy, "bound" in asked.columns
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, shells = block.value
        number, n, lo, hi = shells[:, 0].astype(np.int64), shells[:, 1], shells[:, 2], shells[:, 3]
        pieces = np.ceil(n / heavy).astype(np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                q = unit_rows(list_matrix(b["vector"]))
                d = np.sqrt(np.maximum(2.0 - 2.0 * (q @ centres.T), 0.0))[:, number // SHELLS]
                least = np.maximum(np.maximum(d - hi, lo - d), 0.0)
                if bounded:
                    bound = b["bound"].to_numpy(zero_copy_only=False)
                    reach = np.sqrt(2.0 * (bound + 1e-9)) + SLACK
                    owner, to = np.nonzero(least <= reach[:, None])
                else:
                    # shells that may hold the query itself first, of them those of the nearest centre
                    order = np.lexsort((d, least), axis=1)
                    held = np.cumsum(n[order], axis=1)
                    owner, place = np.nonzero(held - n[order] < k)
                    to = order[owner, place]
                for i in range(0, len(to), EMIT_ROWS):
                    o, t = pa.array(owner[i:i + EMIT_ROWS]), to[i:i + EMIT_ROWS]
                    yield pa.record_batch([b["query_id"].take(o), b["vector"].take(o), pa.array(number[t]), pa.array(pieces[t])],
                                          names=["query_id", "vector", "shell", "pieces"])

    return asked.mapInArrow(pick, f"query_id {kinds['query_id']}, vector {kinds['vector']}, shell bigint, pieces bigint")


def _scored(index: Cells, visits: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of at most ``k`` rows for each query and piece it visits."""
    visits = cut_lineage(visits)
    need = visits.groupBy("shell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"), F.max("pieces").alias("pieces"))
    need = cut_lineage(need)  # a row for each shell visited
    cells = [r[0] for r in need.select(F.floor(F.col("shell") / SHELLS).alias("cell")).distinct().collect()]
    q = visits.join(need.drop("pieces"), "shell").select(
        "query_id", "vector", "shell", F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"))
    r = index.rows.filter(F.col("cell").isin(cells)).join(need, "shell").select(
        "id", "vector", "shell", F.pmod(F.xxhash64("id"), F.col("pieces")).alias("piece"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    qtype, ctype = visits.schema["query_id"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString()

    def score(asked: pa.Table, rows: pa.Table) -> pa.Table:
        kinds = [asked.schema.field("query_id").type, rows.schema.field("id").type, pa.float64()]
        keeper = _Keeper(k)
        if asked.num_rows and rows.num_rows:
            scorer, qids = CosineScorer(_plain(asked["vector"])), _objects(asked["query_id"])
            for at in range(0, rows.num_rows, SCORE_ROWS):
                part = rows.slice(at, SCORE_ROWS)
                _score_batch(keeper, scorer, qids, None, _objects(part["id"]), _plain(part["vector"]), None)
        best = keeper.result() or ([], [], [])
        return pa.table([pa.array(x, t) for x, t in zip(best, kinds, strict=True)], names=["query_id", "id", "score"])

    key = ["shell", "piece", "block"]
    best = q.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(score, f"query_id {qtype}, id {ctype}, score double")
    # two cuts: the first spreads a query's lists over several tasks
    salted = W.partitionBy("query_id", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("score", "id")
    return best.withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= k).drop("_r")


def _bounded(index: Cells, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vector, bound): the first round's ``k``-th distance of each query with a direction."""
    asked = queries.filter(_has_direction(F.col("vector"))).select("query_id", "vector")
    first = _ranked(_scored(index, _visits(index, asked, k), k), k)
    bound = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(F.lit(math.inf)).alias("bound"))
    return asked.join(bound, "query_id")


def second_round(index: Cells, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, vector, shell, pieces) of all shells that can hold one of a query's ``k`` best rows."""
    return _visits(index, _bounded(index, queries, k), k)


def _least(centres: np.ndarray, shells: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least distance of each query to a row of each shell."""
    d = np.sqrt(np.maximum(2.0 - 2.0 * (q @ centres.T), 0.0))[:, shells[:, 0].astype(np.int64) // SHELLS]
    return np.maximum(np.maximum(d - shells[:, 3], shells[:, 2] - d), 0.0)


def _reach(bound: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 * (bound + 1e-9)) + SLACK


def _in_turn(centres: np.ndarray) -> np.ndarray:
    """The cells in an order in which each follows its nearest among those left."""
    order, left = [0], np.ones(len(centres), bool)
    left[0] = False
    while left.any():
        order.append(int(np.argmax(np.where(left, centres @ centres[order[-1]], -np.inf))))
        left[order[-1]] = False
    return np.array(order)


def _chunks(order: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(chunk, pieces) of each cell of ``n`` rows: cells in turn share a chunk, one of over ``most`` rows has several."""
    chunk, pieces, at, held = np.zeros(len(n), np.int64), np.maximum(-(-n // most), 1), 0, 0
    for c in order:
        if held and (held + n[c] > most):
            at, held = at + 1, 0
        chunk[c], held = at, held + n[c]
        if pieces[c] > 1:
            at, held = at + pieces[c], 0
    return chunk, pieces


def _compared(index: Cells, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score), among them the ``k`` best rows of each query; ``bound`` is a distance that they do not exceed."""
    spark, order, n = asked.sparkSession, _in_turn(index.centres), _cell_rows(index)
    chunk, pieces = _chunks(order, n, index.heavy)
    block = spark.sparkContext.broadcast((index.centres, index.shells, chunk, pieces))  # see Cells
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, shells, chunk, pieces = block.value
        cell = shells[:, 0].astype(np.int64) // SHELLS
        many = int((chunk + pieces).max())
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                q = unit_rows(list_matrix(b["vector"]))
                owner, shell = np.nonzero(_least(centres, shells, q) <= _reach(b["bound"].to_numpy())[:, None])
                need = np.zeros((b.num_rows, many), bool)
                need[owner, chunk[cell[shell]]] = True
                for c in np.flatnonzero(pieces > 1):
                    need[:, chunk[c]:chunk[c] + pieces[c]] = need[:, chunk[c]:chunk[c] + 1]
                own, to = np.nonzero(need)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(b.num_rows + 1)), pa.int32()), pa.array(to))
                home = pa.array(np.argmax(q @ centres.T, axis=1))
                yield pa.record_batch([b["query_id"], b["vector"], b["bound"], home, lists], names=["query_id", "vector", "bound", "cell", "need"])

    routed = cut_lineage(asked.select("query_id", "vector", "bound").mapInArrow(
        route, f"query_id {kinds['query_id']}, vector {kinds['vector']}, bound double, cell bigint, need array<bigint>"))
    homes = np.zeros(len(n), np.int64)
    for cell, many in routed.groupBy("cell").count().collect():  # a row for each cell at most
        homes[cell] = many

    def dealt(rows: DataFrame, of: tuple[np.ndarray, np.ndarray], key: str, name: str) -> DataFrame:
        turn = spark.createDataFrame([(c, int(a), int(p)) for c, (a, p) in enumerate(zip(*of, strict=True))], "cell bigint, _first bigint, _pieces bigint")
        return rows.join(F.broadcast(turn), "cell").withColumn(name, F.col("_first") + F.pmod(F.xxhash64(key), "_pieces")).drop("_first", "_pieces", "cell")

    q = dealt(routed, _chunks(order, homes, index.heavy), "query_id", "_q").withColumn("_c", F.explode("need")).drop("need")
    met = cut_lineage(q.select("_q", "_c").distinct())  # a row for each two chunks that meet
    r = dealt(index.rows.filter("cell >= 0"), (chunk, pieces), "id", "_c").join(F.broadcast(met), "_c")

    def score(asked: pa.Table, rows: pa.Table) -> pa.Table:
        centres, shells, *_ = block.value
        rows = rows.take(pc.sort_indices(rows, [("id", "ascending")], null_placement="at_start"))
        keeper = _Keeper(k)
        if asked.num_rows and rows.num_rows:
            q, c = (unit_rows(list_matrix(_plain(x["vector"]))) for x in (asked, rows))
            here, place = np.unique(rows["shell"].to_numpy(), return_inverse=True)
            some = shells[np.searchsorted(shells[:, 0], here)]
            bound = asked["bound"].to_numpy()
            by_home = np.argsort(np.argmax(q @ centres.T, axis=1), kind="stable")
            for at in range(0, len(q), SCORE_BLOCK):
                mine = by_home[at:at + SCORE_BLOCK]
                visited = (_least(centres, some, q[mine]) <= _reach(bound[mine])[:, None]).any(axis=0)
                found = np.flatnonzero(visited[place])
                for a, b, score in nearest_rows(q[mine], c[found], k, bound[mine]):
                    keeper.add(mine[a], found[b], score)
        at, place, score = keeper.result() or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([asked["query_id"].take(pa.array(at)), rows["id"].take(pa.array(place)), pa.array(score, pa.float64())], names=["query_id", "id", "score"])

    ctype = index.rows.schema["id"].dataType.simpleString()
    best = q.groupBy("_q", "_c").cogroup(r.groupBy("_q", "_c")).applyInArrow(score, f"query_id {kinds['query_id']}, id {ctype}, score double")
    salted = W.partitionBy("query_id", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("score", "id")
    return best.withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= k).drop("_r")


def _plain_ids(rows: DataFrame, n: int) -> Column:
    return F.array(*[F.lit(r["id"]) for r in rows.select("id").orderBy("id").limit(n).collect()])  # at most k ids


def search(index: Cells, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, id, distance, rnk) of the ``k`` nearest rows, ties broken by id: the rows of ``vector_topk``.

    ``queries``: query_id (distinct), vector. Rows without a direction (null, zero, or with a component that is null or
    not finite) have no distance and come last; a query without one gets the smallest ids.
    """
    sound = _has_direction(F.col("vector"))
    total = int(index.shells[:, 1].sum())
    kind = index.rows.schema["id"].dataType.simpleString()
    qtype = queries.schema["query_id"].dataType.simpleString()
    if total:
        out = _compared(index, _bounded(index, queries, k), k)
    else:
        out = queries.sparkSession.createDataFrame([], f"query_id {qtype}, id {kind}, score double")

    def unscored(asked: DataFrame, rows: DataFrame, n: int) -> DataFrame:
        ids = _plain_ids(rows, n).cast(f"array<{kind}>")
        return asked.select("query_id", F.explode(ids).alias("id"), F.lit(math.nan).alias("score"))

    if total < k:
        out = out.unionByName(unscored(queries.filter(sound), index.rows.filter("cell = -1"), k - total))
    out = out.unionByName(unscored(queries.filter(~sound), index.rows, k))
    return _ranked(out, k).withColumnRenamed("score", "distance")


def share_read(index: Cells, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, rows_read, share) of the second round: how many of the stored rows a query is compared with."""
    spark = queries.sparkSession
    sizes = spark.createDataFrame([(int(s), int(n)) for s, n in index.shells[:, :2].tolist()], "shell bigint, n bigint")
    read = second_round(index, queries, k).join(sizes, "shell").groupBy("query_id").agg(F.sum("n").alias("rows_read"))
    return read.withColumn("share", F.col("rows_read") / F.lit(float(max(index.shells[:, 1].sum(), 1))))
