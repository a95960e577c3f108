"""Exact cosine links between vectors: pivots, boundary replication, independent cells.

On unit vectors a cosine of at least c is a distance of at most e = sqrt(2 - 2c). Pivots are a bounded sample of the
vectors; each vector lives in the cell of its nearest pivot h. By the triangle inequality a vector y of cell p within e
of x needs d(x, p) <= d(x, h) + 2e; for unit vectors the distance to the plane between the pivots says more:
(d(x, p)^2 - d(x, h)^2) / (2 d(h, p)) <= e. Where both hold, x is also sent to cell p, to the cell of the higher number
only, so a pair meets once. Cells are joined independently, a cell of many vectors in blocks: a task holds one block and
streams the rest of the cell and the visitors past it, so its memory does not grow with a hot cell.

Equal vectors are one node with a multiplicity, so copies are never compared with each other. A block reports link
counts per node and, for components, one edge per linked node (a local forest), never all its pairs.

Cost: vectors that lie in groups stay in few cells. For vectors spread evenly over a sphere of many dimensions no pivot
rule separates neighbours at this radius, cells are visited by nearly all vectors and the work is that of all pairs, in
matrix products; the result is exact either way.

Null vectors, zero vectors and those with null or non-finite components link with nothing; vectors of different lengths
are not linked; rows without vec_id are returned with no links and a null component; rows of one id are one vector; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.graph import components
from opslens.llm.rows import cut

CELL_ROWS = 4096
MOST_PIVOTS = 256
MARGIN = 1e-9


def usable(v):
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)


def unit(rows: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of a list column whose rows have one length."""
    m = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


class Block:
    """Home vectors of one block; counts links with what is streamed past."""

    def __init__(self, node: np.ndarray, many: np.ndarray, m: np.ndarray, least: float):
        self.node, self.many, self.m, self.least = node, many, m, least
        self.links = np.zeros(len(node), np.int64)
        self.label = np.arange(len(node))

    def join(self, hit: np.ndarray) -> None:
        """Vectors linked with a common row of ``hit`` get one label."""
        hit = hit[hit.sum(1) > 0]
        while len(hit):
            low = np.where(hit, self.label, len(self.node)).min(1)
            new = np.where(hit, low[:, None], len(self.node)).min(0)
            to = np.arange(len(self.node))
            np.minimum.at(to, self.label, np.minimum(new, self.label))
            if (to[self.label] == self.label).all():
                return
            self.label = to[self.label]

    def own(self, step: int = 512) -> None:
        for a in range(0, len(self.node), step):
            hit = self.m[a:a + step] @ self.m.T >= self.least
            rows = np.arange(a, min(a + step, len(self.node)))
            hit[rows - a, rows] = False
            self.links[rows] += hit @ self.many
            hit[rows - a, rows] = hit.any(1)
            self.join(hit)

    def visit(self, node: np.ndarray, many: np.ndarray, m: np.ndarray, step: int = 512):
        """(node, links, a home it is linked with) of the visitors that have any."""
        for a in range(0, len(node), step):
            hit = m[a:a + step] @ self.m.T >= self.least
            some = np.flatnonzero(hit.any(1))
            if len(some):
                hit = hit[some]
                self.links += many[a + some] @ hit
                self.join(hit)
                yield node[a + some], hit @ self.many, self.node[hit.argmax(1)]


def pair_up(nodes: DataFrame, pivots: list[list[float]], blocks: dict[int, int], cosine: float) -> DataFrame:
    """(cell, block, role, node, many, embedding): homes (role 0) and visitors (role 1) of every block."""
    reach = math.sqrt(2 - 2 * cosine) + MARGIN
    by_size: dict[int, np.ndarray] = {}
    number: dict[int, np.ndarray] = {}
    for size in {len(p) for p in pivots}:
        at = [i for i, p in enumerate(pivots) if len(p) == size]
        by_size[size] = unit(pa.array([pivots[i] for i in at], pa.list_(pa.float64())))
        number[size] = np.array(at)

    def run(batches):
        for batch in batches:
            emb = batch.column(2)
            sizes = pa.compute.list_value_length(emb).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(rows))
                if int(size) not in by_size:
                    cells, mine, home = np.array([-int(size)]), np.ones((len(rows), 1), bool), np.zeros(len(rows), int)
                else:
                    p, cells = by_size[int(size)], number[int(size)]
                    d2 = np.maximum(0, 2 - 2 * unit(part.column(2)) @ p.T)
                    home = d2.argmin(1)
                    own = d2[np.arange(len(rows)), home][:, None]
                    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
                    mine = (np.sqrt(d2) <= np.sqrt(own) + 2 * reach) & (d2 - own <= 2 * reach * between + MARGIN)
                    mine &= np.arange(len(cells)) > home[:, None]
                    mine[np.arange(len(rows)), home] = True
                row, cell = np.nonzero(mine)
                n = np.array([blocks.get(int(c), 1) for c in cells])
                at_home = cell == home[row]
                node = part.column(0).to_numpy()
                salt = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                first = np.where(at_home, (salt[row] % n[cell].astype(np.uint64)).astype(np.int64), 0)
                times = n[cell] - first  # its own block and the later ones, or all blocks of a visited cell
                k = np.repeat(np.arange(len(row)), times)
                block = first[k] + np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
                role = np.where(at_home[k] & (block == first[k]), 0, 1)
                for a in range(0, len(k), 20_000):
                    z = slice(a, a + 20_000)
                    sent = part.take(pa.array(row[k[z]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[cell[k[z]]].astype(np.int32)), pa.array(block[z].astype(np.int32)),
                         pa.array(role[z].astype(np.int32)), *sent.columns],
                        names=["cell", "block", "role", "node", "many", "embedding"])

    kinds = f"cell int, block int, role int, node long, many long, embedding {nodes.schema['embedding'].dataType.simpleString()}"
    return nodes.select("node", "many", "embedding").mapInArrow(run, kinds)


def homes(nodes: DataFrame, pivots: list[list[float]], cosine: float) -> dict[int, int]:
    """Vectors per cell: as many numbers as there are pivots and vector lengths."""
    at = pair_up(nodes, pivots, {}, cosine).where("role = 0").groupBy("cell").agg(F.count("*").alias("n"))
    return {r["cell"]: r["n"] for r in at.collect()}


def linked(nodes: DataFrame, *, cosine: float, cell_rows: int, most_pivots: int) -> DataFrame:
    """(a, n, b): link counts of nodes (b null), and edges of a forest of each block's links (n null)."""
    total = nodes.count()
    want = min(most_pivots, max(1, -(-total // cell_rows)))
    pivots = [list(r[0]) for r in nodes.orderBy(F.xxhash64("node"), "node").select("embedding").limit(want).collect()]
    count = homes(nodes, pivots, cosine)
    blocks = {c: -(-n // cell_rows) for c, n in count.items()}
    least = cosine

    def out(a, n, b):
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "n": pa.array(n, pa.int64()),
                                           "b": pa.array(b, pa.int64())})

    def run(batches):
        key, parts, block = None, [], None

        def ready():
            """The homes of a block are complete: they come first."""
            nonlocal block
            if block is None:
                block = Block(*(np.concatenate(x) for x in zip(*parts)), least)
                block.own()
            return block

        def done():
            if key is not None and parts:
                b = ready()
                some = b.links > 0
                yield out(b.node[some], b.links[some], np.full(some.sum(), None))
                apart = b.label != np.arange(len(b.node))
                yield out(b.node[apart], np.full(apart.sum(), None), b.node[b.label[apart]])

        for batch in batches:
            cell, blk, role = (batch.column(i).to_numpy() for i in range(3))
            change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(blk) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                if (cell[a], blk[a]) != key:
                    yield from done()
                    key, parts, block = (cell[a], blk[a]), [], None
                own = batch.slice(a, b - a)
                node, many, m = own.column(3).to_numpy(), own.column(4).to_numpy(), unit(own.column(5))
                if role[a] == 0:
                    parts.append((node, many, m))
                elif parts:
                    for who, n, with_ in ready().visit(node, many, m):
                        yield out(who, n, np.full(len(who), None))
                        yield out(who, np.full(len(who), None), with_)
        yield from done()

    sent = pair_up(nodes, pivots, blocks, cosine)
    n_tasks = max(1, sum(blocks.values()))
    return sent.repartition(n_tasks, "cell", "block").sortWithinPartitions("cell", "block", "role", "node").mapInArrow(
        run, "a long, n long, b long")


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.95, cell_rows: int = CELL_ROWS,
                    most_pivots: int = MOST_PIVOTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("embedding"))
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    nodes = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("many")))
    found = cut(linked(nodes, cosine=cosine, cell_rows=cell_rows, most_pivots=most_pivots))
    links = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("links"))
    comp = components(found.where("b is not null").select("a", "b"))
    copies = nodes.where("many > 1").groupBy("embedding").agg(F.min("node").alias("node"), F.max("many").alias("many"))
    own = good.join(copies, "embedding", "left").select(
        "vec_id", F.coalesce("node", "vec_id").alias("node"), (F.coalesce("many", F.lit(1)) - 1).alias("equal"))
    full = own.join(links.withColumnRenamed("a", "node"), "node", "left").join(comp, "node", "left").select(
        "vec_id", (F.col("equal") + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    bad = rows.where(~F.coalesce(F.col("vec_id").isNotNull() & usable(F.col("embedding")), F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
