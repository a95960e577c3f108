"""Connected components over an edge table, in rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.rows import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (a, b: long, either order).

    Each round hooks every edge's larger root under its smaller one and then points nodes at their root's root; roots
    of an edge meet in an aggregate, so a hub's edges are reduced before they are shuffled. Rounds end when all edges
    lie within one root; their number grows with the logarithm of the longest chain.
    """
    both = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = cut(both)
    label = cut(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not left.isEmpty():
        hooks = left.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("next"))
        # a hook always leads to a smaller root, so chains of hooks end; follow them before touching the nodes
        hooks = cut(hooks)
        while True:
            far = hooks.alias("h").join(hooks.alias("g"), F.col("h.next") == F.col("g.root"), "left")
            far = cut(far.select("h.root", F.coalesce("g.next", "h.next").alias("next"), F.col("g.next").isNotNull()
                                 .alias("moved")))
            moved = not far.where("moved").isEmpty()
            hooks = far.drop("moved")
            if not moved:
                break
        label = cut(label.join(hooks, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        one = left.join(hooks.withColumnsRenamed({"root": "b", "next": "b2"}), "b", "left").select(
            "a", F.coalesce("b2", "b").alias("b"))
        two = one.join(hooks.withColumnsRenamed({"root": "a", "next": "a2"}), "a", "left").select(
            F.coalesce("a2", "a").alias("a"), "b")
        left = cut(two.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return label.select("node", F.col("root").alias("component"))
