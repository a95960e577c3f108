"""Running totals in time order that never gather a key, or a busy moment of a key, in one task.

A key is cut into slots of event time. A slot that still holds too many rows (a burst, or logs stamped to
the second) is cut again, at chosen (time, id) positions. The cut keeps the order, so what precedes a cut
is a sum of whole cuts before it plus the rows before it inside the cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.operators.windows import int_div
from opslens.session import cut_lineage

MAX_SLOT_ROWS = 2_000_000
MAX_BROADCAST_CUTS = 200_000
ID_BLOCKS = 1024


def _id_code(row_id: Column, lo: Column, hi: Column, kind: T.DataType) -> Column:
    """Number of the block a row id falls in between ``lo`` and ``hi``; keeps the order of ids."""
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
        code, first, last = row_id.cast("decimal(20,0)"), lo.cast("decimal(20,0)"), hi.cast("decimal(20,0)")
    else:
        # seven bytes after the part all ids share, read as one number
        h = [F.hex(F.encode(x.cast("string"), "UTF-8")) for x in (row_id, lo, hi)]
        differs = F.filter(F.sequence(F.lit(1), F.greatest(F.length(h[1]), F.lit(1))), lambda i: F.substr(h[1], i, F.lit(1)) != F.substr(h[2], i, F.lit(1)))
        skip = F.coalesce(F.try_element_at(differs, F.lit(1)), F.lit(1)) - 1
        code, first, last = (F.conv(F.rpad(F.substr(x, skip + 1, F.lit(14)), 14, "0"), 16, 10).cast("decimal(20,0)") for x in h)
    return F.floor((code - first) * ID_BLOCKS / (last - first + 1)).cast("int")


def find_cuts(rows: DataFrame, keys: Sequence[str], totals: DataFrame, ts_us: str, row_id: str,
              max_rows: int = MAX_SLOT_ROWS) -> DataFrame | None:
    """Start positions of the further cuts of crowded slots: (keys, _slot, starts); None when no slot is.

    ``totals`` holds ``n`` rows per (keys, _slot). Rows of crowded slots are counted per microsecond, and
    per id block where one microsecond alone is crowded, so no slot is gathered row by row.
    """
    at = [*keys, "_slot"]
    hot = totals.filter(F.col("n") > max_rows).select(*at)
    n_hot = hot.count()
    if n_hot == 0:
        return None
    if n_hot <= MAX_BROADCAST_CUTS:
        hot = F.broadcast(hot)
    crowded = rows.select(*at, ts_us, row_id).join(hot, at, "left_semi")
    moments = crowded.groupBy(*at, ts_us).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("lo"), F.max(row_id).alias("hi"))
    light = moments.filter(F.col("n") <= max_rows).select(*at, ts_us, F.col("lo").alias("first_id"), "n")
    tied = moments.filter(F.col("n") > max_rows).select(*at, ts_us, "lo", "hi")
    kind = rows.schema[row_id].dataType
    blocks = (
        crowded.join(tied, [*at, ts_us])
        .groupBy(*at, ts_us, _id_code(F.col(row_id), F.col("lo"), F.col("hi"), kind).alias("_b"))
        .agg(F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("n")).drop("_b")
    )
    units = light.unionByName(blocks)
    before = F.sum("n").over(W.partitionBy(*at).orderBy(ts_us, "first_id").rowsBetween(W.unboundedPreceding, -1))
    cut = int_div(F.coalesce(before, F.lit(0)), max_rows)
    pos = F.struct(F.col(ts_us).alias("t"), F.col("first_id").alias("i"))
    starts = units.withColumn("_cut", cut).groupBy(*at, "_cut").agg(F.min(pos).alias("start")).filter("_cut > 0")
    return cut_lineage(starts.groupBy(*at).agg(F.array_sort(F.collect_list("start")).alias("starts")))


def with_cut(rows: DataFrame, keys: Sequence[str], cuts: DataFrame | None, ts_us: str, row_id: str) -> DataFrame:
    """Adds ``_cut``, zero outside crowded slots. The cut list is broadcast only while it is short."""
    if cuts is None:
        return rows.withColumn("_cut", F.lit(0))
    side = F.broadcast(cuts) if cuts.agg(F.sum(F.size("starts"))).first()[0] <= MAX_BROADCAST_CUTS else cuts
    here = F.struct(F.col(ts_us).alias("t"), F.col(row_id).alias("i"))
    passed = F.coalesce(F.size(F.filter("starts", lambda s: s <= here)), F.lit(0))
    return rows.join(side, [*keys, "_slot"], "left").withColumn("_cut", F.greatest(passed, F.lit(0))).drop("starts")


def with_slots(df: DataFrame, keys: Sequence[str], ts_us: str = "ts_us", row_id: str = "event_id", slot_s: int = 10,
               max_rows: int = MAX_SLOT_ROWS) -> DataFrame:
    """Adds ``_slot`` and ``_cut``. Counts rows per slot first: one narrow pass."""
    marked = df.withColumn("_slot", int_div(F.col(ts_us), slot_s * 1_000_000))
    totals = cut_lineage(marked.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("n")))
    return with_cut(marked, keys, find_cuts(marked, keys, totals, ts_us, row_id, max_rows), ts_us, row_id)


def running_sums(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], ts_us: str = "ts_us",
                 row_id: str = "event_id", slot_s: int = 10, max_rows: int = MAX_SLOT_ROWS) -> DataFrame:
    """``df`` plus, per name in ``values``, the sum over the rows of the key up to and including this one.

    Slot totals (partial aggregates) give what came before each slot; that row goes in front of the slot's
    rows and one running sum per slot does the rest, so rows are shuffled once and joined with nothing.
    Values must be whole numbers or decimals for the result not to depend on the cut. A frame that already
    went through ``with_slots`` is taken as it is.
    """
    keys = list(keys)
    marked = df if "_slot" in df.columns else with_slots(df, keys, ts_us, row_id, slot_s, max_rows)
    for name, c in values.items():
        marked = marked.withColumn(f"_v_{name}", c)
    at = [*keys, "_slot", "_cut"]
    totals = marked.groupBy(*at).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    earlier = W.partitionBy(*keys).orderBy("_slot", "_cut").rowsBetween(W.unboundedPreceding, -1)
    heads = totals.select(
        *at, F.lit(0).alias("_rank"), *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_d_{n}") for n in values]
    )
    rows = marked.select("*", F.lit(1).alias("_rank"), *[F.col(f"_v_{n}").alias(f"_d_{n}") for n in values])
    by = W.partitionBy("_slot", *keys, "_cut").orderBy("_rank", ts_us, row_id).rowsBetween(W.unboundedPreceding, 0)
    out = heads.unionByName(rows, allowMissingColumns=True)
    out = out.select("*", *[F.sum(f"_d_{n}").over(by).alias(n) for n in values])
    return out.filter(F.col("_rank") == 1).select(*df.columns, *values)
