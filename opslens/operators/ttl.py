"""Cache hits under a fixed-anchor time to live.

An entry lives ``ttl_s`` seconds from the moment it was written and a hit does not extend it, so whether
a request hits depends on the chain of earlier writes of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.operators.windows import int_div
from opslens.session import cut_lineage


def _next_writes(secs: DataFrame, ttl_s: int) -> tuple[DataFrame, DataFrame]:
    """((key, sec, next), heads (key, sec)) for (key, sec, b) with ``b`` the second's bucket of ``ttl_s`` seconds.

    If ``sec`` wrote, the next write is the first request at ``sec + ttl_s`` or later. It is looked for in the following
    bucket, among its seconds from the same place on, or else it is the first second of the bucket after that. A
    request that follows a silence of a whole lifetime writes in any case: such requests are the heads.
    """
    by_time = W.partitionBy("key").orderBy("b")  # a key has one row for each lifetime that it is seen in
    buckets = secs.groupBy("key", "b").agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"))
    buckets = cut_lineage(buckets.select(
        "key", "b", "lo", F.lag("hi").over(by_time).alias("before"), F.lead("b").over(by_time).alias("b1"),
        F.lead("lo").over(by_time).alias("lo1"), F.lead("lo", 2).over(by_time).alias("lo2")))
    heads = buckets.filter(F.col("before").isNull() | (F.col("lo") - F.col("before") >= ttl_s)).select("key", F.col("lo").alias("sec"))
    # within a bucket: the seconds themselves, and those of the bucket before moved up by a lifetime, from the end on
    ends = secs.select("key", "b", F.col("sec").alias("at"), F.col("sec").alias("to"), F.lit(None).cast("bigint").alias("sec"))
    asks = secs.select("key", (F.col("b") + 1).alias("b"), (F.col("sec") + ttl_s).alias("at"), F.lit(None).cast("bigint").alias("to"), "sec")
    from_end = W.partitionBy("key", "b").orderBy(F.desc("at"), F.desc_nulls_last("to")).rowsBetween(W.unboundedPreceding, 0)
    found = ends.unionByName(asks).withColumn("to", F.min("to").over(from_end)).filter("sec IS NOT NULL")
    here = found.withColumn("b", F.col("b") - 1).join(buckets.drop("lo", "before"), ["key", "b"])
    later = F.when(F.col("b1") == F.col("b") + 1, F.coalesce("to", "lo2")).otherwise(F.col("lo1"))
    return here.select("key", "sec", later.alias("next")).filter("next IS NOT NULL"), heads


def _chained(secs: DataFrame, ttl_s: int) -> DataFrame:
    """(key, sec) of the writes of keys whose requests span more than a lifetime.

    From the heads the writes are followed by pointers that reach twice as far in each round, so a chain of n writes
    takes log2(n) rounds of joins on (key, sec), and the seconds of one key are spread over all tasks.
    """
    jump, heads = _next_writes(secs, ttl_s)
    jump = cut_lineage(jump)
    # only a head or a next write is ever passed through
    jump = cut_lineage(jump.join(jump.select("key", F.col("next").alias("sec")).unionByName(heads).distinct(), ["key", "sec"]))
    marks = cut_lineage(heads)
    while True:
        more = marks.join(jump, ["key", "sec"]).select("key", F.col("next").alias("sec")).distinct()
        more = cut_lineage(more.join(marks, ["key", "sec"], "left_anti"))
        if more.isEmpty():
            return marks
        marks = cut_lineage(marks.unionByName(more))
        far = jump.select("key", F.col("sec").alias("next"), F.col("next").alias("far"))
        jump = cut_lineage(jump.join(far, ["key", "next"]).select("key", "sec", F.col("far").alias("next")))


def write_anchors(df: DataFrame, key: str, ttl_s: int, ts_us: str = "ts_us", row_id: str = "event_id") -> DataFrame:
    """The writes of each key: (key, sec, ts_us, row id).

    Requests are first reduced to one row per key and whole second. A key whose seconds all lie within one lifetime
    has one write and needs no chain at all.
    """
    secs = cut_lineage(
        df.select(F.col(key).alias("key"), int_div(F.col(ts_us), 1_000_000).alias("sec"), F.struct(F.col(ts_us), F.col(row_id)).alias("at"))
        .filter("key IS NOT NULL").groupBy("key", "sec").agg(F.min("at").alias("at"))
    )
    span = secs.groupBy("key").agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"))
    span = cut_lineage(span.withColumn("long", F.col("hi") - F.col("lo") >= ttl_s))
    writes = span.filter("NOT long").select("key", F.col("lo").alias("sec"))
    long_keys = span.filter("long").select("key")
    if not long_keys.isEmpty():
        seen = secs.select("key", "sec", int_div(F.col("sec"), ttl_s).alias("b")).join(long_keys, "key", "left_semi")
        writes = writes.unionByName(_chained(cut_lineage(seen), ttl_s))
    return writes.join(secs, ["key", "sec"]).select("key", "sec", "at")


def cache_hits(df: DataFrame, key: str, ttl_s: int, ts_us: str = "ts_us", row_id: str = "event_id",
               writes: Column | None = None) -> DataFrame:
    """``df`` plus ``is_hit``. Ages are whole seconds; a null key is never a hit.

    ``writes`` tells which requests store their answer on a miss (default all). A request that would not
    store is still a hit while an earlier entry lives.
    """
    if writes is None:
        a = write_anchors(df, key, ttl_s, ts_us, row_id).select(F.col(f"at.{row_id}").alias(row_id), F.lit(False).alias("_hit"))
        return df.join(a, row_id, "left").withColumn("is_hit", F.coalesce("_hit", F.col(key).isNotNull())).drop("_hit")
    marked = df.withColumn("_w", F.coalesce(writes, F.lit(False)))
    a = write_anchors(marked.filter("_w"), key, ttl_s, ts_us, row_id)
    ids = a.select(F.col(f"at.{row_id}").alias(row_id), F.lit(False).alias("_hit"))
    stored = marked.filter("_w").join(ids, row_id, "left").withColumn("is_hit", F.coalesce("_hit", F.col(key).isNotNull())).drop("_hit")
    # a lifetime touches at most two buckets of its own length, and a bucket at most two lifetimes
    own = int_div(F.col("sec"), ttl_s)
    spans = (
        a.select("key", "sec", "at", F.explode(F.array(own, own + 1)).alias("b"))
        .groupBy("key", "b").agg(F.collect_list(F.struct("sec", "at")).alias("live"))
    )
    others = marked.filter("NOT _w").withColumn("_s", int_div(F.col(ts_us), 1_000_000))
    others = others.withColumn("_b", int_div(F.col("_s"), ttl_s)).withColumn("_at", F.struct(F.col(ts_us), F.col(row_id)))
    joined = others.join(spans, (F.col(key) == F.col("key")) & (F.col("_b") == F.col("b")), "left") if key != "key" else others.join(
        spans.withColumnRenamed("b", "_b"), ["key", "_b"], "left"
    )
    hit = F.coalesce(
        F.exists("live", lambda x: (x["at"] < F.col("_at")) & (F.col("_s") - x["sec"] < ttl_s)), F.lit(False)
    )
    drop = ["_s", "_b", "_at", "live"] + (["b", "key"] if key != "key" else [])
    unstored = joined.withColumn("is_hit", hit).drop(*drop)
    return stored.unionByName(unstored).drop("_w")
