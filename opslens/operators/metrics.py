"""Operational metrics as aggregates over captured rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions.ids import severity
from opslens.functions.text import preview
from opslens.sources.envelopes import DLQ_TOPICS

MAX_PEEK = 100


def rate(df: DataFrame, ts: str, seconds: int = 60, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per second in each tumbling interval."""
    start = (F.floor(F.unix_seconds(F.col(ts)) / seconds) * seconds).cast("bigint").alias("window_start_s")
    return df.groupBy(start, *keys).agg(F.count(F.lit(1)).alias("cnt")).withColumn("per_second", F.col("cnt") / F.lit(float(seconds)))


def counts_by(df: DataFrame, keys: Sequence[str | Column], name: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def terminal_states(audit: DataFrame, seconds: int = 60) -> DataFrame:
    """Final states per minute and as a rate."""
    return rate(audit, "started_at", seconds, ["status"])


def hourly_cost(calls: DataFrame, cap: float, usd_per_1k: float) -> DataFrame:
    """Tokens and cost per hour and model, and the share of the daily cap."""
    from opslens.operators.ledger import charged_tokens, price

    hour = (F.floor(F.col("ts_us") / 3_600_000_000) * 3600).cast("bigint").alias("hour_s")
    out = calls.groupBy(hour, "model").agg(F.sum(charged_tokens()).alias("tokens"))
    cost = price(F.col("tokens"), usd_per_1k)
    return out.withColumn("cost_usd", cost).withColumn("share_of_cap", cost / F.lit(cap))


def latency_percentiles(df: DataFrame, value: str, keys: Sequence[str], ps: Sequence[float] = (0.5, 0.95, 0.99),
                        exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """p50/p95/p99 per key: a mergeable sketch by default.

    The exact form counts distinct values, so give it whole milliseconds.
    """
    def p(q: float) -> Column:
        return F.percentile(value, F.lit(q)) if exact else F.percentile_approx(value, F.lit(q), F.lit(accuracy)).cast("double")

    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"), *[p(q).alias(f"p{round(q * 100)}") for q in ps])


def latency_sketches(df: DataFrame, value: str, keys: Sequence[str], ts_us: str = "ts_us", seconds: int = 60, size: int = 800) -> DataFrame:
    """One quantile sketch of whole numbers per key and slot of time, to be stored; its size does not grow with the rows."""
    slot = (F.floor(F.col(ts_us) / (seconds * 1_000_000)) * seconds).cast("bigint").alias("slot_s")
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, slot).agg(F.kll_sketch_agg_bigint(value, size).alias("sketch"))


def merged_percentiles(sketches: DataFrame, keys: Sequence[str], ps: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles per key over any range of stored slots. A rank is off by about 1/size of the rows."""
    one = sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("_all"))
    return one.select(*keys, F.kll_sketch_get_n_bigint("_all").alias("cnt"),
                      *[F.kll_sketch_get_quantile_bigint("_all", F.lit(q)).alias(f"p{round(q * 100)}") for q in ps])


def distinct_sketches(df: DataFrame, value: str, keys: Sequence[str], ts_us: str = "ts_us", seconds: int = 3600, bits: int = 14) -> DataFrame:
    """One distinct-count sketch per key and slot of time, to be stored."""
    slot = (F.floor(F.col(ts_us) / (seconds * 1_000_000)) * seconds).cast("bigint").alias("slot_s")
    return df.groupBy(*keys, slot).agg(F.hll_sketch_agg(value, F.lit(bits)).alias("sketch"), F.count(value).alias("rows"))


def merged_distinct(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and estimated distinct values per key over any range of stored slots."""
    return sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_est"))


def anomaly_counts(detected: DataFrame) -> DataFrame:
    """Reports by type, severity and whole-number bucket of the absolute score."""
    r = detected.filter(F.col("anomaly_type").isNotNull())
    return r.groupBy(
        "anomaly_type", severity(F.col("score"), "CRITICAL", "WARNING").alias("severity"),
        F.floor(F.abs("score")).cast("bigint").alias("score_bucket"),
    ).agg(F.count(F.lit(1)).alias("cnt"))


def dlq_tail(df: DataFrame, topic: str, limit: int = 20, known: Sequence[str] = DLQ_TOPICS) -> DataFrame:
    """Newest dead letters of a topic, spread over its partitions, with a preview of the value.

    The per-partition cut is a ranked limit, which Spark also applies before the shuffle.
    """
    if topic not in known:
        raise ValueError(f"unknown dead-letter topic {topic!r}; known: {', '.join(known)}")
    cap = min(max(limit, 1), MAX_PEEK)
    newest = W.partitionBy("partition").orderBy(F.col("offset").desc())
    head = df.filter(F.col("topic") == topic).withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= cap)
    everywhere = W.partitionBy("topic")
    n_parts = F.size(F.collect_set("partition").over(everywhere))
    share = F.greatest(F.lit(1), F.floor((F.lit(cap) + n_parts - 1) / n_parts))
    return (
        head.withColumn("_share", share).filter(F.col("_rn") <= F.col("_share"))
        .orderBy(F.col("_rn"), F.col("partition")).limit(cap)
        .select("partition", "offset", "key", preview(F.col("value")).alias("value_preview"))
    )


def dlq_backlog(df: DataFrame) -> DataFrame:
    """Per topic, the sum over partitions of newest minus oldest offset plus one."""
    per = df.groupBy("topic", "partition").agg((F.max("offset") + 1 - F.min("offset")).alias("n"))
    return per.groupBy("topic").agg(F.sum(F.greatest(F.lit(0), F.col("n"))).alias("backlog"))


def observed(df: DataFrame, name: str, **flags: Column) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, with its row count and the count of each flag collected while it runs."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(k) for k, c in flags.items()]), obs
