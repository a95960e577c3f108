"""Window counts, running counts, rolling baselines and first-seen marks.

The common currency is the *slot table*: one row per (service, fingerprint, slot), a slot being a few
seconds of event time. It is built with map-side partial aggregation, so a hot fingerprint shrinks
before it is shuffled, and every later per-key window runs over slots (bounded by the time span), never
over events.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions.text import WINDOW_SECONDS, epoch_us, window_id

SLOT_SECONDS = 10
BASELINE_WINDOWS = 288
IDLE_RESET_SECONDS = 172_800
COLD_SECONDS = 86_400
FP_KEYS = ("fingerprint", "service")
SVC_KEYS = ("service",)


def is_error(level: Column) -> Column:
    return F.coalesce(F.upper(level) == "ERROR", F.lit(False)).cast("bigint")


def window_counts(df: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Events of every level per (service, fingerprint, window)."""
    return df.groupBy("service", "fingerprint", window_id(F.col("occurred_at"), seconds).alias("window_id")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def service_error_counts(df: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """ERROR events per (service, window); windows without errors stay, as zero rows."""
    return df.groupBy("service", window_id(F.col("occurred_at"), seconds).alias("window_id")).agg(
        F.sum(is_error(F.col("level"))).alias("cnt")
    )


def in_count_range(counts: DataFrame, window: int | Column, lo: float, hi: float) -> DataFrame:
    """Members of one window whose count lies in [lo, hi]."""
    w = window if isinstance(window, Column) else F.lit(window)
    return counts.filter((F.col("window_id") == w) & F.col("cnt").between(lo, hi))


def _frame_sum(c: Column, keys: Sequence[str], n: int) -> Column:
    """Sum over the ``n`` windows before the current one.

    Two running sums are subtracted instead of re-adding each frame: linear in the rows of a key. The
    values are whole numbers, so the difference is exact.
    """
    by = W.partitionBy(*keys).orderBy("window_id")
    upto = F.coalesce(F.sum(c).over(by.rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    older = F.coalesce(F.sum(c).over(by.rangeBetween(W.unboundedPreceding, -(n + 1))), F.lit(0))
    return upto - older


def int_div(c: Column, n: int) -> Column:
    """Floor division of whole numbers, exact also below zero."""
    return ((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("bigint")


def _big(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def mean_of(s: Column, n: int) -> Column:
    return s.cast("double") / F.lit(float(n))


def std_of(s: Column, q: Column, n: int) -> Column:
    """Sample deviation from the exact numerator ``n*Q - S*S``; zero for a single window."""
    if n < 2:
        return F.lit(0.0)
    num = F.lit(n).cast("decimal(10,0)") * q.cast("decimal(28,0)") - (_big(s) * _big(s)).cast("decimal(38,0)")
    return F.sqrt(num.cast("double") / F.lit(float(n * (n - 1))))


def baseline(counts: DataFrame, keys: Sequence[str] = FP_KEYS, n: int = BASELINE_WINDOWS) -> DataFrame:
    """Rolling baseline of a window count table: the ``n`` windows before each row.

    Windows without a row count as zero, so no dense grid is built and ``base_n`` is always ``n``.
    """
    out = counts.withColumn("base_s", _frame_sum(F.col("cnt"), keys, n)).withColumn(
        "base_q", _frame_sum(_big(F.col("cnt")) * F.col("cnt"), keys, n)
    )
    return out.select(
        *counts.columns,
        F.lit(n).cast("bigint").alias("base_n"),
        mean_of(F.col("base_s"), n).alias("base_mean"),
        std_of(F.col("base_s"), F.col("base_q"), n).alias("base_std"),
    )


def with_event_time(df: DataFrame) -> DataFrame:
    """A missing event time becomes the ingest time, else the moment of this call."""
    times = [F.col("occurred_at"), *([F.col("ingested_at")] if "ingested_at" in df.columns else [])]
    return df.withColumn("occurred_at", F.coalesce(*times, F.lit(datetime.now(timezone.utc))))


def mark_slots(df: DataFrame, slot_s: int = SLOT_SECONDS) -> DataFrame:
    """The narrow columns the detector works on, with the slot of each event."""
    us = epoch_us(F.col("occurred_at"))
    return df.select(
        "service", "fingerprint", us.alias("ts_us"), is_error(F.col("level")).alias("err"),
        int_div(us, slot_s * 1_000_000).alias("_slot"), *(["event_id"] if "event_id" in df.columns else []),
    )


def slot_counts(df: DataFrame, slot_s: int = SLOT_SECONDS) -> DataFrame:
    """The slot table: events, ERROR events and first/last time per (service, fingerprint, slot)."""
    return fingerprint_slots(mark_slots(df, slot_s).withColumn("_cut", F.lit(0))).drop("cut")


def fingerprint_slots(marked: DataFrame) -> DataFrame:
    return marked.groupBy("service", "fingerprint", F.col("_slot").alias("slot"), F.col("_cut").alias("cut")).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum("err").alias("err"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )


def service_slots(marked: DataFrame) -> DataFrame:
    """ERROR events per (service, slot): needs no template or fingerprint."""
    return marked.groupBy("service", F.col("_slot").alias("slot"), F.col("_cut").alias("cut")).agg(
        F.sum("err").alias("err"), F.count(F.lit(1)).alias("n")
    )


def slots_per_window(window_s: int, slot_s: int) -> int:
    if window_s % slot_s:
        raise ValueError(f"window of {window_s} s is not a whole number of {slot_s} s slots")
    return window_s // slot_s


def slot_stats(slots: DataFrame, keys: Sequence[str], value: str, per: int, n: int) -> DataFrame:
    """Per slot: what the same window held before it, and the baseline of the window.

    ``slots`` carries ``fresh`` (true for the batch at hand, false for history). History of the same
    window arrived earlier, so all of it counts as before. One exchange and one sort on
    (keys, window, slot) serve every frame below.
    """
    keys = list(keys)
    df = slots.withColumn("window_id", int_div(F.col("slot"), per)).repartition(*keys)
    whole = W.partitionBy(*keys, "window_id")
    ordered = whole.orderBy("slot", "cut", "fresh")
    v = F.col(value)
    fresh_v = F.when(F.col("fresh"), v).otherwise(F.lit(0))
    old_v = F.when(F.col("fresh"), F.lit(0)).otherwise(v)
    # ordered frames first: their sort also serves the whole-window and range frames after them
    df = df.withColumn("_head", F.row_number().over(ordered) == 1).withColumn(
        "_earlier", F.coalesce(F.sum(fresh_v).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    df = df.withColumn("_total", F.sum(v).over(whole)).withColumn("before", F.sum(old_v).over(whole) + F.col("_earlier"))
    # the window total enters the baseline once, on the first slot of the window
    head = F.when(F.col("_head"), F.col("_total")).otherwise(F.lit(0))
    return (
        df.withColumn("_h", head)
        .withColumn("base_s", _frame_sum(F.col("_h"), keys, n))
        .withColumn("base_q", _frame_sum(_big(F.col("_h")) * F.col("_h"), keys, n).cast("decimal(28,0)"))
        .drop("_total", "_earlier", "_head", "_h")
    )


def session_start(slots: DataFrame, keys: Sequence[str] = FP_KEYS, idle_reset_s: int = IDLE_RESET_SECONDS) -> DataFrame:
    """Adds ``first_seen_us``: start of the current stretch without ``idle_reset_s`` of silence.

    A gap that long is wider than a slot, so only gaps between slots can reset the mark.
    """
    by = W.partitionBy(*keys).orderBy("window_id", "slot", "cut", "fresh")
    prev_last = F.max("last_us").over(by.rowsBetween(W.unboundedPreceding, -1))
    starts = prev_last.isNull() | (F.col("first_us") - prev_last >= idle_reset_s * 1_000_000)
    mark = F.last(F.when(F.col("_starts"), F.col("first_us")), ignorenulls=True)
    return (
        slots.withColumn("_starts", starts)
        .withColumn("first_seen_us", mark.over(by.rowsBetween(W.unboundedPreceding, 0)))
        .drop("_starts")
    )


def first_seen(df: DataFrame, idle_reset_s: int = IDLE_RESET_SECONDS, slot_s: int = SLOT_SECONDS) -> DataFrame:
    """One row per stretch of a (service, fingerprint) that never falls silent for ``idle_reset_s``."""
    slots = (
        slot_counts(df, slot_s)
        .withColumns({"fresh": F.lit(True), "cut": F.lit(0), "window_id": F.col("slot")})
    )
    return (
        session_start(slots, FP_KEYS, idle_reset_s)
        .groupBy("service", "fingerprint", "first_seen_us")
        .agg(F.max("last_us").alias("last_seen_us"), F.sum("cnt").alias("cnt"))
    )


def is_cold(ts_us: Column, first_us: Column, period_s: int = COLD_SECONDS) -> Column:
    """Within ``period_s`` of the first sighting, on whole seconds; unknown counts as cold."""
    age = F.floor(ts_us / 1_000_000) - F.floor(first_us / 1_000_000)
    return F.coalesce(age < period_s, F.lit(True))


def running_counts(df: DataFrame, window_s: int = WINDOW_SECONDS, slot_s: int = SLOT_SECONDS) -> DataFrame:
    """Each event with the counts its window had reached, itself included."""
    from opslens.operators.detect import event_context

    return event_context(df, window_s=window_s, slot_s=slot_s).select(
        "event_id", "service", "fingerprint", "window_id", "fp_count", "svc_errors"
    )


def fingerprint_batches(df: DataFrame, sample: int = 10) -> DataFrame:
    """Identical fingerprints as one row: count, span, template, stack trace and earliest events.

    The sample keeps the ``sample`` first events of a group through a ranked cut that Spark also applies
    before the shuffle, so a hot group never gathers more than that in one place.
    """
    order = W.partitionBy("service", "fingerprint").orderBy("occurred_at", "event_id")
    stats = df.groupBy("service", "fingerprint").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
    )
    has_trace = "stack_trace" in df.columns
    trace = F.col("stack_trace") if has_trace else F.lit(None).cast("string")
    head = (
        df.select("service", "fingerprint", "occurred_at", "event_id", "message", "template", trace.alias("stack_trace"))
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= sample)
        .groupBy("service", "fingerprint")
        .agg(
            F.array_sort(F.collect_list(F.struct("_rn", "event_id", "message"))).alias("_s"),
            F.min_by("template", "_rn").alias("normalized_message"),
            F.min_by("stack_trace", F.when(F.col("stack_trace").isNotNull(), F.col("_rn"))).alias("base_stack_trace"),
        )
        .select(
            "service", "fingerprint", "normalized_message", "base_stack_trace",
            F.transform("_s", lambda e: F.struct(e["event_id"].alias("event_id"), e["message"].alias("message"))).alias(
                "sample"
            ),
        )
    )
    return stats.join(head, ["service", "fingerprint"])
