"""The anomaly detector: per event, cold rules or warm statistics, at most one report.

Plan: the slot table gives, per (service, fingerprint, slot) and per (service, slot), the count already
reached in the window and the baseline. Those rows are put *in front of* the events of their slot and a
running sum carries them forward. The events are therefore shuffled once, on (service, slot, cut), and
joined with nothing; a service that holds a third of all rows is cut into slots of a few seconds, and a slot
that is crowded all the same is cut again (see ``running``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions.ids import severity
from opslens.functions.text import WINDOW_SECONDS
from opslens.operators.running import MAX_SLOT_ROWS, find_cuts, with_cut
from opslens.operators.windows import (
    BASELINE_WINDOWS,
    COLD_SECONDS,
    FP_KEYS,
    IDLE_RESET_SECONDS,
    SLOT_SECONDS,
    SVC_KEYS,
    fingerprint_slots,
    int_div,
    is_cold,
    mark_slots,
    mean_of,
    service_slots,
    session_start,
    slot_stats,
    slots_per_window,
    std_of,
    with_event_time,
)
from opslens.session import cut_lineage


@dataclass(frozen=True)
class Thresholds:
    """The detector's limits."""

    zscore: float = 3.0
    new_count: float = 5.0
    rate_relative: float = 1.5
    rate_z: float = 2.5
    min_windows: int = 30
    cold_spike: float = 50.0
    cold_new: float = 5.0
    cold_rate_errors: float = 40.0


# The name of the cold rules, and the keys of the evidence map in ``evidence``.
COLD_STRATEGY = "cold_start_24h_static"


def slot_tables(df: DataFrame, slot_s: int, history: DataFrame | None,
                max_slot_rows: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events with slot and cut, fingerprint slots, service slots); history rows are marked not fresh.

    The service slots are needed anyway; written down once, they also tell which slots are crowded.
    """
    marked = mark_slots(with_event_time(df), slot_s)
    plain = service_slots(marked.withColumn("_cut", F.lit(0)))
    cuts = None
    if max_slot_rows is not None:
        plain = cut_lineage(plain)
        cuts = find_cuts(marked, SVC_KEYS, plain.withColumnRenamed("slot", "_slot"), "ts_us", "event_id", max_slot_rows)
    marked = with_cut(marked, SVC_KEYS, cuts, "ts_us", "event_id")
    svc = plain if cuts is None else service_slots(marked)
    fp, svc = (x.withColumn("fresh", F.lit(True)) for x in (fingerprint_slots(marked), svc.drop("n")))
    if history is not None:
        old = history.withColumns({"fresh": F.lit(False), "cut": F.lit(0)})
        fp = fp.unionByName(old)
        svc = svc.unionByName(old.groupBy("service", "slot", "cut", "fresh").agg(F.sum("err").alias("err")))
    return marked, fp, svc


def event_context(
    df: DataFrame,
    window_s: int = WINDOW_SECONDS,
    n: int = BASELINE_WINDOWS,
    slot_s: int = SLOT_SECONDS,
    history: DataFrame | None = None,
    idle_reset_s: int = IDLE_RESET_SECONDS,
    max_slot_rows: int | None = MAX_SLOT_ROWS,
) -> DataFrame:
    """Events with running counts, both baselines (as sums) and the first-seen mark.

    ``history`` is an earlier slot table (see ``slot_counts``): the state of an incremental run. Its rows
    count as arrived before this batch. ``max_slot_rows=None`` skips the search for crowded slots.
    """
    per = slots_per_window(window_s, slot_s)
    marked, slots, svc_slots = slot_tables(df, slot_s, history, max_slot_rows)
    fp = session_start(slot_stats(slots, FP_KEYS, "cnt", per, n), FP_KEYS, idle_reset_s).filter("fresh")
    svc = slot_stats(svc_slots, SVC_KEYS, "err", per, n).filter("fresh")

    # heads carry their numbers in one struct, which costs an event row a single null
    fp_stat = F.struct(F.col("base_s").cast("bigint").alias("s"), F.col("base_q").alias("q"), F.col("first_seen_us").alias("seen"))
    svc_stat = F.struct(F.col("base_s").cast("bigint").alias("s"), F.col("base_q").alias("q"))
    no_fp = F.lit(None).cast("struct<s:bigint,q:decimal(28,0),seen:bigint>").alias("fp_stat")
    no_svc = F.lit(None).cast("struct<s:bigint,q:decimal(28,0)>").alias("svc_stat")
    no_event = [F.lit(None).cast("bigint").alias("ts_us"), F.lit(None).cast(df.schema["event_id"].dataType).alias("event_id")]
    one, zero, before = F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), F.col("before").cast("bigint")

    def layer(src: DataFrame, rank: int, fp_col: Column, at: list, d_fp: Column, d_err: Column, stats: list[Column]) -> DataFrame:
        return src.select("slot", "service", "cut", fp_col.alias("fingerprint"), F.lit(rank).alias("rank"), *at,
                          d_fp.alias("d_fp"), d_err.alias("d_err"), *stats)

    svc_heads = layer(svc, 0, F.lit(None).cast("string"), no_event, zero, before, [no_fp, svc_stat.alias("svc_stat")])
    fp_heads = layer(fp, 1, F.col("fingerprint"), no_event, before, zero, [fp_stat.alias("fp_stat"), no_svc])
    events = layer(marked.withColumnsRenamed({"_slot": "slot", "_cut": "cut"}), 2, F.col("fingerprint"), ["ts_us", "event_id"], one,
                   F.col("err"), [no_fp, no_svc])

    # The service frame comes first: its partitioning also satisfies the finer fingerprint frame. The slot
    # leads the keys because a number sorts faster than names.
    order = ("rank", "ts_us", "event_id")
    by_svc = W.partitionBy("slot", "service", "cut").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    by_fp = W.partitionBy("slot", "service", "cut", "fingerprint").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = svc_heads.unionByName(fp_heads).unionByName(events)
    out = out.select("*", F.sum("d_err").over(by_svc).alias("svc_errors"), F.first("svc_stat", ignorenulls=True).over(by_svc).alias("sv"))
    out = out.select("*", F.sum("d_fp").over(by_fp).alias("fp_count"), F.first("fp_stat", ignorenulls=True).over(by_fp).alias("fb"))
    c = F.col
    return out.filter(c("rank") == 2).select(
        "event_id", "service", "fingerprint", "ts_us", int_div(c("slot"), per).alias("window_id"),
        c("d_err").alias("is_error"), "fp_count", "svc_errors", F.lit(n).cast("bigint").alias("base_n"),
        mean_of(c("fb.s"), n).alias("fp_mean"), std_of(c("fb.s"), c("fb.q"), n).alias("fp_std"),
        mean_of(c("sv.s"), n).alias("svc_mean"), std_of(c("sv.s"), c("sv.q"), n).alias("svc_std"),
        c("fb.seen").alias("first_seen_us"),
    )


def classify(
    cold: Column, fp_count: Column, fp_n: Column, fp_mean: Column, fp_std: Column,
    errors: Column, svc_n: Column, svc_mean: Column, svc_std: Column, t: Thresholds = Thresholds(),
) -> Column:
    """Struct (anomaly_type, score, signal) of the first rule that fires; all null when none does.

    An empty baseline has mean NaN, which equals nothing, so only the count rules can fire on it.
    """
    def report(kind: str, score: Column, signal: str) -> Column:
        return F.struct(
            F.lit(kind).alias("anomaly_type"), score.cast("double").alias("score"), F.lit(signal).alias("signal")
        )

    zero = F.lit(0.0)
    fp_z = (fp_count - fp_mean) / F.nullif(fp_std, zero)
    svc_z = (errors - svc_mean) / F.nullif(svc_std, zero)
    never_seen = (fp_n > 0) & (fp_mean == 0.0)
    one = F.lit(1.0)
    cold_rules = (
        F.when(fp_count >= t.cold_spike, report("SPIKE", fp_count, COLD_STRATEGY))
        .when(never_seen & (fp_count > t.cold_new), report("NEW_ERROR", one, COLD_STRATEGY))
        .when(errors >= t.cold_rate_errors, report("RATE_JUMP", errors, COLD_STRATEGY))
    )
    warm_rules = (
        F.when((fp_n >= t.min_windows) & (fp_std > 0) & (fp_z > t.zscore), report("SPIKE", fp_z, "fingerprint_z"))
        .when((svc_n >= t.min_windows) & (svc_std > 0) & (svc_z > t.rate_z), report("RATE_JUMP", svc_z, "service_error_z"))
        .when(
            (svc_n > 0) & (svc_mean > 0) & (errors >= svc_mean * t.rate_relative),
            report("RATE_JUMP", errors / F.nullif(svc_mean, zero), "service_error_relative"),
        )
        .when(never_seen & (fp_count > t.new_count), report("NEW_ERROR", one, "new_fingerprint"))
    )
    return F.when(cold, cold_rules).otherwise(warm_rules)


def detect(
    df: DataFrame,
    thresholds: Thresholds = Thresholds(),
    window_s: int = WINDOW_SECONDS,
    n: int = BASELINE_WINDOWS,
    slot_s: int = SLOT_SECONDS,
    history: DataFrame | None = None,
    cold_s: int = COLD_SECONDS,
    idle_reset_s: int = IDLE_RESET_SECONDS,
    level: str | None = None,
    max_slot_rows: int | None = MAX_SLOT_ROWS,
) -> DataFrame:
    """One row per event, with its report if any. ``level`` restricts the input to one log level."""
    if level is not None:
        df = df.filter(F.upper("level") == level.upper())
    ctx = event_context(df, window_s, n, slot_s, history, idle_reset_s, max_slot_rows)
    ctx = ctx.withColumn("is_cold", is_cold(F.col("ts_us"), F.col("first_seen_us"), cold_s))
    c = F.col
    rule = classify(
        c("is_cold"), c("fp_count"), c("base_n"), c("fp_mean"), c("fp_std"),
        c("svc_errors"), c("base_n"), c("svc_mean"), c("svc_std"), thresholds,
    )
    return ctx.withColumn("_r", rule).select("*", "_r.anomaly_type", "_r.score", "_r.signal").drop("_r").withColumn(
        "severity", F.when(c("anomaly_type").isNotNull(), severity(c("score")))
    )


def evidence(t: Thresholds = Thresholds()) -> Column:
    """The numbers behind a report as an open map of text, over the columns of ``detect``."""
    c = F.col

    def num(x: Column) -> Column:
        return x.cast("decimal(28,6)").cast("string")

    base = [F.lit("service"), c("service"), F.lit("fingerprint"), c("fingerprint")]

    def m(*kv: Column) -> Column:
        return F.create_map(*base, *kv)

    cold = [F.lit("strategy"), F.lit(COLD_STRATEGY)]
    n = [F.lit("n"), num(c("base_n"))]
    fp_cur = [F.lit("current"), num(c("fp_count"))]
    err_cur = [F.lit("current"), num(c("svc_errors"))]
    svc = [*err_cur, F.lit("mean"), num(c("svc_mean"))]
    is_c, kind, sig = c("signal") == COLD_STRATEGY, c("anomaly_type"), c("signal")
    return (
        F.when(kind.isNull(), F.lit(None))
        .when(is_c & (kind == "SPIKE"), m(*cold, F.lit("threshold"), num(F.lit(t.cold_spike)), *fp_cur))
        .when(is_c & (kind == "NEW_ERROR"), m(*cold, *fp_cur))
        .when(
            is_c,
            m(*cold, F.lit("threshold"), num(F.lit(t.cold_rate_errors)), F.lit("current_service_errors"), num(c("svc_errors"))),
        )
        .when(
            sig == "fingerprint_z",
            m(F.lit("zScore"), num(c("score")), *fp_cur, F.lit("mean"), num(c("fp_mean")), F.lit("stdDev"), num(c("fp_std")), *n),
        )
        .when(
            sig == "service_error_z",
            m(F.lit("signal"), sig, F.lit("zScore"), num(c("score")), *svc, F.lit("stdDev"), num(c("svc_std")), *n),
        )
        .when(sig == "service_error_relative", m(F.lit("signal"), sig, F.lit("ratio"), num(c("score")), *svc, *n))
        .otherwise(m(*fp_cur, F.lit("mean"), num(c("fp_mean")), *n))
    )


def detect_windows(df: DataFrame, thresholds: Thresholds = Thresholds(), window_s: int = WINDOW_SECONDS,
                   n: int = BASELINE_WINDOWS, slot_s: int = SLOT_SECONDS, history: DataFrame | None = None) -> DataFrame:
    """Window-close detection: one verdict per (service, fingerprint, window) on its final counts.

    Fewer and later alerts than ``detect``; it reads the slot table only, so its cost does not grow with
    the events of a hot key.
    """
    _, slots, svc_slots = slot_tables(df, slot_s, history, None)
    return detect_slots(slots, svc_slots, thresholds, window_s, n, slot_s)


def detect_slots(slots: DataFrame, svc_slots: DataFrame, thresholds: Thresholds = Thresholds(),
                 window_s: int = WINDOW_SECONDS, n: int = BASELINE_WINDOWS, slot_s: int = SLOT_SECONDS) -> DataFrame:
    """``detect_windows`` over slot tables that carry ``fresh`` and ``cut``."""
    per = slots_per_window(window_s, slot_s)
    fp = session_start(slot_stats(slots, FP_KEYS, "cnt", per, n)).groupBy("service", "fingerprint", "window_id").agg(
        F.sum("cnt").alias("fp_count"), F.max("last_us").alias("ts_us"), F.max("base_s").alias("fp_s"),
        F.max("base_q").alias("fp_q"), F.max("first_seen_us").alias("first_seen_us"), F.max("fresh").alias("fresh"),
    )
    svc = slot_stats(svc_slots, SVC_KEYS, "err", per, n).groupBy("service", "window_id").agg(
        F.sum("err").alias("svc_errors"), F.max("base_s").alias("svc_s"), F.max("base_q").alias("svc_q")
    )
    c = F.col
    ctx = (
        fp.filter("fresh").join(svc, ["service", "window_id"])
        .withColumn("is_cold", is_cold(c("ts_us"), c("first_seen_us")))
        .select(
            "service", "fingerprint", "window_id", "ts_us", "fp_count", "svc_errors", "is_cold",
            F.lit(n).cast("bigint").alias("base_n"),
            mean_of(c("fp_s"), n).alias("fp_mean"), std_of(c("fp_s"), c("fp_q"), n).alias("fp_std"),
            mean_of(c("svc_s"), n).alias("svc_mean"), std_of(c("svc_s"), c("svc_q"), n).alias("svc_std"),
        )
    )
    rule = classify(
        c("is_cold"), c("fp_count"), c("base_n"), c("fp_mean"), c("fp_std"),
        c("svc_errors"), c("base_n"), c("svc_mean"), c("svc_std"), thresholds,
    )
    return ctx.withColumn("_r", rule).select("*", "_r.anomaly_type", "_r.score", "_r.signal").drop("_r")
