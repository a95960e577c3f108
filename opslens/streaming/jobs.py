"""Structured Streaming entry points.

Event time is the entry's own time. State that outlives a micro-batch is kept in tables, one folder per
epoch, written with overwrite: a replayed batch rewrites its own folder and reads only earlier ones, so a
restart from the checkpoint repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from opslens.functions.text import WINDOW_SECONDS, epoch_us
from opslens.operators import incidents as inc
from opslens.operators.detect import Thresholds, detect, detect_slots
from opslens.operators.windows import (
    BASELINE_WINDOWS,
    IDLE_RESET_SECONDS,
    SLOT_SECONDS,
    int_div,
    is_error,
    session_start,
    slot_counts,
    with_event_time,
)
from opslens.sources.envelopes import PREPROCESSED_SCHEMA, flatten, split_poison, to_envelope, write_envelopes
from opslens.sources.logs import preprocess

COUNT_WATERMARK = "26 hours"


def stream_counts(sdf: DataFrame, watermark: str = COUNT_WATERMARK, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Tumbling counts per (service, fingerprint); in append mode a row appears when its window closes."""
    w = F.window("occurred_at", f"{seconds} seconds")
    out = sdf.withWatermark("occurred_at", watermark).groupBy(w, "service", "fingerprint").agg(F.count(F.lit(1)).alias("cnt"))
    return out.select("service", "fingerprint", int_div(F.unix_seconds("window.start"), seconds).alias("window_id"), "cnt")


def stream_window_slots(sdf: DataFrame, watermark: str = COUNT_WATERMARK, seconds: int = WINDOW_SECONDS,
                        slot_s: int = SLOT_SECONDS) -> DataFrame:
    """Closed windows as slot rows (the slot is the window's first), for window-close detection."""
    w = F.window("occurred_at", f"{seconds} seconds")
    us = epoch_us(F.col("occurred_at"))
    out = sdf.withWatermark("occurred_at", watermark).groupBy(w, "service", "fingerprint").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(is_error(F.col("level"))).alias("err"), F.min(us).alias("first_us"), F.max(us).alias("last_us")
    )
    return out.select("service", "fingerprint", int_div(F.unix_seconds("window.start"), slot_s).alias("slot"), "cnt", "err", "first_us", "last_us")


def dedupe_stream(sdf: DataFrame, key: str, ttl: str = "7 days", ts: str = "occurred_at") -> DataFrame:
    """First row per key within ``ttl`` of event time; the lifetime starts at the first row and is not renewed."""
    return sdf.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


class Lifetimes(StatefulProcessor):
    """Hit or miss of every request of a bucket of keys under a fixed-anchor lifetime.

    The state of a bucket is the second of the last write of each of its keys, read and written as one list: Python meets
    the state store a few times a bucket, not a key. Writes whose lifetime the watermark has passed are left out when the
    list is written anew, and a timer drops it once the last of them has ended. So what is kept was written within two
    lifetimes and the watermark's delay, however long the stream runs.
    """

    def __init__(self, ttl_s: int, row_id: str, columns: list[str]):
        self.ttl_s, self.row_id, self.columns = ttl_s, row_id, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchors = handle.getListState("anchors", "cache_key string, sec long")

    def ends_ms(self, sec: int) -> int:
        return (sec + self.ttl_s) * 1000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, same = [], {}
        for r in rows:
            k, us, i = r["cache_key__"], r["us__"], r[self.row_id]
            held.append((us is None, us, i is None, i, same.setdefault(k, k), r["sec__"], r["writes__"], *(r[c] for c in self.columns)))
        held.sort(key=lambda h: h[:4])
        anchors, hits, wrote = dict(self.anchors.get()), [], False
        before = max(anchors.values(), default=None)
        for k, sec, writes in (h[4:7] for h in held):
            if sec is None:  # without a time no entry is met or written; cache_hits counts it so
                hits.append(writes)
                continue
            hits.append(k in anchors and sec - anchors[k] < self.ttl_s)
            if writes and not hits[-1]:
                anchors[k], wrote = sec, True
        if wrote:
            # only now: rows of this batch may be older than its watermark
            mark = timerValues.getCurrentWatermarkInMs()
            live = [(k, sec) for k, sec in anchors.items() if self.ends_ms(sec) > mark]
            if before is not None:
                self.handle.deleteTimer(self.ends_ms(before))
            if live:
                self.anchors.put(live)
                self.handle.registerTimer(self.ends_ms(max(sec for _, sec in live)))
            else:
                self.anchors.clear()
        out = Row(*self.columns, "is_hit")
        for h, hit in zip(held, hits):
            yield out(*h[7:], hit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.anchors.clear()
        return iter([])


def cache_hit_stream(sdf: DataFrame, key: str, ttl_s: int, ts: str = "occurred_at", row_id: str = "event_id",
                     writes: Column | None = None, watermark: str = COUNT_WATERMARK, buckets: int = 1024) -> DataFrame:
    """A stream of requests plus ``is_hit``, as ``cache_hits`` has it for a table whose rows come in time order.

    ``writes`` tells which requests store their answer on a miss (default all). Rows of null keys are left out. Within a
    batch rows count in time order; a row that comes in a later batch than a write is a hit of it while the entry lives.
    Keys are dealt to ``buckets`` by their hash, and a batch reads and writes the state of the buckets that it touches; a
    task holds a bucket's rows of one batch. The number is part of the state, as that of shuffle partitions is, and stays
    as it is for a checkpoint. Start it with ``keyed_state`` around ``start``.
    """
    # tasks get plain rows: data frames would hold times up to the year 2262 only, and integers beside nulls as doubles
    src = sdf.filter(F.col(key).isNotNull()).withWatermark(ts, watermark).withColumn("us__", epoch_us(F.col(ts)))
    src = src.withColumn("sec__", int_div(F.col("us__"), 1_000_000)).withColumn("writes__", F.lit(True) if writes is None else F.coalesce(writes, F.lit(False)))
    # the state holds keys as text: any other type as JSON, times to the microsecond
    is_text = isinstance(sdf.select(key).schema[0].dataType, T.StringType)
    as_json = F.to_json(F.struct(F.col(key).alias("k")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXXXX"})
    src = src.withColumn("cache_key__", F.col(key) if is_text else as_json)
    src = src.withColumn("bucket__", F.pmod(F.xxhash64("cache_key__"), F.lit(buckets)))
    out = T.StructType([*sdf.schema.fields, T.StructField("is_hit", T.BooleanType())])
    return src.groupBy("bucket__").transformWithState(Lifetimes(ttl_s, row_id, sdf.columns), out, "append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the embedded key-value store, which state with timers needs."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def first_seen_stream(sdf: DataFrame, idle_s: int = IDLE_RESET_SECONDS, watermark: str = COUNT_WATERMARK) -> DataFrame:
    """Stretches of a (service, fingerprint) that never falls silent for ``idle_s``, each once the watermark has closed it.

    The columns of ``first_seen``; a row that follows the one before by exactly ``idle_s`` begins a new stretch. Rows of
    a task meet before the shuffle where ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is set.
    """
    at = F.col("occurred_at")
    gap = f"{idle_s * 1_000_000 - 1} microseconds"  # a session also takes in a row at its very end
    by = sdf.withWatermark("occurred_at", watermark).groupBy(F.session_window(at, gap), "service", "fingerprint")
    return by.agg(F.min(epoch_us(at)).alias("first_seen_us"), F.max(epoch_us(at)).alias("last_seen_us"), F.count(F.lit(1)).alias("cnt")).drop("session_window")


class ProgressLog(StreamingQueryListener):
    """Keeps what batches report: rows in, rows the watermark dropped, and observed counts.

    One small file a batch, in a folder named by query and batch, so that a repeated batch replaces its own report. It
    listens to all queries of the session until ``close``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.streams.addListener(self)

    def close(self) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [("input", "rows", int(p.numInputRows)), ("watermark", "dropped", sum(int(o.numRowsDroppedByWatermark) for o in p.stateOperators))]
        rows += [(name, k, int(n)) for name, got in p.observedMetrics.items() for k, n in got.asDict().items()]
        found = [(str(p.id), p.name, int(p.batchId), *r) for r in rows]
        self.spark.createDataFrame(found, "query string, query_name string, batch long, source string, name string, n long").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/{p.id}/{p.batchId}")

    def reports(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(self.path)


def start_late_split(sdf: DataFrame, state: str, checkpoint: str, delay_s: int, trigger: dict | None = None) -> StreamingQuery:
    """Rows on time and late rows, kept apart as rows: ``on_time``, ``late`` under ``state``, a folder for each epoch.

    A row is late if it lies more than ``delay_s`` behind the newest time of the batches before, which is where a
    watermark of that delay stands. The newest time is carried in ``mark``, so a replayed batch is split as before.
    """
    spark = sdf.sparkSession

    def split(batch: DataFrame, epoch: int) -> None:
        mark = spark.read.parquet(f"{state}/mark/epoch={epoch - 1}").first()[0] if epoch else None
        batch = batch.persist()
        try:
            us = epoch_us(F.col("occurred_at"))
            is_late = F.lit(False) if mark is None else F.coalesce(us < mark - delay_s * 1_000_000, F.lit(False))
            _put(batch.filter(~is_late), f"{state}/on_time", epoch)
            _put(batch.filter(is_late), f"{state}/late", epoch)
            newest = batch.agg(F.max(us).alias("us"))
            _put(newest.select(F.greatest("us", F.lit(mark).cast("bigint")).alias("us")), f"{state}/mark", epoch)
        finally:
            batch.unpersist()

    w = sdf.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped, over the progress reports still held."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def _replayable(sink: tuple[str, dict], epoch: int) -> tuple[str, dict, str]:
    """A file sink gets a folder per epoch that a replay overwrites; a broker can only be appended to."""
    fmt, options = sink
    if fmt == "kafka" or "path" not in options:
        return fmt, options, "append"
    return fmt, {**options, "path": f"{options['path']}/epoch={epoch}"}, "overwrite"


def start_preprocess(decoded: DataFrame, good_sink: tuple[str, dict], dlq_sink: tuple[str, dict], checkpoint: str,
                     trigger: dict | None = None) -> StreamingQuery:
    """Decoded envelopes in; parsed logs and dead letters out, to two sinks in one pass over each batch.

    A replayed batch rewrites its own folder in a file sink. A Kafka sink may hold its records twice then:
    readers pass them through ``dedupe_stream`` on the message id.
    """

    def both(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            _both(batch, epoch)
        finally:
            batch.unpersist()

    def _both(batch: DataFrame, epoch: int) -> None:
        good, dead = split_poison(batch)
        parsed = preprocess(flatten(good))
        out = to_envelope(
            parsed, PREPROCESSED_SCHEMA, "fingerprint", message_id=F.col("event_id"), trace=F.col("trace_id"), tenant=F.col("tenant_id"),
            payload=F.struct("service", "level", "message", "template", "fingerprint"),
        )
        for rows, sink in ((out, good_sink), (dead.select("key", "value", "topic", "partition", "headers"), dlq_sink)):
            fmt, options, mode = _replayable(sink, epoch)
            write_envelopes(rows, fmt, options, mode=mode)

    # counted while the batch runs; a ProgressLog keeps the counts
    seen = decoded.observe("preprocess", F.count(F.lit(1)).alias("records"), F.count("decode_error").alias("undecoded"))
    w = seen.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def _put(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def _epochs(spark: SparkSession, path: str, first: int, last: int) -> DataFrame | None:
    """Rows of the epochs first..last; None for an empty range. A missing folder is an error, not an empty one."""
    folders = [f"{path}/epoch={e}" for e in range(first, last + 1)]
    return spark.read.parquet(*folders) if folders else None


def _state(spark: SparkSession, state: str, name: str, epoch: int, every: int) -> DataFrame | None:
    """What ``name`` held before ``epoch``: the last folded copy and the epochs after it.

    Which copy that is follows from the epoch number, so at most ``every`` folders are opened however long
    the stream has run, and a replayed batch reads what it read the first time.
    """
    base = epoch // every * every - 1
    parts = [_epochs(spark, f"{state}/{name}_base", base, base) if base >= 0 else None, _epochs(spark, f"{state}/{name}", base + 1, epoch - 1)]
    parts = [p for p in parts if p is not None]
    return parts[0].unionByName(parts[1], allowMissingColumns=True) if len(parts) == 2 else (parts[0] if parts else None)


def compact_history(slots: DataFrame, cutoff_us: int) -> DataFrame:
    """Slots older than the cutoff folded into one empty slot per key that keeps its first-seen mark.

    A key that had fallen silent a whole idle-reset span before the cutoff starts anew when it returns, so
    nothing is kept of it.
    """
    recent = slots.filter(F.col("last_us") >= cutoff_us)
    old = slots.filter(F.col("last_us") < cutoff_us).withColumns({"window_id": F.col("slot"), "fresh": F.lit(True), "cut": F.lit(0)})
    marks = session_start(old).groupBy("service", "fingerprint").agg(
        F.max("first_seen_us").alias("first_us"), F.max("last_us").alias("last_us"), F.max("slot").alias("slot")
    ).filter(F.col("last_us") >= cutoff_us - IDLE_RESET_SECONDS * 1_000_000)
    zero = F.lit(0).cast("bigint")
    folded = marks.select("service", "fingerprint", "slot", zero.alias("cnt"), zero.alias("err"), "first_us", "last_us")
    return recent.select("service", "fingerprint", "slot", "cnt", "err", "first_us", "last_us").unionByName(folded)


def _middle(slots: DataFrame) -> int | None:
    """The time that half of a batch's slots have reached: single stamps far ahead or behind do not move it."""
    return slots.agg(F.percentile_approx("last_us", 0.5)).first()[0]


def _of_services(past: DataFrame | None, batch: DataFrame) -> DataFrame | None:
    """History of the services in the batch only: a service's error counts need all its fingerprints."""
    return None if past is None else past.join(batch.select("service").distinct(), "service", "left_semi")


def start_detect(
    sdf: DataFrame,
    state: str,
    checkpoint: str,
    mode: str = "event",
    thresholds: Thresholds = Thresholds(),
    window_s: int = WINDOW_SECONDS,
    n: int = BASELINE_WINDOWS,
    slot_s: int = SLOT_SECONDS,
    watermark: str = COUNT_WATERMARK,
    compact_every: int = 50,
    max_ahead_s: int | None = None,
    trigger: dict | None = None,
    on_tickets: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Detection over a stream of preprocessed logs.

    ``event``: every event is judged against the counts of all earlier batches and of its own batch before
    it, as in ``detect``; writes detections, incidents, tickets and audit rows. ``window``: windows are
    judged once, when the watermark closes them. Carried between batches is the slot table only; every
    ``compact_every`` batches it is folded to the length of the baseline, counted back from the middle of
    the newest batch. With ``max_ahead_s``, events stamped further than that ahead of the clock are put aside
    in ``quarantine``.
    """
    spark = sdf.sparkSession
    keep_us = max(n * window_s, IDLE_RESET_SECONDS) * 1_000_000

    def carry(fresh: DataFrame, epoch: int) -> None:
        _put(fresh, f"{state}/slots", epoch)
        if epoch % compact_every == compact_every - 1:
            rows = _state(spark, state, "slots", epoch, compact_every)
            now = _epochs(spark, f"{state}/slots", epoch, epoch)
            rows = now if rows is None else rows.unionByName(now)
            reached = _middle(now)
            # an empty batch says nothing about the time: everything is kept until the next fold
            folded = rows if reached is None else compact_history(rows, reached - keep_us)
            _put(folded, f"{state}/slots_base", epoch)
            if mode == "event":
                ids_ = [x.select("incident_id") for x in (_state(spark, state, "incidents", epoch, compact_every),
                                                          _epochs(spark, f"{state}/incidents", epoch, epoch)) if x is not None]
                _put(ids_[0] if len(ids_) == 1 else ids_[0].unionByName(ids_[1]), f"{state}/incidents_base", epoch)

    def by_event(batch: DataFrame, epoch: int) -> None:
        batch = with_event_time(batch)
        if max_ahead_s is not None:
            ahead = F.col("occurred_at") > F.current_timestamp() + F.make_dt_interval(secs=F.lit(max_ahead_s))
            _put(batch.filter(ahead), f"{state}/quarantine", epoch)
            batch = batch.filter(~F.coalesce(ahead, F.lit(False)))
        batch = batch.persist()
        try:
            past = _of_services(_state(spark, state, "slots", epoch, compact_every), batch)
            found = detect(batch, thresholds, window_s, n, slot_s, past)
            _put(found, f"{state}/detections", epoch)
            found = _epochs(spark, f"{state}/detections", epoch, epoch)
            known = _state(spark, state, "incidents", epoch, compact_every)
            new = inc.open_incidents(found, known, batch if "tenant_id" in batch.columns else None, thresholds)
            _put(new, f"{state}/incidents", epoch)
            new = _epochs(spark, f"{state}/incidents", epoch, epoch)
            _put(inc.stub_tickets(new), f"{state}/tickets", epoch)
            _put(inc.audit_rows(found, new), f"{state}/audit", epoch)
            if on_tickets is not None:
                on_tickets(_epochs(spark, f"{state}/tickets", epoch, epoch), epoch)
            carry(slot_counts(batch, slot_s), epoch)
        finally:
            batch.unpersist()

    def by_window(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            slots = batch.withColumns({"fresh": F.lit(True), "cut": F.lit(0)})
            past = _of_services(_state(spark, state, "slots", epoch, compact_every), batch)
            if past is not None:
                slots = slots.unionByName(past.withColumns({"fresh": F.lit(False), "cut": F.lit(0)}))
            svc = slots.groupBy("service", "slot", "cut", "fresh").agg(F.sum("err").alias("err"))
            _put(detect_slots(slots, svc, thresholds, window_s, n, slot_s), f"{state}/verdicts", epoch)
            carry(batch, epoch)
        finally:
            batch.unpersist()

    if mode == "event":
        src, fn = sdf, by_event
    elif mode == "window":
        src, fn = stream_window_slots(sdf, watermark, window_s, slot_s), by_window
    else:
        raise ValueError(f"mode is 'event' or 'window', not {mode!r}")
    w = src.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(**trigger) if trigger else w).start()
