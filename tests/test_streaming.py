import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens.operators import incidents as inc
from opslens.operators.detect import detect, detect_windows
from opslens.operators.windows import first_seen, session_start, slot_counts, window_counts
from opslens.sources import envelopes as env
from opslens.streaming import jobs

T0 = datetime(2026, 5, 11, 12, 0, 0)
COLS = "event_id bigint, service string, level string, fingerprint string, occurred_at timestamp, tenant_id string"
ONCE = {"availableNow": True}


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Four days of events in five files, each later than the one before."""
    rows = []
    for i in range(2400):
        t = T0 + timedelta(seconds=i * 144 + (i * i) % 97)
        rows.append((i, f"s{i % 2}", "ERROR" if i % 5 == 0 or i > 2300 else "INFO", f"f{i % 3}", t, f"tenant-{i % 2}"))
    rows += [(5000 + i, "s0", "ERROR", "burst", T0 + timedelta(days=3, seconds=i), "tenant-9") for i in range(100)]
    rows.sort(key=lambda r: r[4])
    src = tmp_path_factory.mktemp("feed")
    for k in range(5):
        part = rows[k * 500 : (k + 1) * 500]
        spark.createDataFrame(part, COLS).coalesce(1).write.mode("append").parquet(str(src))
    return str(src), spark.createDataFrame(rows, COLS)


def stream(spark, path):
    return spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def test_stream_counts_equal_batch(spark, feed, tmp_path):
    path, batch = feed
    q = (jobs.stream_counts(stream(spark, path)).writeStream.format("memory").queryName("counts").outputMode("complete")
         .option("checkpointLocation", str(tmp_path / "c")).trigger(**ONCE).start())
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("counts").collect()))
    assert got == sorted(map(tuple, window_counts(batch).select("service", "fingerprint", "window_id", "cnt").collect()))


def test_event_detection_equals_batch_and_survives_restart(spark, feed, tmp_path):
    path, batch = feed
    state, ck = str(tmp_path / "state"), str(tmp_path / "ck")
    seen = []
    for _ in range(2):
        q = jobs.start_detect(stream(spark, path), state, ck, trigger=ONCE, compact_every=2, on_tickets=lambda t, e: seen.append(e))
        q.awaitTermination(240)
        assert q.exception() is None
    cols = ["event_id", "fp_count", "svc_errors", "fp_mean", "fp_std", "svc_mean", "svc_std", "is_cold", "anomaly_type", "score"]
    want = detect(batch)
    got = spark.read.parquet(f"{state}/detections")
    assert seen == [0, 1, 2, 3, 4]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    opened = spark.read.parquet(f"{state}/incidents")
    assert {(r[0], r[1]) for r in opened.select("incident_id", "event_id").collect()} == {(r[0], r[1]) for r in inc.open_incidents(want).select("incident_id", "event_id").collect()}
    assert opened.filter("tenant_id IS NULL").count() == 0
    assert spark.read.parquet(f"{state}/audit").count() == batch.count()
    assert spark.read.parquet(f"{state}/tickets").count() == opened.count()


def test_window_detection_matches_batch_on_closed_windows(spark, feed, tmp_path):
    path, batch = feed
    state = str(tmp_path / "w")
    q = jobs.start_detect(stream(spark, path), state, str(tmp_path / "wk"), mode="window", watermark="10 minutes", trigger=ONCE)
    q.awaitTermination(240)
    got = spark.read.parquet(f"{state}/verdicts")
    cols = ["service", "fingerprint", "window_id", "fp_count", "svc_errors", "anomaly_type"]
    want = {str(r) for r in detect_windows(batch).select(*cols).collect()}
    rows = {str(r) for r in got.select(*cols).collect()}
    assert rows <= want and len(rows) > 0.9 * len(want)


def test_compaction_keeps_first_seen(spark, feed):
    _, batch = feed
    slots = slot_counts(batch)
    cut = int((T0 + timedelta(days=2) - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    small = jobs.compact_history(slots, cut)
    assert small.count() < slots.count()

    def marks(s):
        s = s.withColumns({"window_id": F.col("slot"), "fresh": F.lit(True), "cut": F.lit(0)})
        return {tuple(r) for r in session_start(s).filter(F.col("last_us") >= cut).select("service", "fingerprint", "slot", "first_seen_us").collect()}

    assert marks(small) == marks(slots)


SLOTS = "service string, fingerprint string, slot bigint, cnt bigint, err bigint, first_us bigint, last_us bigint"


def test_a_stamp_far_ahead_does_not_move_the_cutoff(spark):
    t = 1_700_000_000_000_000
    rows = [("s", f"f{i}", (t // 10_000_000) + i, 5, 0, t + i, t + i) for i in range(100)]
    slots = spark.createDataFrame(rows + [("s", "odd", 10**9, 1, 0, 10 * t, 10 * t)], SLOTS)
    keep = 48 * 3600 * 1_000_000
    kept = jobs.compact_history(slots, jobs._middle(slots) - keep)
    assert kept.agg(F.sum("cnt")).first()[0] == 501


def test_keys_silent_for_long_leave_the_state(spark):
    day, t = 86_400_000_000, 1_700_000_000_000_000
    rows = [("s", f"old{i}", i, 5, 0, t - 400 * day, t - 400 * day) for i in range(50)]
    rows += [("s", "quiet", 7, 5, 0, t - 3 * day, t - 3 * day), ("s", "now", 9, 5, 0, t, t)]
    kept = jobs.compact_history(spark.createDataFrame(rows, SLOTS), t - 2 * day).collect()
    assert sorted((r["fingerprint"], r["cnt"]) for r in kept) == [("now", 5), ("quiet", 0)]


def test_replayed_batch_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("k", "v", [])], "key string, value string, headers array<struct<key:string,value:binary>>")
    for _ in range(2):
        fmt, options, mode = jobs._replayable(("parquet", {"path": str(tmp_path / "out")}), 3)
        env.write_envelopes(rows, fmt, options, mode=mode)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert jobs._replayable(("kafka", {"topic": "t"}), 3) == ("kafka", {"topic": "t"}, "append")


def test_dedupe_within_lifetime(spark, tmp_path):
    src = str(tmp_path / "d")
    spark.createDataFrame([("a", T0), ("a", T0 + timedelta(days=1)), ("b", T0)], "content_hash string, occurred_at timestamp").coalesce(1).write.parquet(src)
    s = spark.readStream.schema("content_hash string, occurred_at timestamp").parquet(src)
    q = jobs.dedupe_stream(s, "content_hash").writeStream.format("memory").queryName("dd").option("checkpointLocation", str(tmp_path / "k")).trigger(**ONCE).start()
    q.awaitTermination(60)
    assert sorted(r[0] for r in spark.table("dd").collect()) == ["a", "b"] and jobs.late_rows(q) == 0


def test_preprocess_splits_to_two_sinks(spark, tmp_path):
    ok = json.dumps({"schema": "logs.raw.v1", "messageId": "m1", "occurredAt": "2026-05-07T07:00:00Z", "producedAt": "2026-05-07T07:00:01Z", "traceId": "trace-123",
                     "tenantId": "tenant-1", "payload": {"service": "service-a", "level": "INFO", "message": "user 7e36b7b0-1111-4222-8333-abcdefabcdef logged in"}})
    rows = [("service-a", ok, "logs.raw", 0, 0, T0), ("poison-key", "{not-valid-json", "logs.raw", 1, 0, T0)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, env.RECORD_SCHEMA).coalesce(1).write.parquet(src)
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    q = jobs.start_preprocess(env.read_envelopes(spark, "parquet", {"path": src}), ("parquet", {"path": good}), ("parquet", {"path": dead}), str(tmp_path / "ck"), ONCE)
    q.awaitTermination(60)
    out = spark.read.parquet(good).collect()
    assert len(out) == 1 and "<UUID>" in json.loads(out[0]["value"])["payload"]["template"]
    assert out[0]["key"] == json.loads(out[0]["value"])["payload"]["fingerprint"] and "trace-123" in out[0]["headers"]
    d = spark.read.parquet(dead).collect()
    assert [(r["key"], r["value"], r["topic"]) for r in d] == [("poison-key", "{not-valid-json", "logs.raw.dlq")] and "x-error-class" in d[0]["headers"]


def test_streaming_envelope_sink(spark, tmp_path):
    src, dst = str(tmp_path / "a"), str(tmp_path / "b")
    schema = "event_id bigint, service string, level string, message string, occurred_at timestamp"
    spark.createDataFrame([(1, "s", "INFO", "m", T0)], schema).write.parquet(src)
    out = env.to_envelope(spark.readStream.schema(schema).parquet(src), env.RAW_SCHEMA, "service")
    q = env.write_envelopes(out, "parquet", {"path": dst}, str(tmp_path / "ck"), ONCE)
    q.awaitTermination(60)
    back = env.read_envelopes(spark, "parquet", {"path": dst}, streaming=False)
    assert back.first()["env"]["payload"]["service"] == "s"
