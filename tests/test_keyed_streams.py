import random
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from opslens.operators.ttl import cache_hits
from opslens.operators.windows import first_seen
from opslens.streaming import jobs


def test_cache_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    t0 = datetime(2026, 5, 1)
    rows = sorted((t0 + timedelta(seconds=rnd.randrange(400_000)), i, "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(30)}", rnd.random() < 0.7) for i in range(2500))
    cols = "event_id bigint, k string, ok boolean, occurred_at timestamp"
    rows = [(i, k, ok, t) for t, i, k, ok in rows]
    src = str(tmp_path / "src")
    for a in range(0, 2500, 500):
        spark.createDataFrame(rows[a:a + 500], cols).coalesce(1).write.mode("append").parquet(src)
    out = str(tmp_path / "out")
    for _ in range(2):
        s = jobs.cache_hit_stream(spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(src), "k", 3600, writes=F.col("ok"), watermark="1 hour")
        with jobs.keyed_state(spark):
            q = s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination(200)
        assert q.exception() is None
    got = {r["event_id"]: r["is_hit"] for r in spark.read.parquet(out).collect()}
    batch = spark.createDataFrame(rows, cols).withColumn("ts_us", F.unix_micros("occurred_at"))
    want = {r["event_id"]: r["is_hit"] for r in cache_hits(batch, "k", 3600, writes=F.col("ok")).collect()}
    assert got == want


def cache_stream(spark, tmp_path, batches, cols, key, ttl_s, watermark, **more):
    """Hits by row id, each of ``batches`` one file and one batch, and the state's rows after the last."""
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(src)
        s = jobs.cache_hit_stream(spark.readStream.schema(cols).parquet(src), key, ttl_s, watermark=watermark, **more)
        with jobs.keyed_state(spark):
            q = s.writeStream.format("parquet").option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination(200)
        assert q.exception() is None
    kept = sum(p["numRowsTotal"] for p in q.lastProgress["stateOperators"])
    return spark.read.parquet(out), kept


def test_cache_stream_keeps_state_by_bucket(spark, tmp_path):
    """Many keys make few entries of state, late in the calendar and beside nulls, and keys of one bucket stay apart."""
    rnd, cols = random.Random(5), "event_id bigint, k bigint, n bigint, occurred_at timestamp"
    t0, big = datetime(2400, 1, 1), 2**60 + 1
    rows = sorted((t0 + timedelta(seconds=rnd.randrange(20_000)), i, rnd.randrange(300)) for i in range(1200))
    rows = [(i, big + k, None if i % 2 else big + i, t) for t, i, k in rows]
    got, kept = cache_stream(spark, tmp_path, [rows[:600], rows[600:]], cols, "k", 3600, "10 hours", buckets=4)
    batch = spark.createDataFrame(rows, cols).withColumn("ts_us", F.unix_micros("occurred_at"))
    want = cache_hits(batch, "k", 3600).drop("ts_us")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)
    # an entry and a timer a bucket, where a state of its own for each key would be hundreds
    assert 0 < kept < 300


def test_cache_stream_drops_entries_that_have_ended(spark, tmp_path):
    t0, cols = datetime(2026, 5, 1), "event_id bigint, k string, occurred_at timestamp"
    batches = [[(i, f"k{i}", t0 + timedelta(seconds=i)) for i in range(50)], [(100, "k0", t0 + timedelta(hours=9))],
               [(101, "k0", t0 + timedelta(hours=9, seconds=1)), (102, "k1", t0 + timedelta(hours=9, seconds=2)), (103, "k1", t0)]]
    got, kept = cache_stream(spark, tmp_path, batches, cols, "k", 3600, "1 hour", buckets=1)
    hits = {r["event_id"]: r["is_hit"] for r in got.collect()}
    # a row behind the watermark is dropped, as before
    assert hits == {**dict.fromkeys(range(50), False), 100: False, 101: True, 102: False}
    assert kept < 10


SEEN = "event_id bigint, service string, level string, fingerprint string, occurred_at timestamp"


def feed(spark, path, rows, files=4):
    n = -(-len(rows) // files)
    for a in range(0, len(rows), n):
        spark.createDataFrame(rows[a:a + n], SEEN).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(path)


def test_closed_stretches_equal_batch(spark, tmp_path):
    rnd, t0 = random.Random(6), datetime(2026, 5, 1)
    t, rows = t0, []
    for i in range(300):
        t += timedelta(seconds=rnd.choice([1, 60, 3000, 3600, 9000]))
        rows.append((i, "s", "INFO", f"f{rnd.randrange(3)}", t))
    out = str(tmp_path / "out")
    q = jobs.first_seen_stream(feed(spark, str(tmp_path / "in"), rows), 3600, "1 hour").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out)
    q.awaitTermination(200)
    cols = ["service", "fingerprint", "first_seen_us", "last_seen_us", "cnt"]
    got = {tuple(r) for r in spark.read.parquet(out).select(*cols).collect()}
    want = {tuple(r) for r in first_seen(spark.createDataFrame(rows, SEEN), 3600).select(*cols).collect()}
    assert got <= want and len(got) > 20
    # what is missing has not been closed: it ends within a lifetime and the delay of the newest row
    newest = max(r[4] for r in rows)
    edge = int((newest - timedelta(seconds=7200)).replace(tzinfo=timezone.utc).timestamp()) * 10**6
    assert all(x[3] >= edge for x in want - got)


def test_late_rows_are_kept_and_reports_are_stored(spark, tmp_path):
    t0 = datetime(2026, 5, 1)
    rows = [(i, "s", "INFO", "f", t0 + timedelta(seconds=i * 60)) for i in range(100)]
    rows += [(200 + i, "s", "INFO", "f", t0 + timedelta(seconds=i)) for i in range(5)] + [(300, "s", "INFO", "f", None)]
    src = feed(spark, str(tmp_path / "in"), rows, 4)
    log = jobs.ProgressLog(spark, str(tmp_path / "log"))
    try:
        for _ in range(2):
            q = jobs.start_late_split(src.observe("seen", F.count(F.lit(1)).alias("rows")), str(tmp_path / "st"), str(tmp_path / "ck"), 600, {"availableNow": True})
            q.awaitTermination(200)
            assert q.exception() is None
        for _ in range(100):
            if (tmp_path / "log").exists() and log.reports().filter("source = 'seen'").agg(F.sum("n")).first()[0] == len(rows):
                break
            time.sleep(0.2)
    finally:
        log.close()
    late = {r["event_id"] for r in spark.read.parquet(str(tmp_path / "st" / "late")).collect()}
    ontime = {r["event_id"] for r in spark.read.parquet(str(tmp_path / "st" / "on_time")).collect()}
    assert late == set(range(200, 205)) and ontime == {r[0] for r in rows} - late
    seen = log.reports().filter("source = 'seen'").groupBy("batch").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in seen) == len(rows) and len(seen) == 4
