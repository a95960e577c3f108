import json
from datetime import datetime

from pyspark.sql import functions as F

from opslens.sources import envelopes as env
from opslens.sources import logs as src

T0 = datetime(2026, 5, 7, 7, 0, 0)
LOG = "event_id bigint, service string, level string, message string, trace_id string, occurred_at timestamp, metadata map<string,string>"


def entries(spark, n=100):
    return spark.createDataFrame(
        [(i, f"svc-{i % 3}", "INFO", f"message {i}", f"t{i}" if i % 2 else "", T0, {"tenantId": f"tenant-{i % 2}"}) for i in range(n)], LOG
    )


def test_ingest_stores_every_row_by_day(spark, tmp_path):
    p = str(tmp_path / "log_events")
    src.ingest_logs(entries(spark), p)
    src.ingest_logs(entries(spark, 5), p)
    got = spark.read.parquet(p)
    assert got.count() == 105
    assert got.filter("event_date = '2026-05-07'").count() == 105
    assert got.filter("length(fingerprint) = 64").count() == 105


def test_envelope_round_trip(spark, tmp_path):
    out = env.to_envelope(entries(spark), env.RAW_SCHEMA, "service")
    assert out.filter(env.valid_envelope(F.col("value"))).count() == 100
    assert out.select(F.size("headers").alias("n")).filter("n = 2").count() == 100
    records = out.select("key", "value", F.lit("logs.raw").alias("topic"), F.lit(1).alias("partition"), F.lit(0).cast("bigint").alias("offset"))
    good, dead = env.split_poison(env.decode(records))
    assert dead.count() == 0
    flat = env.flatten(good).orderBy("message").collect()
    assert len(flat) == 100 and flat[0]["occurred_at"] == T0 and flat[0]["tenant_id"].startswith("tenant-")


def test_headers_only_with_values(spark):
    r = spark.range(1).select(env.headers(F.lit(""), F.lit("t")).alias("h")).first()["h"]
    assert [(x["key"], bytes(x["value"])) for x in r] == [("tenantId", b"t")]


def test_poison_row_goes_to_dead_letters(spark):
    rows = [("poison-key", "{not-valid-json", "logs.raw", 2, 7), ("k", None, "logs.raw", 0, 1)]
    df = spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset bigint")
    good, dead = env.split_poison(env.decode(df))
    assert good.count() == 0
    d = {r["key"]: r for r in dead.collect()}
    h = {x["key"]: bytes(x["value"]).decode() for x in d["poison-key"]["headers"]}
    assert d["poison-key"]["value"] == "{not-valid-json" and d["poison-key"]["topic"] == "logs.raw.dlq" and d["poison-key"]["partition"] == 2
    assert h["x-error-class"] == "MalformedJson" and h["x-error-original-offset"] == "7" and len(h["x-error-message"]) <= 900


def test_contract_breaks(spark):
    base = {"schema": "s", "messageId": "m", "occurredAt": 1.5, "producedAt": "x", "traceId": "t", "tenantId": "d", "payload": None}
    cases = [(json.dumps(base), True)]
    for k in base:
        cases.append((json.dumps({x: v for x, v in base.items() if x != k}), False))
    for k in ("schema", "messageId", "traceId", "tenantId"):
        cases += [(json.dumps({**base, k: ""}), False), (json.dumps({**base, k: 3}), False), (json.dumps({**base, k: None}), False)]
    cases += [(json.dumps({**base, "occurredAt": None}), False), (json.dumps({**base, "occurredAt": True}), False), ("[1]", False), ("{", False)]
    df = spark.createDataFrame(cases, "v string, want boolean")
    assert df.filter(env.valid_envelope(F.col("v")) != F.col("want")).collect() == []


def test_validation_rules(spark):
    rows = [(0, "", "", None, "", None, None), (1, "s", "l", "m" * 262_145, "", T0, None), (2, "s", "l", "m", "", T0, None)]
    ok, bad = src.validate_entries(spark.createDataFrame(rows, LOG))
    assert [r["event_id"] for r in ok.collect()] == [2]
    errs = {r["event_id"]: r["errors"] for r in bad.collect()}
    assert errs[0] == ["service_empty", "level_empty", "message_empty", "occurred_at_missing"] and errs[1] == ["message_too_long"]
    big = spark.range(1001).select(F.lit(1).alias("batch"))
    assert src.batch_errors(big, "batch").first()["n_rows"] == 1001


def test_tenant_view_hides_other_tenants(spark):
    assert src.for_tenant(src.with_tenant(entries(spark)), "tenant-1").count() == 50


def test_replay_copies_a_range_and_keeps_key_and_value(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    df = spark.createDataFrame([(f"k{i}", f"v{i}", datetime(2026, 5, 1 + i)) for i in range(10)], "key string, value string, timestamp timestamp")
    df.write.parquet(a)
    env.replay(spark, a, b, "2026-05-03", "2026-05-06")
    assert sorted((r["key"], r["value"]) for r in spark.read.parquet(b).collect()) == [("k2", "v2"), ("k3", "v3"), ("k4", "v4")]


def test_golden_lines(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text('{"log":"x","expected_files":["A.java"],"expected_layer":"APPLICATION","error_type":"E","severity":"P1"}\n\n')
    assert src.load_golden(spark, str(p)).collect()[0]["expected_files"] == ["A.java"]
