import hashlib
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opslens.functions import ids, prompts, text


def one(spark, col, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


A = "2025-11-03 08:15:00 ERROR [pool-4] o.x.Relay : Lost peer 172.16.4.9:7000 after 250ms"
B = "2025-11-03 09:40:10 ERROR [io-11] o.x.Relay : Lost peer 192.0.2.77:7001 after 9s"


def test_equal_fingerprints_for_equal_templates(spark):
    df = spark.createDataFrame([(A,), (B,)], "m string")
    t = text.normalize(text.log_body(F.col("m")))
    rows = df.select(t.alias("t"), text.fingerprint(F.lit("svc"), F.lit("ERROR"), t).alias("f")).collect()
    assert rows[0] == rows[1]
    assert rows[0]["t"] == "Lost peer <IP>:<NUM> after <DURATION>"
    assert rows[0]["f"] == hashlib.sha256(b"svc:ERROR:" + rows[0]["t"].encode()).hexdigest()


@pytest.mark.parametrize("raw,want", [
    ("user 7e36b7b0-1111-4222-8333-abcdefabcdef logged in", "user <UUID> logged in"),
    ("at 0xDEADbeef took 5s and 10m", "at <HEX> took <DURATION> and <DURATION>"),
    ("5sec 12 7d.", "<NUM>sec <NUM> <DURATION>."),
    (None, ""),
])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize(F.lit(raw).cast("string"))) == want


def test_ingest_and_stream_fingerprints_differ_and_nulls_print(spark):
    f = one(spark, text.fingerprint(F.lit("s"), F.lit(None).cast("string"), F.lit("t")))
    assert f == hashlib.sha256(b"s:null:t").hexdigest()
    assert one(spark, text.ingest_fingerprint(F.lit("s"), F.lit("l"), F.lit("t"))) == hashlib.sha256(b"slt").hexdigest()


def test_parse_shapes(spark):
    p = one(spark, text.parse_log(F.lit(A)))
    assert (p["timestamp"], p["level"], p["thread"], p["logger"]) == ("2025-11-03 08:15:00", "ERROR", "[pool-4]", "o.x.Relay") and p["matched"]
    miss = one(spark, text.parse_log(F.lit("plain text")))
    assert miss["message"] == "plain text" and not miss["matched"] and miss["level"] is None
    e = one(spark, text.parse_log(F.lit("java.lang.NullPointerException: boom: x"), "exception"))
    assert (e["exception_class"], e["exception_msg"]) == ("java.lang.NullPointerException", "boom: x")
    s = one(spark, text.parse_log(F.lit("<34>Oct 11 22:14:15 mymachine su: failed"), "syslog"))
    assert (s["syslog_pri"], s["month"], s["host"], s["tag"], s["message"]) == ("34", "Oct", "mymachine", "su", "failed")


def test_log_body_agrees_with_parse_on_multi_line(spark):
    for raw in (A, "junk " + B + "\nat x.y(Z.java:1)", "", "no match 12:00", "2025-11-03T08:15:00.123Z WARN t l : "):
        body = one(spark, text.log_body(F.lit(raw)))
        assert body == one(spark, text.parse_log(F.lit(raw))["message"]), raw


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab0123456789.-xfmsh <>", max_size=40), min_size=1, max_size=30))
def test_normalize_is_stable_on_its_own_output(spark, msgs):
    df = spark.createDataFrame([(m,) for m in msgs], "m string").select(text.normalize(F.col("m")).alias("a"))
    assert df.filter(text.normalize(F.col("a")) != F.col("a")).count() == 0


def test_incident_id_is_name_based_uuid(spark):
    fp, kind = "ab" * 32, "SPIKE"
    raw = hashlib.sha256(f"{fp}:{kind}".encode()).digest()
    d = bytearray(hashlib.md5(raw).digest())
    d[6], d[8] = d[6] & 0x0F | 0x30, d[8] & 0x3F | 0x80
    assert one(spark, ids.incident_id(F.lit(fp), F.lit(kind))) == str(uuid.UUID(bytes=bytes(d)))


def test_trace_and_tenant(spark):
    n = F.lit(None).cast("string")
    assert one(spark, ids.resolve_trace(F.lit("a"), F.lit("b"))) == "a"
    assert one(spark, ids.resolve_trace(F.lit(""), F.lit("b"))) == "b"
    assert len(one(spark, ids.resolve_trace(n, n))) == 36
    assert one(spark, ids.resolve_tenant(F.create_map(F.lit("tenantId"), n))) == "default"


def test_json_anchor_preview(spark):
    assert one(spark, text.extract_json(F.lit('say {"a":{"b":1}} end'))) == '{"a":{"b":1}}'
    assert one(spark, text.extract_json(F.lit("} {"))) == "} {"
    trace = "java.lang.X\n\tat org.acme.book.Ledger.closeBook(Ledger.java:88)"
    assert one(spark, text.anchor_context(F.lit(trace), F.lit("code"))).startswith("--- CRITICAL STACK CONTEXT MATCHED FOR CLASS org.acme.book.Ledger ---\n")
    assert one(spark, text.preview(F.lit("x" * 5000))) == "x" * 4096 + "…"


def py_grams(s):
    import regex

    out = set()
    for w in regex.findall(r"[\p{L}\p{N}]+", s.lower()):
        p = f"  {w} "
        out |= {p[i : i + 3] for i in range(len(p) - 2)}
    return out


@pytest.mark.parametrize("s", ["word", "Two words", "a", "", "---", "Éa b-c 12", "x " * 50])
def test_trigrams(spark, s):
    assert set(one(spark, text.trigrams(F.lit(s)))) == py_grams(s)


def test_render_and_stub(spark):
    assert one(spark, prompts.render("{{a}}-{{b}}", a=F.lit("x"), b=F.lit(None).cast("string"))) == "x-"
    assert "PaymentService.java" in one(spark, prompts.stub_answer(F.lit("NullPointerException TimeoutException")))
    assert "DatabasePool.java" in one(spark, prompts.stub_answer(F.lit("a TimeoutException")))
