import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opslens.operators import consensus as cons
from opslens.operators import metrics as met

FIND = "incident_id string, role string, error_type string, layer string, suspected_files array<string>, confidence double, rationale string"


def panel(spark, rows):
    return spark.createDataFrame([("i", *r) for r in rows], FIND)


def test_majority_keeps_the_dissent(spark):
    f = panel(spark, [
        ("Backend Engineer", "IllegalStateException", "DATA_ACCESS", [], 0.90, "The lock is held twice"),
        ("Full Stack Engineer", "IllegalStateException", "DATA_ACCESS", [], 0.85, "Same here"),
        ("DevOps Engineer", "TimeoutException", "INFRASTRUCTURE", [], 0.55, "Slow disks"),
    ])
    v = cons.consensus(f)
    r = v.first()
    assert (r["agreed_error_type"], r["primary_layer"], r["votes"]) == ("IllegalStateException", "DATA_ACCESS", 2)
    d = cons.dissent(f, v).collect()
    assert [(x["role"], x["minority_view"]) for x in d] == [("DevOps Engineer", "Slow disks")]


def test_review_gates(spark):
    low = panel(spark, [("Backend Engineer", "Unknown", "APPLICATION", [], 0.2, "unclear")])
    assert cons.consensus(low).first()["primary_layer"] == "REVIEW_NEEDED"
    split = panel(spark, [("a", "x", "A", [], 0.9, ""), ("b", "x", "B", [], 0.9, "")])
    assert cons.consensus(split).first()["agreed_error_type"] == "REVIEW_NEEDED"
    none = cons.consensus(low.filter("false"), incidents=spark.createDataFrame([("z",)], "incident_id string")).first()
    assert (none["n_findings"], none["max_confidence"], none["primary_layer"]) == (0, 0.0, "REVIEW_NEEDED")


def test_unreadable_answer_becomes_unknown(spark):
    df = spark.createDataFrame([("r1", "nothing"), ("r2", 'x {"role":"R","errorType":"E","layer":"L","suspectedFiles":null,"confidence":0.7,"rationale":"y"} z'), ("r3", "{oops")], "role string, answer string")
    out = {r["role"]: r for r in cons.parse_findings(df).collect()}
    assert out["r1"]["error_type"] == "UNKNOWN" and out["r1"]["confidence"] == 0.0 and out["r1"]["rationale"].startswith("Parsing Failure")
    assert out["R"]["layer"] == "L" and out["R"]["suspected_files"] == [] and out["r3"]["parse_failed"]


@pytest.mark.parametrize("service,hour,tie,want", [
    ("payment-service", "22:00:00", "", ("P0", 45)), ("PAYMENT-SERVICE", "12:00:00", "so P1", ("P1", 15)), ("payment-service", "12:00:00", "P2", ("P2", 15)),
    ("other", "08:00:00", "P1", ("P1", 18)), ("other", "08:00:01", "", ("P2", 6)), ("other", "18:00:00", "x", ("P2", 18)),
])
def test_priority(spark, service, hour, tie, want):
    df = spark.createDataFrame([(service, datetime.fromisoformat(f"2026-05-19 {hour}"), tie)], "service string, created_at timestamp, tiebreak string")
    r = cons.prioritize(df).first()
    assert (r["calculated_severity"], r["priority_score"]) == want and r["routing_queue"] == "ENGINEERING_QUEUE"


def scripted(prompts):
    out = []
    for p in prompts:
        npe = "NullPointerException" in p or "Ledger.java" in p
        files, layer, err = (["Ledger.java"], "APPLICATION", "NullPointerException") if npe else ([], "APPLICATION", "Unknown")
        if "charter" in p.lower():
            out.append(json.dumps({"role": "x", "errorType": err, "layer": layer, "suspectedFiles": files, "confidence": 0.9 if npe else 0.1, "rationale": "r"}))
        elif "root cause" in p:
            out.append(json.dumps({"cause": "NullPointerException in Ledger", "evidence": ["Ledger.java"], "confidence": 0.9, "alternatives": []}))
        elif "Write the ticket" in p:
            out.append(json.dumps({"title": "NPE", "description": "## Root Cause Analysis", "suspectedFiles": [], "fixSuggestion": "guard"}))
        else:
            out.append("P1")
    return out


def test_incident_to_prioritised_ticket(spark):
    trace = "java.lang.NullPointerException\n\tat org.acme.book.Ledger.closeBook(Ledger.java:88)"
    rows = [("a", "payment-service", datetime(2026, 5, 19, 22), True, "req", trace, "code"), ("b", "s", datetime(2026, 5, 19, 12), True, "req", "weird", ""),
            ("c", "s", datetime(2026, 5, 19, 12), False, "req", trace, "")]
    df = spark.createDataFrame(rows, "incident_id string, service string, created_at timestamp, is_anomaly boolean, requirement string, stack_trace string, code_context string")
    out = {r["incident_id"]: r for r in cons.resolve_incidents(df, scripted).collect()}
    assert out["a"]["status"] == "TICKETED" and out["a"]["calculated_severity"] == "P0" and out["a"]["suspected_files"] == ["Ledger.java"] and out["a"]["n_findings"] == 5
    assert out["b"]["status"] == "DEGRADED" and out["b"]["title"] is None
    assert out["c"]["status"] == "DISCARDED" and out["c"]["n_findings"] is None


def test_root_cause_skips_the_model_under_review(spark):
    v = spark.createDataFrame([("i", "review_needed", "REVIEW_NEEDED", 0.3, "[]", "")], "incident_id string, agreed_error_type string, primary_layer string, confidence double, dissent_json string, code_context string")

    def never(prompts):
        assert not prompts
        return []

    r = cons.root_cause(v, never).first()
    assert r["cause"].startswith("Manual review required") and r["cause_confidence"] == 0.3


def test_precision_uses_a_fixed_divisor(spark):
    df = spark.createDataFrame([(["A", "A", "B", "C", "D", "E"], ["A", "E"]), ([], ["A"]), (["A"], [])], "suggested array<string>, expected_files array<string>")
    assert [r["precision_at_k"] for r in cons.precision_at_k(df).collect()] == [0.4, 0.0, 0.0]


def test_dlq_tail_and_backlog(spark):
    df = spark.range(90).selectExpr("'logs.raw.dlq' AS topic", "cast(id % 3 AS int) AS partition", "id div 3 + 5 AS offset", "'k' AS key", "repeat('v', 5000) AS value")
    out = met.dlq_tail(df, "logs.raw.dlq", 7).collect()
    assert len(out) == 7 and max(r["offset"] for r in out) == 34 and min(r["offset"] for r in out) == 32 and len(out[0]["value_preview"]) == 4097
    assert met.dlq_tail(df, "logs.raw.dlq", 1000).count() == 90
    with pytest.raises(ValueError):
        met.dlq_tail(df, "nope.dlq")
    assert met.dlq_backlog(df).first()["backlog"] == 90


def test_percentiles(spark):
    df = spark.range(1, 101).select(F.lit("m").alias("model"), F.col("id").alias("ms"))
    exact = met.latency_percentiles(df, "ms", ["model"], exact=True).first()
    sketch = met.latency_percentiles(df, "ms", ["model"]).first()
    assert exact["p50"] == 50.5 and abs(sketch["p95"] - 95) <= 1


def test_observed_counts(spark):
    df, obs = met.observed(spark.range(10), "seen", odd=F.col("id") % 2 == 1)
    df.collect()
    assert obs.get == {"rows": 10, "odd": 5}
