import math
from datetime import datetime, timedelta
import random

import pytest
from pyspark.sql import functions as F

from opslens.operators import incidents as inc
from opslens.operators.detect import classify, detect, evidence
from opslens.operators.windows import first_seen, fingerprint_batches
from opslens.sources.logs import preprocess

T0 = datetime(2026, 5, 11, 12, 0, 0)


def rule(spark, cold, cnt, fp, err, svc):
    def stats(xs):
        n = len(xs)
        mean = sum(xs) / n if n else math.nan
        std = math.sqrt(sum((x - mean) ** 2 for x in xs) / (n - 1)) if n > 1 else (0.0 if n else math.nan)
        return n, mean, std

    fn, fm, fs = stats(fp)
    sn, sm, ss = stats(svc)
    cols = [F.lit(x) for x in (cold, float(cnt), fn, float(fm), float(fs), float(err), sn, float(sm), float(ss))]
    return spark.range(1).select(classify(*cols).alias("r")).first()["r"]


def test_steady_traffic_is_quiet(spark):
    fp = [10, 10, 11, 10, 9] + [10] * 30
    assert rule(spark, False, 10, fp, 2, [2] * 35) is None


def test_sudden_spike(spark):
    r = rule(spark, False, 40, [5 + i % 3 for i in range(35)], 0, [])
    assert r["anomaly_type"] == "SPIKE" and r["score"] > 3


def test_gradual_ramp_is_relative_rate_jump(spark):
    r = rule(spark, False, 1, [1] * 35, 18, [10] * 35)
    assert (r["anomaly_type"], r["signal"], r["score"]) == ("RATE_JUMP", "service_error_relative", 1.8)


def test_new_fingerprint(spark):
    assert rule(spark, False, 6, [0] * 35, 0, [])["anomaly_type"] == "NEW_ERROR"
    assert rule(spark, False, 5, [0] * 35, 0, []) is None


def test_cold_start_spike_and_empty_baseline(spark):
    r = rule(spark, True, 55, [], 0, [])
    assert (r["anomaly_type"], r["score"], r["signal"]) == ("SPIKE", 55.0, "cold_start_24h_static")
    # an empty baseline has no mean, so a cold NEW_ERROR cannot fire on it
    assert rule(spark, True, 6, [], 0, []) is None
    assert rule(spark, True, 6, [], 40, [])["anomaly_type"] == "RATE_JUMP"


def burst(spark, n=100):
    rows = [(i, "auth-service", "ERROR", f"Connection failed to 10.0.0.{i}:5432 after {1000 + i}ms", T0 + timedelta(seconds=i)) for i in range(n)]
    return preprocess(spark.createDataFrame(rows, "event_id bigint, service string, level string, message string, occurred_at timestamp"))


def test_burst_opens_exactly_two_incidents(spark):
    found = detect(burst(spark))
    opened = {r["anomaly_type"]: r for r in inc.open_incidents(found).collect()}
    assert set(opened) == {"NEW_ERROR", "SPIKE"}
    assert opened["NEW_ERROR"]["event_id"] == 5 and opened["SPIKE"]["event_id"] == 49
    audit = inc.audit_rows(found, inc.open_incidents(found)).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in audit} == {"TICKETED": 2, "DISCARDED": 98}


def test_evidence_names_the_numbers(spark):
    found = detect(burst(spark)).withColumn("ev", evidence())
    ev = found.filter("event_id = 49").first()["ev"]
    assert ev["strategy"] == "cold_start_24h_static" and float(ev["threshold"]) == 50 and float(ev["current"]) == 50
    assert found.filter("event_id = 0").first()["ev"] is None


def brute(rows, window_s, n):
    """Event by event with dictionaries, the way the rules are told."""
    counts, errs, first, last, out = {}, {}, {}, {}, {}
    for eid, svc, level, fp, ts in sorted(rows, key=lambda r: (r[4], r[0])):
        us = int((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        w = us // 1_000_000 // window_s
        k = (svc, fp)
        if k not in last or us - last[k] >= 172_800_000_000:
            first[k] = us
        last[k] = us
        counts[(k, w)] = counts.get((k, w), 0) + 1
        errs[(svc, w)] = errs.get((svc, w), 0) + (level == "ERROR")
        base = [counts.get((k, w - i), 0) for i in range(1, n + 1)]
        out[eid] = (counts[(k, w)], errs[(svc, w)], sum(base) / n, us // 1_000_000 - first[k] // 1_000_000 < 86400)
    return out


@pytest.mark.parametrize("max_rows", [None, 40])
def test_context_against_brute_force_on_skewed_ties(spark, max_rows):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.5
        ts = T0 + (timedelta(seconds=rng.choice([0, 0, 0, 1, 400])) if hot else timedelta(microseconds=rng.randrange(6 * 10**11)))
        rows.append((i, "hot" if hot else f"s{i % 3}", rng.choice(["ERROR", "INFO"]), f"f{i % 2}", ts))
    df = spark.createDataFrame(rows, "event_id bigint, service string, level string, fingerprint string, occurred_at timestamp")
    got = {r["event_id"]: r for r in detect(df.repartition(7), window_s=300, n=288, max_slot_rows=max_rows).collect()}
    want = brute(rows, 300, 288)
    assert len(got) == len(want)
    for eid, (cnt, err, mean, cold) in want.items():
        r = got[eid]
        assert (r["fp_count"], r["svc_errors"], r["is_cold"]) == (cnt, err, cold), eid
        assert r["fp_mean"] == pytest.approx(mean, abs=1e-12)


def test_string_ids_in_crowded_moments(spark):
    rows = [(f"m-{i:05d}", "hot", "ERROR", "f", T0) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id string, service string, level string, fingerprint string, occurred_at timestamp")
    got = detect(df.repartition(5), max_slot_rows=100).select("event_id", "fp_count").collect()
    assert {r[0]: r[1] for r in got} == {f"m-{i:05d}": i + 1 for i in range(2000)}


def test_cuts_bound_every_group(spark):
    from opslens.operators.running import with_slots

    rows = [(i, "k", int(i > 500) * 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "event_id bigint, k string, ts_us bigint")
    sizes = with_slots(df, ["k"], max_rows=100).groupBy("k", "_slot", "_cut").count()
    assert sizes.agg(F.max("count")).first()[0] <= 200 and sizes.count() >= 20


def test_first_seen_resets_after_two_idle_days(spark):
    ts = [T0, T0 + timedelta(hours=47), T0 + timedelta(hours=95), T0 + timedelta(hours=142, minutes=59)]
    df = spark.createDataFrame([(i, "s", "INFO", "f", t) for i, t in enumerate(ts)], "event_id bigint, service string, level string, fingerprint string, occurred_at timestamp")
    got = sorted((r["first_seen_us"], r["cnt"]) for r in first_seen(df).collect())
    assert [c for _, c in got] == [2, 2]


def test_batches_keep_first_events(spark):
    b = fingerprint_batches(burst(spark, 30), sample=4).first()
    assert b["cnt"] == 30 and [e["event_id"] for e in b["sample"]] == [0, 1, 2, 3]
    assert b["normalized_message"] == "Connection failed to <IP>:<NUM> after <DURATION>"


def test_result_does_not_depend_on_row_order_or_partitions(spark):
    df = burst(spark, 80)
    a = sorted(map(tuple, detect(df).select("event_id", "fp_count", "svc_errors", "anomaly_type").collect()), key=str)
    b = sorted(map(tuple, detect(df.orderBy(F.rand(3)).repartition(9)).select("event_id", "fp_count", "svc_errors", "anomaly_type").collect()), key=str)
    assert a == b


def test_missing_time_counts_as_now(spark):
    df = burst(spark, 10).withColumn("occurred_at", F.when(F.col("event_id") > 3, F.col("occurred_at")))
    got = {r["event_id"]: r for r in detect(df).collect()}
    assert len(got) == 10 and got[3]["fp_count"] == 4 and got[9]["fp_count"] == 6 and got[0]["svc_mean"] is not None
