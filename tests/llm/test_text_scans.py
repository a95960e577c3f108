import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
import numpy as np
from hypothesis import strategies as st

from opslens.llm import licenses, pii, toxicity
from tests.llm.data import awkward, documents, prose

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return sorted((m.start(), k, m.end()) for k, (kind, rule) in enumerate(RULES) for m in re.finditer(rule, text)
                  if ok(kind, m.group()))


@given(st.text(alphabet="ab1234567890.@-+ ()é", max_size=60))
@settings(max_examples=500, deadline=None)
def test_spans_equal_the_plain_patterns(text):
    for t in (text, text + " 4111 1111-1111 1111 " + text, "x@y.zz" + text + "+1 (555) 0100-99"):
        assert pii.spans_of(t) == plain_spans(t)


def test_disclosing_terms_are_found_and_replaced(spark):
    rnd = random.Random(3)
    # "zoltanix" stands only beside one person's address, and in different surroundings; "garden" stands everywhere
    rows = [(i, f"{prose(rnd, 30)} zoltanix wrote from z.person@mail.example.com about garden {prose(rnd, 30)}")
            for i in range(6)]
    rows += [(100 + i, f"{prose(rnd, 60)} garden wrote from about") for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(3)]
    got = {r["doc_id"]: r for r in pii.report(documents(spark, rows)).collect()}
    at = rows[0][1].index("zoltanix")
    assert f"term:{at}:{at + 8}" in got[0]["spans"].split(",") and got[0]["n_email"] == 1
    assert got[100]["spans"] == "" and got[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    g = rows[0][1].index("garden ", at)
    assert f"term:{g}:{g + 6}" not in got[0]["spans"]
    clean = pii.sanitise(documents(spark, rows))
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "zoltanix" not in texts[0] and "[EMAIL]" in texts[0] and texts[100] == rows[6][1]
    assert clean.columns == documents(spark, rows).columns and len(texts) == len(rows)


def test_spans_of_one_start_go_by_kind(spark):
    rows = [(1, "4111111111111111@x.com and 10.0.0.1@y.org, +1 555 0100 99 4111-1111-1111-1111"), (2, "1.2.3.4@a.bc 4012888888881881@z.de")]
    got = {r["doc_id"]: r for r in pii.report(documents(spark, rows)).collect()}
    for i, text in rows:
        said = ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in plain_spans(text))
        assert got[i]["spans"] == said and got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["spans"].startswith("email:0:22,card:0:16")


def test_terms_of_recurring_parts_are_found(spark):
    rnd = random.Random(4)
    # each address occurs once; its domain and the name in it recur, with a firm beside the one and a nickname beside
    # the other; a word that stands near mentions in one text only, copied or not, discloses nothing
    rows = [(i, f"{prose(rnd, 30)} hooli person{chr(97 + i)}.x{i}@hooli.example.com {prose(rnd, 30)}") for i in range(6)]
    rows += [(50 + i, f"{prose(rnd, 30)} bobbykins robert{i}@mail{i}.example.com {prose(rnd, 30)}") for i in range(6)]
    rows += [(90 + i, f"{prose(random.Random(9), 30)} onceonly single.one@solo.example.com") for i in range(4)]
    rows += [(100 + i, prose(rnd, 60)) for i in range(400)]
    got = {r["doc_id"]: r for r in pii.report(documents(spark, rows)).collect()}
    for i, word in [(0, "hooli"), (5, "hooli"), (50, "bobbykins"), (55, "bobbykins")]:
        at = dict(rows)[i].index(word)
        assert f"term:{at}:{at + len(word)}" in got[i]["spans"].split(",")
    assert got[90]["n_term"] == 0 and sum(r["n_term"] for r in got.values()) < 20


def test_disclosing_terms_are_marked_wherever_they_stand(spark):
    rnd = random.Random(11)
    long = "\u4e00" * 500
    # far from the mention, in texts without any, short, in another alphabet, in capitals after characters of two bytes,
    # and longer than any reach; "halfway" stands in other texts too, so it goes from its holders
    rows = [(i, f"Éé LI {prose(rnd, 40)} li {long} \u738b halfway me{i} only.one@solo.example.com {prose(rnd, 40)} halfway li")
            for i in range(30)]
    rows += [(50, f"ééé Li {prose(rnd, 9)} \u738b."), (51, f"{prose(rnd, 9)} {long}"), (None, "só li")]
    rows += [(60 + i, f"halfway {prose(rnd, 60)}") for i in range(10)] + [(100 + i, prose(rnd, 60)) for i in range(400)]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.report(docs).collect()}
    for i, text in rows[:33]:
        for word in ("li", long, "\u738b", *["halfway"] * (i in range(30))):
            places = [f"term:{m.start()}:{m.end()}" for m in re.finditer(rf"\b{word}\b", text.lower())]
            assert set(places) <= set(got[i]), (i, word[:9])
    assert got[60] == [""]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all(w not in clean[i].lower().split() for i in (0, 29, 50, 51, None) for w in ("li", long, "\u738b", "\u738b."))
    assert "halfway" not in clean[0] and " h. " in clean[0] and clean[60] == dict(rows)[60]


def test_every_document_may_hold_the_entity(spark):
    got = pii.report(documents(spark, [(i, f"word{i} names one@solo.example.com") for i in range(4)])).collect()
    assert [r["n_term"] for r in got] == [0] * 4


def test_pii_awkward_rows(spark):
    rows = awkward() + [(9, "a@b.cc a@b.cc 1.2.3.4"), (9, "a@b.cc a@b.cc 1.2.3.4"), (9, "+1 555 010 0199")]
    got = pii.report(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r["spans"] for r in got if r["doc_id"] == 9) == ["email:0:6,email:7:13,ip:14:21"] * 2 + ["phone:0:15"]
    assert pii.report(documents(spark, [])).count() == 0
    assert pii.sanitise(documents(spark, rows)).count() == len(rows)
    assert pii.sanitise(documents(spark, [])).count() == 0
    clash = documents(spark, rows).selectExpr("*", "'own' as _pii_base", "1 as _PII_id", "2 as text_hash")
    clean = pii.sanitise(clash)
    assert clean.columns == clash.columns and clean.where("_pii_base = 'own' and _PII_id = 1").count() == len(rows)
    assert clean.where("doc_id = 9 and text like '[EMAIL]%'").count() == 2


def brute_licenses(text):
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(k, label) for label, p in licenses.PHRASES for k in range(len(words))
             if words[k:k + len(p.split())] == p.split()]
    return len(words), len(found), found and min(found)[0], found and max(found)[0], ",".join(
        sorted({y for _, y in found}))


def test_phrases_equal_brute_force(spark):
    rnd = random.Random(5)
    bits = ["GNU General", "public license", "Apache License,", "CC BY", "cc-by-nc 4.0", "the MIT", "License", "é", "mit\nlicense"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))) for i in range(150)] + awkward()
    got = licenses.scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *brute_licenses(t or "")) for i, t in rows)
    have = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], [] if r["first_word"] is None else r["first_word"],
                   [] if r["last_word"] is None else r["last_word"], r["base_labels"]) for r in got)
    assert [(*w[:3], w[3] or 0, w[4] or 0, w[5]) for w in want] == [(*h[:3], h[3] or 0, h[4] or 0, h[5]) for h in have]
    assert licenses.scan(documents(spark, [])).count() == 0


def test_notices_need_their_key_phrases(spark):
    rnd = random.Random(6)
    notice = dict((n[0], n[1]) for n in licenses.NOTICES)
    rows = [(1, f"{prose(rnd, 50)} {notice['mit-notice']} {prose(rnd, 9)}"),
            (2, notice["mit-notice"].replace("granted free of charge", "given away")),
            (3, notice["gpl-notice"].upper()), (4, "Released under the MIT License.")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(documents(spark, rows)).collect()}
    assert got[1][0] == "mit-notice" and got[1][1] == 1.0
    assert got[2] == ("", 0.0)
    assert got[3][0].split(",") == ["gpl", "gpl-notice"] and got[4][0] == "mit,mit-release"


def test_files_with_several_notices_keep_them_all(spark):
    rnd = random.Random(12)
    notices = [(label, text) for label, text, _ in licenses.NOTICES]
    pairs = [(a, b) for a in notices for b in notices if a != b]
    rows = [(i, f"{a[1]}. {b[1]}") for i, (a, b) in enumerate(pairs)]
    rows.append((1000, ". ".join(text for _, text in notices)))
    # rarer licence words than those of the notice in a very long text, and notices at its ends, one of them cut
    words = licenses.Index().words
    noise = [" ".join(rnd.choice(words) + rnd.choice([" ", " x "]) for _ in range(30_000)) for _ in range(2)]
    rows.append((1001, f"{notices[0][1]} x {noise[0]} x {notices[2][1]} x {noise[1]} x {notices[10][1]}"))
    rows.append((1002, notices[8][1].split(" ", 2)[2]))
    # in most texts the words of notices are common
    rows += [(2000 + i, rnd.choice(notices)[1]) for i in range(300)] + [(3000 + i, prose(rnd, 20)) for i in range(300)]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    for i, (a, b) in enumerate(pairs):
        assert {a[0], b[0]} <= set(got[i]["labels"].split(",")), (a[0], b[0])
        assert got[i]["score"] == 1.0
    assert {label for label, _ in notices} <= set(got[1000]["labels"].split(","))
    assert {notices[0][0], notices[2][0], notices[10][0]} <= set(got[1001]["labels"].split(","))
    assert got[1002]["labels"] == "mit-notice" and 0.7 <= got[1002]["score"] < 1


def test_toxicity_learns_and_holds_out(spark):
    rnd = random.Random(7)
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = prose(rnd, 60).split()
        if bad:
            for _ in range(3):
                words[rnd.randrange(60)] = rnd.choice(["grumblefoot", "grumblehead", "snarkface"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    docs = documents(spark, rows + [(9000 + k, t) for k, (_, t) in enumerate(awkward())])
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 600 + len(awkward()) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(600) if got[i]["held_out"]]
    assert 80 < len(held) < 160 and sum(got[i]["predicted"] == marks[i][1] for i in held) >= 0.98 * len(held)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(
        i for i in held if marks[i][1] == 0 and got[i]["predicted"] == 0)
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.score(docs, None).where("score = 0").count() == len(got)
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_fit_in_tasks_equals_a_plain_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEP_ROWS", 7)
    rng = np.random.default_rng(6)
    x = rng.random((120, 12)) < 0.3
    x[5] = False  # a row without any feature
    y = ((x[:, 0] | x[:, 3]) ^ (rng.random(120) < 0.1)).astype(int)
    scale = np.append(rng.normal(size=11), 0.0)
    rows = [(int(b), np.flatnonzero(a).astype("<i4").tobytes()) for a, b in zip(x, y)]
    sample = spark.createDataFrame(rows, "toxic int, cols binary").repartition(5)
    counts = np.array([(y == 0).sum(), y.sum()])
    w, b = toxicity.logistic(sample, scale, counts, 0.03, 200)
    share, v, c = np.where(y > 0, 0.5 / counts[1], 0.5 / counts[0]), np.zeros(12), 0.0
    for _ in range(20_000):
        g = share * (1 / (1 + np.exp(-(x * scale @ v + c))) - y)
        v, c = v - 0.5 * ((x * scale).T @ g + 0.03 * v), c - 0.5 * g.sum()
    assert np.abs(w - v).max() < 5e-3 and abs(b - c) < 5e-3 and w[11] == 0


def test_a_label_of_many_rows_and_empty_texts_can_be_fitted(spark):
    rnd = random.Random(5)
    rows = [(1, f"grumble {prose(rnd, 9)}")] * 300 + [(2, prose(rnd, 9)), (3, ""), (4, None)]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    docs = documents(spark, rows)
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 303 and all(0 <= r["score"] <= 1 for r in got)


def test_buckets_do_not_depend_on_blocks(monkeypatch):
    text = prose(random.Random(8), 3000)
    whole = toxicity.present(text).tolist()
    monkeypatch.setattr(toxicity, "BLOCK", 501)
    assert toxicity.present(text).tolist() == whole
