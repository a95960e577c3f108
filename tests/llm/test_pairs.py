import itertools
import random

import numpy as np
import pytest

from opslens.llm import dartminhash, decontaminate, metricjoin
from opslens.llm.graph import components
from opslens.llm.wordscan import Powers, Words
from tests.llm.data import awkward, documents, prose


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dart_similarity():
    rnd = random.Random(2)
    base = prose(rnd, 500).split()
    texts = [" ".join(base)]
    for k in (5, 20, 60):
        own = base[:]
        for _ in range(k):
            own[rnd.randrange(500)] = "new" + str(rnd.randrange(999))
        texts.append(" ".join(own))
    doc, unit = dartminhash.units(Words([t.encode() for t in texts], Powers()))
    sig = dartminhash.signatures(doc, unit, len(texts), 1024)
    sets = [set(unit[doc == i].tolist()) for i in range(len(texts))]
    for i in (1, 2, 3):
        true = len(sets[0] & sets[i]) / len(sets[0] | sets[i])
        assert abs((sig[0] == sig[i]).mean() - true) < 0.06


def near_copies(rnd):
    rows, i = [], 0
    for _ in range(12):
        base = prose(rnd, 150).split()
        for _ in range(rnd.randrange(1, 6)):
            own = base[:]
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 9])):
                own[rnd.randrange(150)] = "odd" + str(rnd.randrange(99))
            rows.append((i, " ".join(own)))
            i += 1
    return rows


def test_classes_equal_brute_force(spark):
    rows = near_copies(random.Random(4)) + [(9000 + k, t) for k, (_, t) in enumerate(awkward())]
    doc, unit = dartminhash.units(Words([(t or "").encode() for _, t in rows], Powers()))
    sets = [set(unit[doc == i].tolist()) for i in range(len(rows))]
    ids = [r[0] for r in rows]
    links = [(ids[a], ids[b]) for a, b in itertools.combinations(range(len(rows)), 2)
             if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(ids, links)
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.classes(documents(spark, rows)).collect()}
    assert got == want


def test_one_of_each_class_stays(spark):
    rows = [(100 + i, t) for i, t in near_copies(random.Random(5))] + awkward() + [(8, "another text of the same id")] * 2
    rows += [(9, rows[0][1]), (9, "the other text of nine")]
    docs = documents(spark, rows)
    named = dartminhash.classes(docs).collect()
    kept = dartminhash.keep_one(docs)
    kept_rows = kept.collect()
    left = [r["doc_id"] for r in kept_rows]
    assert kept.columns == docs.columns and len(named) == len(rows)
    firsts = {r["class_id"] for r in named if r["doc_id"] is not None}
    assert sorted(i for i in left if i is not None and i not in (8, 9)) == sorted(firsts - {8, 9})
    # an id of different texts keeps each of them once
    for i in (8, 9):
        assert sorted(r["text"] for r in kept_rows if r["doc_id"] == i) == sorted({t for k, t in rows if k == i})
    assert left.count(None) == 1
    assert dartminhash.keep_one(documents(spark, [])).count() == 0


def edited(rnd, text, k):
    x = list(text)
    for _ in range(k):
        at = rnd.randrange(len(x))
        what = rnd.randrange(3)
        x[at:at + (what != 1)] = [] if what == 2 else [rnd.choice("abcdefgh")]
    return "".join(x)


def plain_edits(p, c):
    """Least edits of p against any stretch of c."""
    row, at, chars = np.zeros(len(c) + 1, int), np.arange(len(c) + 1), np.array(list(c))
    for i, ch in enumerate(p, 1):
        new = np.append(i, np.minimum(row[:-1] + (chars != ch), row[1:] + 1))
        row = np.minimum.accumulate(new - at) + at
    return row.min()


@pytest.mark.parametrize("rate", [0.05, 0.1])
def test_matches_within_the_budget(spark, rate):
    rnd = random.Random(6)
    items = [(i, prose(rnd, rnd.randrange(9, 30)).capitalize() + ".") for i in range(12)]
    rows, want = [], set()
    for d in range(40):
        i, t = items[rnd.randrange(12)]
        body = edited(rnd, t, rnd.randrange(0, int(rate * len(t) * 1.6)))
        rows.append((d, f"{prose(rnd, rnd.randrange(60))}\n{body} {prose(rnd, rnd.randrange(60))}"))
    for d, t in rows:
        c = decontaminate.normal(t)
        for i, x in items:
            p = decontaminate.normal(x)
            if len(set(c[k:k + 8] for k in range(len(c))) & set(p[k:k + 8] for k in range(len(p)))) > 3:
                cut = int(0.15 * len(p))
                needles = [p] + ([p[cut:-cut]] if len(p) - 2 * cut >= 40 else [])
                if any(plain_edits(x, c) <= int(rate * len(x)) for x in needles):
                    want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (4 << 20, 300):
        found = decontaminate.find(documents(spark, rows), bench, edit_rate=rate, block_bytes=block_bytes)
        got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
        assert got == want
    kept = {r["doc_id"] for r in decontaminate.keep_clean(documents(spark, rows), bench, edit_rate=rate).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}


def test_decontamination_awkward_rows(spark):
    item = "Some passage of a benchmark that is long enough to be looked for."
    bench = spark.createDataFrame([(1, item), (None, item), (2, None), (3, ""), (4, "short")], "item_id long, text string")
    rows = awkward() + [(11, item), (11, item), (None, "x " * 5000 + item.upper())]
    got = decontaminate.find(documents(spark, rows), bench).collect()
    shorts = [("4", "4", 0)] * 2 + [("5", "4", 0), ("None", "4", 0)]
    assert sorted((str(r["doc_id"]), str(r["item_id"]), r["edits"]) for r in got) == sorted(
        [("11", "1", 0), ("11", "None", 0)] * 2 + [("None", "1", 0), ("None", "None", 0)] + shorts)
    assert decontaminate.keep_clean(documents(spark, rows), bench).count() == len(awkward()) - len(shorts)
    assert decontaminate.keep_clean(documents(spark, rows), bench, least_chars=6).count() == len(awkward())
    assert decontaminate.find(documents(spark, []), bench).count() == 0
    assert decontaminate.find(documents(spark, rows), bench.limit(0)).count() == 0


def test_short_long_and_partly_quoted_items(spark):
    rnd = random.Random(12)
    mid, long_, short = prose(rnd, 30), prose(rnd, 700), "Where does the old river end?"
    assert len(short) == 29 and len(decontaminate.normal(long_)) > 5000
    n = len(mid)
    rows = [(1, f"{prose(rnd, 9)} {mid[:int(0.86 * n)]}"), (2, f"{mid[int(0.14 * n):]} {prose(rnd, 9)}"),
            (3, f"{prose(rnd, 9)} {mid[:n // 2]} {prose(rnd, 20)}"), (4, f"{prose(rnd, 9)}, WHERE does the old river end?"),
            (5, "where does the old river ending"), (6, "where does an old river end"), (7, long_[1700:4000]),
            (8, edited(rnd, long_, 300)), (9, long_[1700:2100]), (10, "so: " + mid)]
    bench = spark.createDataFrame([(1, mid), (2, short), (3, long_)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find(documents(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2), (7, 3), (8, 3), (10, 1)}
    assert {k: r["part"] for k, r in got.items()} == {
        (1, 1): "core", (2, 1): "core", (4, 2): "whole", (7, 3): "segment", (8, 3): "segment", (10, 1): "whole"}
    for (d, i), r in got.items():
        if r["edits"] == 0:
            item = decontaminate.normal({1: mid, 2: short, 3: long_}[i])
            assert decontaminate.normal(dict(rows)[d])[r["start"]:r["end"]] in item
    at = got[(4, 2)]
    assert decontaminate.normal(rows[3][1])[at["start"]:at["end"]] == decontaminate.normal(short)
    kept = {r["doc_id"] for r in decontaminate.keep_clean(documents(spark, rows), bench).collect()}
    assert kept == {3, 5, 6, 9}


def brute_links(rows):
    ids = [i for i, v in rows]
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, links = [0] * len(rows), []
    for a, b in itertools.combinations(range(len(rows)), 2):
        if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                n[a] += 1
                n[b] += 1
                links.append((ids[a], ids[b]))
    up = roots(ids, links)
    return sorted((i, k, up[i], up[i] == i) for i, k in zip(ids, n))


@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_metric_join_equals_brute_force(spark, cell_rows):
    rng = np.random.default_rng(3)
    rows = []
    for size, spread in ((120, 1.0), (60, 0.05), (40, 0.12)):
        centre = rng.normal(size=8)
        rows += [(centre + spread * rng.normal(size=8)).astype(np.float32).tolist() for _ in range(size)]
    rows += [rows[130]] * 5 + [[2 * x for x in rows[130]]] + [None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8,
                                                             [float("inf")] + [1.0] * 7, [1.0, 2.0], [1.0, 2.0], [1e-30] * 8]
    rows = list(enumerate(rows))
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as node", "2 as many")
    got = metricjoin.near_duplicates(table, cell_rows=cell_rows)
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == brute_links(rows)


def test_metric_join_without_rows_or_ids(spark):
    kinds = "vec_id long, embedding array<float>"
    assert metricjoin.near_duplicates(spark.createDataFrame([], kinds)).count() == 0
    got = metricjoin.near_duplicates(spark.createDataFrame([(None, [1.0]), (5, [1.0]), (5, [1.0])], kinds)).collect()
    assert sorted(map(str, got)) == sorted(map(str, [
        type(got[0])(vec_id=None, n_links=0, component_id=None, kept=False),
        type(got[0])(vec_id=5, n_links=1, component_id=5, kept=True),
        type(got[0])(vec_id=5, n_links=1, component_id=5, kept=True)]))


@pytest.mark.parametrize("block", [256, 7])
def test_classes_that_only_chains_join(spark, monkeypatch, block):
    """Long chains of copies: neighbours are similar, ends are not, and no document is similar to all."""
    monkeypatch.setattr(dartminhash.between_classes, "__defaults__", (block, block))
    rnd = random.Random(11)
    rows = []
    for c in range(3):
        words = prose(rnd, 120).split()
        for k in range(60):
            words = words[:]
            words[rnd.randrange(120)] = f"step{c}x{k}"
            rows.append((1000 * c + k, " ".join(words)))
    rnd.shuffle(rows)
    doc, unit = dartminhash.units(Words([t.encode() for _, t in rows], Powers()))
    sets = [set(unit[doc == i].tolist()) for i in range(len(rows))]
    ids = [r[0] for r in rows]
    links = [(ids[a], ids[b]) for a, b in itertools.combinations(range(len(rows)), 2)
             if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(ids, links)
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.classes(documents(spark, rows)).collect()}
    assert got == want
