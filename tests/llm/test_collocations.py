import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from opslens.llm import collocations
from opslens.llm.wordscan import Powers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, key long, word string"


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    most = Counter()
    for p, a in f.items():
        if len(p) == 4 and a >= least:
            for part in (p[:3], (p[0], *p[2:])):
                most[part] = max(most[part], a)
    out = {}
    for p, a in f.items():
        if len(p) < 3 or a < least or 100 * most[p] >= 50 * a:
            continue
        cuts = []
        for k in range(1, len(p) - 1):
            left, right = f[p[:k + 1]], f[(p[0], *p[k + 1:])]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        out.setdefault(p[0], []).append((-s, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items()
                  for i, x in enumerate(sorted(xs)[:top]))


def made(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "漢字", "A-b", "it's"]
    pick = lambda: words[min(int(rnd.expovariate(0.12)), len(words) - 1)]
    rows = [(None, "en"), ("", "en"), (" \t ", None), (".,;\n", "fr"), ("lone", "xx"), ("x" * 3000, "en")]
    for i in range(n):
        t = "".join(pick() + rnd.choice([" ", " ", " ", "\t ", ". ", "\n", "\x0b", "\r"]) for _ in range(rnd.randrange(1, 60)))
        rows.append((t, rnd.choice(["en", "en", "fr", None, "und"])))
    rows += [("New York City hall a a a a a", "en")] * 30 + [("one two three " * 40, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, "x") for i, (t, lang) in enumerate(rows)], SCHEMA)


def test_phrases_equal_the_plain_counts(spark, monkeypatch):
    rows = made(1, 400)
    df = frame(spark, rows).repartition(3)
    want = plain(rows, 10, 2000)
    assert want and {len(w[2].split()) for w in want} == {2, 3}
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    for how in ({}, dict(ranked=30), dict(ranked=0)):
        got = collocations.mine(df, **how)
        assert sorted(tuple(r[c] for c in names) for r in got.collect()) == want
    short = sorted(tuple(r[c] for c in names) for r in collocations.mine(df, least=3, top=5).collect())
    assert short == plain(rows, 3, 5)


def test_a_very_long_text_counts_as_it_would_in_pieces(spark):
    rnd = random.Random(4)
    long_ = " ".join(f"w{min(int(rnd.expovariate(0.1)), 90)}" for _ in range(700_000))
    rows = [(long_, "en"), ("w0 w1, " * 300_000, "fr"), ("q" * (3 << 20) + " a b" * 20, "de")]
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    got = sorted(tuple(r[c] for c in names) for r in collocations.mine(frame(spark, rows)).collect())
    assert got == plain(rows, 10, 2000)


@given(st.text(alphabet="ab  .\n,\té", max_size=300), st.integers(4, 40))
@settings(max_examples=400, deadline=None)
def test_blocks_of_a_long_text(text, most):
    body, powers, grams, whole = text.encode(), Powers(), Counter(), Counter()
    for part, again in collocations.parts(body, most):
        count(collocations.Runs([part], np.zeros(1, np.uint64), powers), again, grams)
    count(collocations.Runs([body], np.zeros(1, np.uint64), powers), 0, whole)
    assert grams == whole


def count(w, again, into):
    words = [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end)]
    for k in (1, 2, 3):
        for i in range(max(0, again - k + 1), len(words) - k + 1):
            if w.piece[i] == w.piece[i + k - 1]:
                into[tuple(words[i:i + k])] += 1


def test_dense_and_sorted_tiles_agree(monkeypatch):
    rnd = np.random.default_rng(3)
    p, w = np.minimum(rnd.zipf(1.3, 200_000), 200_000), np.minimum(rnd.zipf(1.3, 200_000), 200_000)
    p[:50] += collocations.HASHED
    want = Counter(zip(p.tolist(), w.tolist()))
    for dense, flush in ((100, 30_000), (1 << 40, 1 << 30)):
        monkeypatch.setattr(collocations, "DENSE_PAIRS", dense)
        monkeypatch.setattr(collocations, "FLUSH_PAIRS", flush)
        c, got = collocations.TileCounter(), Counter()
        for a in range(0, len(p), 9000):
            for x, y, n in [*c.add(p[a:a + 9000], w[a:a + 9000])]:
                got.update(dict(zip(zip(x.tolist(), y.tolist()), n.tolist())))
        assert bool(c.dense) == (dense == 100)
        for x, y, n in c.end():
            got.update(dict(zip(zip(x.tolist(), y.tolist()), n.tolist())))
        assert got == want


def test_empty_table(spark):
    assert collocations.mine(frame(spark, [])).count() == 0
