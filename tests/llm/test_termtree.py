import math
import random
from collections import Counter, defaultdict

from opslens.llm import termtree
from tests.llm.data import awkward, documents, prose


def plain_rank(rows, items, k):
    """Every score of every document, by the stated formula."""
    docs = [(i, termtree.terms_of(t)) for i, t in rows]
    n = sum(bool(t) for _, t in docs)
    total = sum(len(t) for _, t in docs)
    df = Counter(w for _, t in docs for w in set(t))
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(termtree.terms_of(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, t in docs:
            tf, m = Counter(t), 100 - 50 + (50 * len(t) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 20 * m))
                    for w in terms if tf[w])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: r[:2])


def test_ranks_equal_all_scores(spark):
    rnd = random.Random(9)
    rows = awkward() + [(100 + i, prose(rnd, rnd.randrange(1, 120))) for i in range(500)]
    rows += [(2000 - i, rows[30][1]) for i in range(300)] + [(3000 + i, "Of The river0 " * rnd.randrange(1, 9)) for i in range(60)]
    rows += [(None, rows[40][1]), (100, "ÉTÉ été river1 漢字")]
    rnd.shuffle(rows)
    items = [(i, prose(rnd, rnd.randrange(1, 40))) for i in range(25)] + [
        (50, rows[3][1]), (51, None), (52, ""), (53, "zzz unknown"), (54, "RIVER0 the of of"), (None, "river1"), (54, "river1"),
        (55, "word"), (56, "x" * 300_000), (57, "ÉTÉ 漢字"), (58, "short")]
    made = spark.createDataFrame(items, "item_id long, text string")
    for size in (dict(block_docs=64, leaf_docs=3), dict(block_docs=4096, leaf_docs=24), dict(wave_bytes=200)):
        got = termtree.rank(documents(spark, rows).repartition(3), made, k=7, **size).collect()
        assert ordered(tuple(r) for r in got) == ordered(plain_rank(rows, items, 7))


def test_subtrees_are_left_out_and_bounds_hold():
    rnd = random.Random(2)
    import numpy as np

    k, docs = 40, []
    for _ in range(600):
        t = np.unique(np.minimum(np.array([int(rnd.expovariate(0.15)) for _ in range(12)]), k - 1))
        docs.append((t.astype(">i4").tobytes(), np.array([rnd.randrange(1, 6) for _ in t], "<i4").tobytes(), rnd.randrange(50, 200)))
    docs = sorted(set(docs))
    tree = termtree.Tree(docs, [np.array([i]) for i in range(len(docs))], k, 4)
    weights = np.zeros((k, 1))
    weights[[30, 35, 39], 0] = 900, 700, 500
    seen = []
    tree.score = lambda lo, hi, *rest: (seen.append(hi - lo), termtree.Tree.score(tree, lo, hi, *rest))
    best = termtree.Best(1, 5)
    tree.search(weights, best)
    value = np.zeros((len(docs), k))
    for i in range(len(docs)):
        a, b = tree.at[i], tree.at[i + 1]
        value[i, tree.terms[a:b]] = termtree.part(tree.tf[a:b], tree.m[i])
    top = sorted((value @ weights).ravel().tolist(), reverse=True)[:5]
    assert best.score[0].tolist() == top and sum(seen) < len(docs)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "river0")], "item_id long, text string")
    assert termtree.rank(documents(spark, []), some).count() == 0
    assert termtree.rank(documents(spark, [(1, "river0")]), none).count() == 0
    assert [tuple(r) for r in termtree.rank(documents(spark, [(1, "river0")]), some).collect()] == plain_rank(
        [(1, "river0")], [(1, "river0")], 50)
