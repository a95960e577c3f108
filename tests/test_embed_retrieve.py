import random
import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.functions.kernels import fake_vectors, java_hash
from opslens.operators import embed as emb
from opslens.operators import postings
from opslens.operators import retrieve as ret

REQ = "seq bigint, corpus string, content_id string, text string, metadata map<string,string>"


def wrap(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("s", ["", "a", "hello world", "é𝄞x" * 9])
def test_fake_vector_rule(s):
    h = 0
    units = s.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "little")) & 0xFFFFFFFF
    h = h - (1 << 32) if h >> 31 else h
    assert java_hash(s) == h
    want, seed = [], h
    for i in range(40):
        seed = wrap(seed * 31 + i)
        want.append(np.float32(np.float32(int(np.fmod(seed, 1000))) / np.float32(1000)))
    assert fake_vectors([s], 40)[0].tolist() == [float(x) for x in want]


def test_equal_texts_are_embedded_once_and_stored_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(texts, dim):
        seen.add(len(texts))
        return fake_vectors(texts, dim)

    df = spark.createDataFrame([(1, "LOGS", "id-1", "same", {}), (2, "logs", "id-2", "same", {}), (3, "LOGS", "id-2", "same", {})], REQ)
    vectors = emb.embed_requests(df, fn=counting, dim=1536)
    out = emb.upsert_corpus(None, df, "LOGS", vectors).collect()
    assert seen.value == 1
    assert {r["fingerprint"]: r["sample_count"] for r in out} == {"id-1": 1, "id-2": 2}
    assert all(len(r["embedding"]) == 1536 for r in out)


def test_cached_texts_are_not_embedded(spark):
    df = spark.createDataFrame([(1, "LOGS", None, "a", {}), (2, "LOGS", None, "b", {})], REQ)
    cache = emb.embed_requests(df.filter("seq = 1"), dim=4)

    def refuse(texts, dim):
        assert texts == ["b"]
        return fake_vectors(texts, dim)

    assert emb.embed_requests(df, cache, refuse, 4).count() == 2


def test_upserts_by_corpus(spark):
    def req(seq, text, corpus="CODE", **meta):
        return (seq, corpus, "inc-1", text, meta)

    key = dict(repo="r", git_sha="g", file_path="f", fqn="q")
    first = spark.createDataFrame([req(1, "old", **key), req(2, "nokey", repo="r")], REQ)
    stored = emb.upsert_corpus(None, first, "CODE").withColumn("content", F.lit("kept"))
    after = emb.upsert_corpus(stored, spark.createDataFrame([req(5, "new", **key)], REQ), "CODE").collect()
    assert len(after) == 1 and after[0]["content"] == "kept" and after[0]["seq"] == 5
    _, quarantined = emb.split_keyless(emb.corpus_requests(first, "CODE"), "CODE")
    assert [r["seq"] for r in quarantined.collect()] == [2]
    inc = spark.createDataFrame([req(1, "x", "INCIDENTS"), req(2, "y", "incidents")], REQ)
    assert [(r["content"], r["sample_count"]) for r in emb.upsert_corpus(None, inc, "INCIDENTS").collect()] == [("y", 2)]
    with pytest.raises(ValueError):
        emb.corpus_requests(inc, "LOG")
    assert emb.unknown_corpus(spark.createDataFrame([req(1, "x", "LOG"), req(2, "x", "LOGS")], REQ)).count() == 1


def code_rows(spark):
    rows = [
        (1, "repo", "sha", "Shelf.java", "org.acme#put", 'void storeParcel(Box b) { fail("SHELF_17 is full"); }', [0.0] * 1536),
        (2, "repo", "sha", "Shelf.java", "org.acme#putAgain", "void storeParcelLater(Queue q) { /* waits for a free shelf */ }", [0.0] * 1536),
        (3, "other", "sha", "X.java", "com.example#x", None, [0.0] * 1536),
    ]
    return spark.createDataFrame(rows, "id bigint, repo string, git_sha string, file_path string, fqn string, content string, vector array<float>")


def test_exact_token_row_first_with_zero_vectors(spark):
    q = spark.createDataFrame([(1, "SHELF_17 storeParcel", [0.0] * 1536)], "query_id bigint, text string, vector array<float>")
    out = ret.hybrid_search(q, code_rows(spark), corpus_name="CODE").orderBy("rnk").collect()
    assert "SHELF_17" in out[0]["content"] and out[0]["corpus"] == "code_embeddings"
    assert {r["id"]: r["content"] for r in out}[3] == "X.java com.example#x"
    kept = ret.hybrid_search(q, code_rows(spark), corpus_name="code", filters={"repo": "other", "service": "x", "fqn": None})
    assert [r["id"] for r in kept.collect()] == [3]
    with pytest.raises(ValueError):
        ret.hybrid_search(q, code_rows(spark), corpus_name="WIKI")


def random_sets(spark, nq, nc, dim=8):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(60)]
    q = [(int(i), [float(x) for x in rng.normal(size=dim)], " ".join(rng.choice(words, 6)), f"r{i % 3}") for i in range(nq)]
    c = [(int(i), [float(x) for x in rng.normal(size=dim)], " ".join(rng.choice(words, 8)), "r0" if i % 2 else f"r{i % 3}") for i in range(nc)]
    return (q, c, spark.createDataFrame(q, "query_id bigint, vector array<double>, text string, repo string"),
            spark.createDataFrame(c, "id bigint, vector array<double>, content string, repo string"))


def grams(s):
    return {p[i : i + 3] for w in s.split() for p in [f"  {w} "] for i in range(len(p) - 2)}


@pytest.mark.parametrize("by", [None, "repo"])
@pytest.mark.parametrize("wide", [False, True])
def test_both_ways_match_brute_force(spark, monkeypatch, by, wide):
    if wide:
        monkeypatch.setattr(ret, "WAVE_ROWS", 7)
        monkeypatch.setattr(ret, "SCORE_BLOCK", 3)
        monkeypatch.setattr(ret, "MAX_WINNERS", 0)
    q, c, qd, cd = random_sets(spark, 20, 300)
    vec = {(r["query_id"], r["rnk"]): (r["id"], r["distance"]) for r in ret.vector_topk(qd, cd.repartition(5), 6, by).collect()}
    lex = {(r["query_id"], r["rnk"]): (r["id"], r["similarity"]) for r in ret.lexical_topk(qd, cd.repartition(5), 6, by=by).collect()}
    want_v, want_l = {}, {}
    for qid, qv, qt, qr in q:
        pool = [x for x in c if by is None or x[3] == qr]
        qv = np.array(qv) / np.linalg.norm(qv)
        d = sorted((round(1 - float(np.array(v) @ qv / np.linalg.norm(v)), 9), i) for i, v, _, _ in pool)[:6]
        s = [(-len(grams(qt) & grams(t)) / len(grams(qt) | grams(t)), i) for i, _, t, _ in pool]
        want_v.update({(qid, k + 1): (i, x) for k, (x, i) in enumerate(d)})
        want_l.update({(qid, k + 1): (i, -x) for k, (x, i) in enumerate(sorted(y for y in s if -y[0] > 0.3)[:6])})
    hybrid = ret.hybrid_search(qd, cd, 4, by=by).collect()
    assert len({(r["query_id"], r["rnk"]) for r in hybrid}) == len(hybrid) == 80
    assert {k: v[0] for k, v in vec.items()} == {k: v[0] for k, v in want_v.items()}
    assert {k: (v[0], round(v[1], 12)) for k, v in lex.items()} == {k: (v[0], round(v[1], 12)) for k, v in want_l.items()}


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id bigint, id bigint, rnk int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id bigint, id bigint, rnk int")
    x = {r["id"]: r["rrf_score"] for r in ret.rrf(a, b).collect()}
    y = {r["id"]: r["rrf_score"] for r in ret.rrf(b, a).collect()}
    assert x == y and x[11] == 1 / 61 + 1 / 62 and x[10] == 1 / 61


def test_anomaly_context_only_sees_its_service(spark):
    an = spark.createDataFrame([("i1", "repo", "fp", "storeParcel failed"), ("i2", "other", "com.example x", " ")], "incident_id string, service string, fingerprint string, template string")
    out = ret.anomaly_context(an, code_rows(spark), lambda d: emb.embed(d, "text", dim=1536, out_col="vector")).collect()
    assert {(r["incident_id"], r["id"]) for r in out} == {("i1", 1), ("i1", 2), ("i2", 3)}


def test_stored_corpus_replaces_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "log_embeddings")
    first = spark.createDataFrame([(i, "LOGS", f"k{i}", f"t{i}", {}) for i in range(200)], REQ)
    emb.store_corpus(spark, path, first, "LOGS", emb.embed_requests(first, dim=4), buckets=8)
    files = {f for f in spark.read.parquet(path).inputFiles()}
    second = spark.createDataFrame([(500, "LOGS", "k3", "again", {}), (501, "LOGS", "k3", "last", {})], REQ)
    emb.store_corpus(spark, path, second, "LOGS", emb.embed_requests(second, dim=4), buckets=8)
    got = {r["fingerprint"]: r for r in spark.read.parquet(path).collect()}
    assert len(got) == 200 and (got["k3"]["content"], got["k3"]["sample_count"]) == ("last", 3) and got["k4"]["content"] == "t4"
    assert got["k3"]["embedding"] == [float(x) for x in fake_vectors(["last"], 4)[0]]
    assert len(files & set(spark.read.parquet(path).inputFiles())) >= 7


def test_vectors_and_times_outlive_batches_without_them(spark, tmp_path):
    path = str(tmp_path / "t")
    timed = spark.createDataFrame([(1, "LOGS", "k1", "a", {}, 100), (2, "LOGS", "k2", "b", {}, 200)], REQ + ", ts_us bigint")
    one = emb.embed_requests(timed, dim=3)
    emb.store_corpus(spark, path, timed, "LOGS", one, buckets=4)
    emb.store_corpus(spark, path, spark.createDataFrame([(3, "LOGS", "k1", "c", {})], REQ), "LOGS")
    emb.store_corpus(spark, path, spark.createDataFrame([(4, "LOGS", "k2", "d", {})], REQ), "LOGS", one.limit(0))
    got = {r["fingerprint"]: r for r in spark.read.parquet(path).collect()}
    for k, content, old, ts in (("k1", "c", "a", 100), ("k2", "d", "b", 200)):
        assert got[k]["content"] == content and got[k]["embedding"] == [float(x) for x in fake_vectors([old], 3)[0]]
        assert got[k]["last_seen_us"] == ts and got[k]["sample_count"] == 2


def test_a_store_without_vectors_takes_vectors(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([(1, "LOGS", "k", "a", {})], REQ)
    emb.store_corpus(spark, path, rows, "LOGS")
    emb.store_corpus(spark, path, rows, "LOGS", emb.embed_requests(rows, dim=2))
    assert [(r["sample_count"], len(r["embedding"])) for r in spark.read.parquet(path).collect()] == [(2, 2)]


def test_stored_table_is_never_taken_for_new(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([(i, "LOGS", f"k{i}", "a", {}) for i in range(20)], REQ)
    rows.write.parquet(path)
    with pytest.raises(ValueError):
        emb.store_corpus(spark, path, rows, "LOGS")
    assert spark.read.parquet(path).count() == 20
    other = str(tmp_path / "u")
    emb.store_corpus(spark, other, rows, "LOGS", buckets=4)
    with pytest.raises(ValueError):
        emb.store_corpus(spark, other, rows, "LOGS", buckets=8)
    emb.store_corpus(spark, other, rows, "LOGS")
    assert spark.read.parquet(other).count() == 20


def test_missing_vectors_rank_last(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<float>")
    c = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0, 0.0])], "id bigint, vector array<float>").coalesce(1)
    assert [r["id"] for r in ret.vector_topk(q, c, 4).orderBy("rnk").collect()] == [4, 3, 1, 2]
    assert [r["id"] for r in ret.vector_topk(q, c, 2).orderBy("rnk").collect()] == [4, 3]


def test_postings_equal_the_scan_and_touch_few_rows(spark, tmp_path):
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, line(rnd.randrange(1, 12)), "ab"[i % 2]) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " " + line(2), "a") for i in range(40)] + [(2000, None, "a"), (2001, "", "b"), (2002, "é!", None), (2003, "x y", "a")]
    asked = [(i, rows[i * 7][1], "ab"[i % 2]) for i in range(30)] + [(90, "", "a"), (91, None, "b"), (92, "é", None), (93, "zzzzz qqqqq", "a"), (94, "x", "a")]
    corpus = spark.createDataFrame(rows, "id bigint, content string, repo string")
    queries = spark.createDataFrame(asked, "query_id bigint, text string, repo string")
    for by in (None, "repo"):
        made = postings.build(corpus, by=by, heavy=25)
        postings.store(made, str(tmp_path / f"p{by}"), 4)
        index = postings.load(spark, str(tmp_path / f"p{by}"))
        got = {(r["query_id"], r["rnk"]): (r["id"], r["similarity"]) for r in postings.search(index, queries, 6, by).collect()}
        mine = queries.filter("repo IS NOT NULL") if by else queries
        want = {(r["query_id"], r["rnk"]): (r["id"], r["similarity"]) for r in ret.lexical_topk(mine, corpus, 6, by=by).collect()}
        got = {k: x for k, x in got.items() if not by or k[0] != 92}
        assert got == want and len(want) > 30
    # the pairs that meet are a small part of all, and the trigram of most rows lies in several parts
    assert postings.candidates(index, queries, "repo").count() < 0.2 * len(rows) * len(asked)
    assert index.grams.agg({"parts": "max"}).first()[0] > 1


def test_postings_are_settled_where_they_lie(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé𝄞ß") for _ in range(rnd.randrange(1, 6))) for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 9, 40])))) for i in range(200)] + [(500, rnd.choice(words))]
    corpus = spark.createDataFrame(rows, "id bigint, content string")
    queries = spark.createDataFrame([(i, rows[i * 5][1]) for i in range(40)], "query_id bigint, text string")
    want = {tuple(r) for r in ret.lexical_topk(queries, corpus, 7).collect()}
    postings.store(postings.build(corpus, heavy=40), str(tmp_path / "p"), 5)
    monkeypatch.setattr(postings, "WAVE_ROWS", 9)
    monkeypatch.setattr(postings, "COMMON", 30)  # most trigrams stand by their number then
    found = postings.search(postings.load(spark, str(tmp_path / "p")), queries, 7)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100
    # nothing is joined: a pair's two sets never travel
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_spread_does_not_run_the_shuffle_it_counts(spark):
    from opslens.session import spread, stored

    joined = spark.range(1000).repartition(3).join(spark.range(500).hint("merge"), "id")
    spark.sparkContext.setJobGroup("spread", "spread")
    try:
        df = spread(joined)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("spread")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert df.count() == 500 and stored(df, "rows").count() == 500
