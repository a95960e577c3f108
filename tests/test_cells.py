import numpy as np
import pytest

from opslens.operators import cells
from opslens.operators import retrieve as ret

ROW, ASK = "id bigint, vector array<float>", "query_id bigint, vector array<float>"


def found(df):
    return {(r["query_id"], r["rnk"]): (r["id"], None if r["distance"] != r["distance"] else r["distance"]) for r in df.collect()}


def clustered(rng, groups, each, dim=16, noise=0.03):
    middle = rng.normal(size=(groups, dim))
    return np.repeat(middle, each, axis=0) + noise * rng.normal(size=(groups * each, dim))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    m = np.vstack([clustered(rng, 20, 100), rng.normal(size=(200, 16))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(5000 + i, rows[3][1]) for i in range(700)]  # a third of copies: ties, and a shell in several pieces
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] + [1.0] * 15)]
    asked = [(i, rows[i * 37][1]) for i in range(40)] + [(100 + i, [float(x) for x in rng.normal(size=16)]) for i in range(10)]
    asked += [(200, None), (201, [0.0] * 16), (202, [-x for x in rows[3][1]])]
    return rows, asked


def test_cells_equal_the_scan(spark, tmp_path, data):
    rows, asked = data
    corpus, queries = spark.createDataFrame(rows, ROW).repartition(4), spark.createDataFrame(asked, ASK)
    want = found(ret.vector_topk(queries, corpus, 6))
    cells.store(cells.build(corpus, cells=24, heavy=150), str(tmp_path / "v"))
    assert found(cells.search(cells.load(spark, str(tmp_path / "v"), heavy=150), queries, 6)) == want
    # the centres decide what is read, not what is found
    assert found(cells.search(cells.build(corpus, cells=1), queries, 6)) == want
    assert found(cells.search(cells.build(corpus, cells=5, sample_rows=9, heavy=90), queries, 6)) == want


def test_queries_of_a_shell_go_in_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(cells, "QUERY_BLOCK", 3)
    rows, asked = data
    corpus, queries = spark.createDataFrame(rows, ROW), spark.createDataFrame(asked, ASK)
    assert found(cells.search(cells.build(corpus, cells=8), queries, 3)) == found(ret.vector_topk(queries, corpus, 3))


def test_few_rows_are_read_where_vectors_lie_in_groups(spark):
    m = clustered(np.random.default_rng(9), 40, 100, dim=32)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], ROW)
    queries = spark.createDataFrame([(i, m[i * 80].tolist()) for i in range(50)], ASK)
    index = cells.build(corpus, cells=60)
    shares = [r["share"] for r in cells.share_read(index, queries, 10).collect()]
    assert len(shares) == 50 and max(shares) < 0.1


def test_small_and_empty_corpora(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], ASK)
    for rows in ([], [(7, None), (8, [0.0, 0.0])], [(7, None), (5, [0.0, 0.0]), (9, [1.0, 1.0]), (8, [-1.0, 0.0])]):
        corpus = spark.createDataFrame(rows, ROW)
        assert found(cells.search(cells.build(corpus), asked, 3)) == found(ret.vector_topk(asked, corpus, 3)), rows
    none = spark.createDataFrame([], ASK)
    assert cells.search(cells.build(spark.createDataFrame([(1, [1.0])], ROW)), none, 3).count() == 0


def test_second_round_sends_chunks_not_shells(spark, monkeypatch):
    """On vectors without groups every query needs nearly every shell; what goes out is a copy for each chunk at most."""
    m = np.random.default_rng(3).normal(size=(600, 16))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], ROW)
    queries = corpus.withColumnsRenamed({"id": "query_id"})
    index, held, kept = cells.build(corpus, cells=40, heavy=200), [], cells.cut_lineage
    monkeypatch.setattr(cells, "cut_lineage", lambda df: held.append(df := kept(df)) or df)
    got = found(cells.search(index, queries, 5))
    # no table of the search holds more than a few rows for each query, where each needs some hundred shells
    assert max(df.count() for df in held) < 12 * 600
    assert got == found(ret.vector_topk(queries, corpus, 5))


def test_waves_of_vectors_go_out_in_one_job(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)] + [(400 + i, None) for i in range(3)] + [(410, [0.0] * 4)]
    corpus = spark.createDataFrame(rows, ROW).repartition(3)
    queries = corpus.withColumnsRenamed({"id": "query_id"})
    waves, kept = [], ret.cut_lineage
    monkeypatch.setattr(ret, "cut_lineage", lambda df: waves.append(1) or kept(df))
    got = found(ret.vector_topk(queries, corpus, 5, wave_rows=20))
    assert not waves  # before: one written for each wave
    assert len(got) == 304 * 5 and got == found(ret.vector_topk(queries, corpus, 5))
    monkeypatch.setattr(ret, "GRID_ROWS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # blocks lie in several partitions
    try:
        assert found(ret.vector_topk(queries, corpus, 5, wave_rows=20)) == got
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
