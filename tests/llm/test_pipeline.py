import random

import corpus_pipeline
import __spark_entry__ as entry
from opslens.llm import decontaminate, packing, pii
from opslens.llm import queries
from tests.llm.data import awkward, documents, prose


def test_every_operator_has_its_query():
    assert sorted({n.split("_")[0] for n in queries.QUERIES}, key=lambda x: int(x[2:])) == [f"op{i}" for i in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_dedup", "decontamination", "pii", "packing"]


def tables(spark, path):
    rnd = random.Random(9)
    item = prose(rnd, 20)
    rows = []
    for i in range(200):
        words = prose(rnd, 80).split()
        if i % 5 == 0:
            words[40:44] = ["grumblefoot", "snarkface", "grumblehead", "snarkface"]
        rows.append((i, " ".join(words)))
    rows += [(500 + k, rows[1][1] + " end") for k in range(3)]
    rows += [(600, f"{prose(rnd, 30)} {item} {prose(rnd, 30)}"), (700, f"{prose(rnd, 40)} mail me at some.one@mail.example.com")]
    rows += [(800 + k, t) for k, (_, t) in enumerate(awkward())]
    documents(spark, rows).drop("score").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, item


def test_stages_take_effect(spark, tmp_path):
    rows, item = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        after.append({r["doc_id"]: r["text"] for r in docs.collect()})
    clean = {i for i in range(200) if i % 5}
    assert clean | {500, 600, 700} <= set(after[0]) and not set(range(0, 200, 5)) & set(after[0])
    assert not {500, 501, 502} & set(after[1]) and clean <= set(after[1])
    assert set(after[1]) - set(after[2]) == {600}
    assert "some.one@" not in after[3][700] and "[EMAIL]" in after[3][700]
    assert all(after[3][i] == after[0][i] for i in clean)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = packing.pack(docs).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert {r["doc_id"] for r in got} == set(after[3])
    assert sum(r["length"] for r in got) == sum(r["length"] for r in want) and sorted(
        {(r["doc_id"], r["doc_tokens"]) for r in got}) == sorted({(r["doc_id"], r["doc_tokens"]) for r in want}), key
    assert decontaminate.normal(item) not in {decontaminate.normal(t or "") for t in after[3].values()} and pii.KINDS


def test_empty_tables(spark, tmp_path):
    documents(spark, []).drop("score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
