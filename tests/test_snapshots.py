import pytest
from pyspark.sql import functions as F

from opslens.operators import metrics as met
from opslens.sources.snapshots import ConcurrentWrite, Snapshot


def newest(old, batch):
    if old is None:
        return batch
    return batch.unionByName(old.join(batch.select("k"), "k", "left_anti"), allowMissingColumns=True)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def made(spark, tmp_path):
    t = Snapshot(spark, str(tmp_path / "t"), ["k"], buckets=4)
    assert t.read() is None and t.vacuum() == 0
    assert t.upsert(spark.createDataFrame([(i, "a") for i in range(20)] + [(None, "none")], "k long, v string"), newest, epoch=0)
    return t


def test_a_write_that_stops_before_the_swap_is_not_seen(spark, made):
    before, change = rows(made.read()), spark.createDataFrame([(3, "b"), (100, "b")], "k long, v string")

    def stop():
        assert rows(made.read()) == before
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        made.upsert(change, newest, epoch=1, before_swap=stop)
    assert rows(made.read()) == before and made.versions() == [0]
    assert made.upsert(change, newest, epoch=1)
    want = sorted([r for r in before if r[0] != 3] + [(3, "b"), (100, "b")], key=repr)
    assert rows(made.read()) == want
    assert rows(made.read(0)) == before
    # the folder of the stopped write and the buckets replaced since
    assert made.vacuum() >= 1 and rows(made.read()) == want and made.versions() == [1]


def test_a_replayed_epoch_changes_nothing(spark, made):
    change = spark.createDataFrame([(3, "b")], "k long, v string")
    assert made.upsert(change, newest, epoch=1) and not made.upsert(spark.createDataFrame([(3, "c")], "k long, v string"), newest, epoch=1)
    assert (3, "b") in rows(made.read()) and made.versions() == [0, 1]


def test_of_two_writers_one_gives_way(spark, made):
    mine, theirs = (spark.createDataFrame([(k, "x")], "k long, v string") for k in (1, 2))
    with pytest.raises(ConcurrentWrite):
        made.upsert(mine, newest, before_swap=lambda: made.upsert(theirs, newest))
    got = dict(rows(made.read()))
    assert got[2] == "x" and got[1] == "a"
    assert made.upsert(mine, newest) and dict(rows(made.read()))[1] == "x"


def test_buckets_that_empty_and_columns_that_come(spark, made):
    gone = spark.createDataFrame([(i, "") for i in range(20)], "k long, v string")
    assert made.upsert(gone, lambda old, b: old.join(b.select("k"), "k", "left_anti"))
    assert rows(made.read()) == [(None, "none")]
    assert made.upsert(spark.createDataFrame([(7, "w", 1.5)], "k long, v string, more double"), newest)
    assert rows(made.read()) == sorted([(None, "none", None), (7, "w", 1.5)], key=repr)
    assert made.upsert(spark.createDataFrame([], "k long, v string, more double"), newest)
    with pytest.raises(ValueError):
        Snapshot(spark, made.path, ["k"], buckets=8).upsert(gone, newest)


def test_sketches_merge_over_any_range(spark):
    df = spark.range(200_000).select((F.col("id") % 7).alias("k"), (F.col("id") * 1_000_003 % 100_000).alias("ms"), (F.col("id") * 50_000).alias("ts_us"))
    stored = met.latency_sketches(df, "ms", ["k"])
    assert stored.count() > 7 * 100
    for lo in (0, 4800):
        part = df.filter(F.col("ts_us") >= lo * 1_000_000)
        for r in met.merged_percentiles(stored.filter(F.col("slot_s") >= lo), ["k"]).collect():
            own = part.filter(F.col("k") == r["k"]) if r["k"] == 0 else None
            if own is not None:
                assert r["cnt"] == own.count()
                assert abs(own.filter(F.col("ms") <= r["p95"]).count() / r["cnt"] - 0.95) < 0.01
    texts = met.distinct_sketches(df, "ms", ["k"])
    got = met.merged_distinct(texts, ["k"]).filter("k = 0").first()
    assert got["rows"] == df.filter("k = 0").count() and abs(got["distinct_est"] / df.filter("k = 0").select("ms").distinct().count() - 1) < 0.03
