"""Embedding requests: consolidate by content, embed the misses, upsert the three corpora."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.kernels import fake_vectors
from opslens.functions.text import content_hash
from opslens.operators.retrieve import corpus_view
from opslens.operators.ttl import cache_hits
from opslens.sources.tables import upsert_table

DIMENSION = 1536
EMBED_TTL_SECONDS = 604_800
POLL_ROWS = 32

Embedder = Callable[[list[str], int], np.ndarray]

# key columns of each corpus
CORPUS_KEYS = {
    "LOGS": ("fingerprint",),
    "CODE": ("repo", "git_sha", "file_path", "fqn"),
    "INCIDENTS": ("incident_id",),
}


def with_hash(df: DataFrame) -> DataFrame:
    return df if "content_hash" in df.columns else df.withColumn("content_hash", content_hash(F.col("text")))


def dedupe_requests(df: DataFrame, batch: Column | None = None) -> DataFrame:
    """One row per distinct text (within ``batch`` if given) with its request count and first request.

    Equal texts meet in the map-side aggregate first, so a text that makes up a third of the requests
    travels once per task.
    """
    keys = ["content_hash"] if batch is None else ["batch_id", "content_hash"]
    src = with_hash(df.filter(F.col("text").isNotNull()))
    if batch is not None:
        src = src.withColumn("batch_id", batch)
    return src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_requests"), F.min("seq").alias("first_seq"), F.any_value("text").alias("text")
    )


def savings(df: DataFrame, batch: Column, ttl_s: int = EMBED_TTL_SECONDS) -> DataFrame:
    """Requests, distinct texts, per-batch texts and the calls left after batch and cache."""
    src = with_hash(df.filter(F.col("text").isNotNull())).select("seq", "content_hash", "ts_us", batch.alias("batch_id"))
    base = src.agg(F.count(F.lit(1)).alias("requests"))
    texts = src.groupBy("content_hash").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("distinct_texts"))
    per_batch = src.groupBy("batch_id", "content_hash").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("batch_texts"))
    calls = cache_hits(src, "content_hash", ttl_s, row_id="seq").filter("NOT is_hit").agg(F.count(F.lit(1)).alias("model_calls"))
    stacked = [base.select(F.lit(i).alias("i"), F.col(base.columns[0]).alias("n")) for i, base in enumerate((base, texts, per_batch, calls))]
    u = stacked[0]
    for s in stacked[1:]:
        u = u.unionByName(s)
    pick = lambda i: F.max(F.when(F.col("i") == i, F.col("n")))
    return u.agg(
        pick(0).alias("requests"), pick(1).alias("distinct_texts"), pick(2).alias("batch_texts"), pick(3).alias("model_calls")
    ).withColumn("saved_share", F.lit(1.0) - F.col("model_calls").cast("double") / F.nullif(F.col("requests"), F.lit(0)).cast("double"))


def request_cache_hits(df: DataFrame, ttl_s: int = EMBED_TTL_SECONDS) -> DataFrame:
    """Requests that find their vector in the cache; the write starts the lifetime, a hit does not renew it."""
    return cache_hits(with_hash(df.filter(F.col("text").isNotNull())), "content_hash", ttl_s, row_id="seq")


def lookup_vectors(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts left-joined to the vector cache; ``cached`` tells the outcome."""
    c = cache.select("content_hash", F.col("embedding"), F.lit(True).alias("_c"))
    return df.join(c, "content_hash", "left").withColumn("cached", F.coalesce("_c", F.lit(False))).drop("_c")


def embed(df: DataFrame, text_col: str = "text", fn: Embedder = fake_vectors, dim: int = DIMENSION,
          out_col: str = "embedding") -> DataFrame:
    """Adds a vector per row through the user's batch function; Arrow batches in and out."""
    schema = df.withColumn(out_col, F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.ascontiguousarray(fn(b[text_col].to_pylist(), dim), dtype=np.float32)
            offsets = pa.array(np.arange(0, m.size + 1, dim), type=pa.int32()) if dim else None
            vec = pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1), type=pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, vec], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, schema)


def embed_requests(df: DataFrame, cache: DataFrame | None = None, fn: Embedder = fake_vectors, dim: int = DIMENSION) -> DataFrame:
    """(content_hash, embedding) of every distinct text: cached ones looked up, the rest computed once."""
    distinct = dedupe_requests(df)
    if cache is None:
        return embed(distinct.select("content_hash", "text"), "text", fn, dim).select("content_hash", "embedding")
    found = lookup_vectors(distinct.select("content_hash", "text"), cache)
    hits = found.filter("cached").select("content_hash", "embedding")
    fresh = embed(found.filter("NOT cached").select("content_hash", "text"), "text", fn, dim)
    return hits.unionByName(fresh.select("content_hash", "embedding"))


def corpus_requests(df: DataFrame, corpus: str) -> DataFrame:
    """Requests of one corpus with its key columns. Corpus names are case-blind."""
    corpus_view(corpus)
    src = with_hash(df.filter(F.upper("corpus") == corpus.upper()))
    if corpus.upper() == "LOGS":
        return src.withColumn("fingerprint", F.coalesce("content_id", "content_hash"))
    if corpus.upper() == "CODE":
        for k in CORPUS_KEYS["CODE"]:
            src = src.withColumn(k, F.try_element_at("metadata", F.lit(k)))
        return src
    return src.withColumn("incident_id", F.col("content_id"))


def split_keyless(df: DataFrame, corpus: str) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined): a request without a full key cannot be stored."""
    ok = F.lit(True)
    for k in CORPUS_KEYS[corpus.upper()]:
        ok = ok & F.col(k).isNotNull()
    return df.filter(ok), df.filter(~ok)


def unknown_corpus(df: DataFrame) -> DataFrame:
    """Requests that name no known corpus."""
    return df.filter(~F.coalesce(F.upper("corpus").isin(*CORPUS_KEYS), F.lit(False)))


def reduce_requests(df: DataFrame, corpus: str) -> DataFrame:
    """The net effect of a batch on each key: last text and hash win, requests are counted, the last time is kept."""
    keys = CORPUS_KEYS[corpus.upper()]
    usable, _ = split_keyless(corpus_requests(df, corpus), corpus)
    if "ts_us" not in usable.columns:
        usable = usable.withColumn("ts_us", F.lit(None).cast("bigint"))
    last = F.max(F.struct("seq", "text", "content_hash")).alias("l")
    return usable.groupBy(*keys).agg(last, F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last_seen_us")).select(
        *keys, F.col("l.text").alias("content"), F.col("l.content_hash").alias("content_hash"),
        F.col("l.seq").alias("seq"), F.col("n").alias("sample_count"), "last_seen_us",
    )


def upsert_corpus(existing: DataFrame | None, new: DataFrame, corpus: str, vectors: DataFrame | None = None) -> DataFrame:
    """The corpus after a batch of requests.

    The batch is reduced to one row per key before vectors are attached, so a hot text or key meets the
    join once. LOGS keeps counting; CODE keeps its stored content (only the vector is replaced). A batch
    without vectors, or a request whose vector is missing, leaves the stored vector as it is.
    """
    return merge_corpus(existing, batch_rows(new, corpus, vectors), corpus)


def batch_rows(new: DataFrame, corpus: str, vectors: DataFrame | None = None) -> DataFrame:
    """A batch of requests as rows of its corpus, one per key."""
    batch = reduce_requests(new, corpus)
    if vectors is not None:
        batch = batch.join(vectors, "content_hash", "left")
    return batch.withColumn("content", F.lit(None).cast("string")) if corpus.upper() == "CODE" else batch


def merge_corpus(existing: DataFrame | None, batch: DataFrame, corpus: str) -> DataFrame:
    """Stored rows and batch rows as one row per key; either side may lack vectors or times."""
    keys = list(CORPUS_KEYS[corpus.upper()])
    if existing is None:
        both = batch
    else:
        both = existing.unionByName(batch, allowMissingColumns=True)
    if "last_seen_us" not in both.columns:
        both = both.withColumn("last_seen_us", F.lit(None).cast("bigint"))
    vector = ["embedding"] if "embedding" in both.columns else []
    carried = ["content", "content_hash", "seq", "sample_count", "last_seen_us", *vector]
    if existing is None:
        return both.select(*keys, *carried)
    last = F.max_by(F.struct("content", "content_hash", "seq"), F.col("seq")).alias("l")
    newest = [F.expr("max_by(embedding, seq) FILTER (WHERE embedding IS NOT NULL)").alias(x) for x in vector]
    out = both.groupBy(*keys).agg(last, F.sum("sample_count").alias("sample_count"), F.max("content").alias("_any"),
                                  F.max("last_seen_us").alias("last_seen_us"), *newest)
    content = F.col("_any") if corpus.upper() == "CODE" else F.col("l.content")
    return out.select(*keys, content.alias("content"), F.col("l.content_hash").alias("content_hash"),
                      F.col("l.seq").alias("seq"), "sample_count", "last_seen_us", *vector)


def store_corpus(spark: SparkSession, path: str, new: DataFrame, corpus: str, vectors: DataFrame | None = None,
                 buckets: int | None = None) -> None:
    """Upsert a batch of requests into the stored corpus at ``path``."""
    rows = batch_rows(new, corpus, vectors)
    upsert_table(spark, path, rows, CORPUS_KEYS[corpus.upper()], lambda old, b: merge_corpus(old, b, corpus), buckets)


def known_incidents(df: DataFrame, incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose incident exists, rows to quarantine)."""
    i = incidents.select("incident_id")
    return df.join(i, "incident_id", "left_semi"), df.join(i, "incident_id", "left_anti")


def corpus_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.upper("corpus").alias("corpus")).agg(F.count(F.lit(1)).alias("processed"))
