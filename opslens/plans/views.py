"""Log-shaped views over the driver's tables. Each reads a whole table; none filters or samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. The pattern lets it be one file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as log entries: every fifth row is bare text, the rest Java log lines."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "concat('svc-', user_id % 3) AS service",
        "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level",
        "cast(ts AS timestamp) AS occurred_at",
        """concat(
             CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(
               date_format(cast(ts AS timestamp), 'yyyy-MM-dd HH:mm:ss'), ' ',
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END,
               ' [worker-', event_id % 8, '] c.p.Service : ') END,
             CASE event_type
               WHEN 'error' THEN concat('Connection failed to 10.0.', user_id % 256, '.', event_id % 256,
                                        ':5432 after ', event_id % 5000, 'ms')
               WHEN 'purchase' THEN concat('order 7e36b7b0-0000-4000-8000-', lpad(hex(event_id), 12, '0'), ' paid')
               WHEN 'signup' THEN concat('session 0x', lower(hex(event_id)), ' opened for user ', user_id)
               WHEN 'click' THEN concat('user ', user_id, ' clicked item ', event_id % 100)
               ELSE concat('page rendered in ', event_id % 900, 's') END) AS message""",
        "CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('trace-', event_id % 1000) END AS trace_id",
        """CASE WHEN user_id % 4 = 3 THEN map('k', get_json_object(props, '$.k'))
                ELSE map('k', get_json_object(props, '$.k'), 'tenantId', concat('tenant-', user_id % 4)) END AS metadata""",
        "props",
    )


def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.sources.logs import preprocess

    return preprocess(logs(spark, sf_dir))


def event_keys(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The five columns the detector reads, with the event kind as fingerprint: no text work."""
    return (table(spark, sf_dir, "events") if events is None else events).select(
        "event_id",
        F.expr("concat('svc-', user_id % 3)").alias("service"),
        F.col("event_type").alias("fingerprint"),
        F.expr("CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END").alias("level"),
        F.expr("cast(ts AS timestamp)").alias("occurred_at"),
    )


def doc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as free-text log entries; a toxic label makes an ERROR."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("event_id"), F.col("source").alias("service"),
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "ERROR").otherwise("INFO").alias("level"),
        F.col("text").alias("message"), "lang",
    )


def records(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events`` as topic records: sound envelopes, broken JSON, and envelopes that break one rule each."""
    return (table(spark, sf_dir, "events") if events is None else events).selectExpr(
        "concat('svc-', user_id % 3) AS key",
        """CASE event_id % 10
             WHEN 0 THEN concat('{not-valid-json ', event_id)
             WHEN 1 THEN concat('{"schema":"logs.raw.v1","messageId":"m-', event_id, '","occurredAt":', 1704067200 + event_id,
                                ',"producedAt":1,"traceId":"t","tenantId":"d"}')
             ELSE concat('{"schema":"logs.raw.v1","messageId":"m-', event_id, '","occurredAt":', 1704067200 + event_id,
                         ',"producedAt":"2024-02-01T00:00:00Z","traceId":"', CASE event_id % 10 WHEN 3 THEN '' ELSE concat('t', event_id) END,
                         '","tenantId":', CASE event_id % 10 WHEN 4 THEN '7' ELSE concat('"tenant-', user_id % 4, '"') END,
                         ',"payload":{', CASE event_id % 10 WHEN 2 THEN '' ELSE concat('"service":"svc-', user_id % 3, '",') END,
                         '"level":"', CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END,
                         '","message":"', event_type, ' ', event_id, '","metadata":{"tenantId":"tenant-', user_id % 4, '"}}}') END AS value""",
        "'logs.raw' AS topic", "cast(event_id % 3 AS int) AS partition", "event_id div 3 AS offset",
        "cast(ts AS timestamp) AS timestamp",
    )


def dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as dead letters of three topics."""
    return table(spark, sf_dir, "events").selectExpr(
        """CASE event_type WHEN 'click' THEN 'logs.preprocessed.dlq' WHEN 'purchase' THEN 'tickets.new.dlq'
                           ELSE 'logs.raw.dlq' END AS topic""",
        "cast(event_id % 3 AS int) AS partition", "event_id div 3 AS offset",
        "concat('k', user_id) AS key", "props AS value",
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with the vector of the same id; those without one are found by their words only."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    return d.join(e, F.col("vec_id") == F.col("doc_id"), "left").select(
        F.col("doc_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("bigint").alias("label"),
        F.col("text").alias("content"), "source", "lang",
    )


def label_queries(corpus_df: DataFrame) -> DataFrame:
    """One query per label: the mean vector of its rows and the text of its earliest row."""
    corpus_df = corpus_df.filter("label IS NOT NULL")
    dims = corpus_df.select("label", F.posexplode("vector")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("v"))
    mean = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("vector"))
    words = corpus_df.groupBy("label").agg(F.min_by("content", "id").alias("text"))
    return mean.join(words, "label").withColumnRenamed("label", "query_id")


def code_corpus(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """``corpus`` as code rows; every ninth has no stored content."""
    c = corpus(spark, sf_dir) if rows is None else rows
    return c.select(
        "id", "vector", F.concat(F.lit("svc-"), F.col("label") % 3).alias("repo"), F.lit("sha").alias("git_sha"),
        F.concat(F.lit("src/"), F.col("source"), F.lit(".java")).alias("file_path"),
        F.concat(F.lit("com.example.C"), F.col("id")).alias("fqn"),
        F.when(F.col("id") % 9 != 0, F.col("content")).alias("content"),
    )


def embed_requests(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """``documents`` as embedding requests, one an hour."""
    return (table(spark, sf_dir, "documents") if documents is None else documents).selectExpr(
        "doc_id AS seq", "text", "CASE doc_id % 3 WHEN 0 THEN 'LOGS' WHEN 1 THEN 'code' ELSE 'INCIDENTS' END AS corpus",
        """CASE doc_id % 3 WHEN 2 THEN concat('inc-', doc_id % 50) ELSE CASE WHEN doc_id % 2 = 0 THEN source END END AS content_id""",
        """map('repo', source, 'git_sha', lang, 'file_path', concat('f', doc_id % 7),
               'fqn', CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('c', doc_id % 5) END) AS metadata""",
        "1704067200000000 + doc_id * 3600000000 AS ts_us",
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as model calls: one conversation an hour, one turn a minute, and each text asked three times:
    again after five hours, within a day's lifetime, and once more after thirty."""
    return table(spark, sf_dir, "conversations").withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).selectExpr(
        "(conv_id * 1000 + turn) * 3 + k AS call_id",
        "text AS prompt",
        "concat('agent-', turn % 3) AS agent",
        "CASE (conv_id + turn) % 4 WHEN 0 THEN 'TINY' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'MEDIUM' ELSE 'LARGE' END AS tier",
        "CASE WHEN (conv_id + turn + 2 * k) % 7 = 0 THEN 'FAILED' ELSE 'OK' END AS status",
        "cast(length(text) div 4 AS bigint) AS est_tokens",
        "cast(length(text) div 4 + turn % 3 AS bigint) AS tokens_in",
        "cast(length(text) div 8 + 5 AS bigint) AS tokens_out",
        "conv_id * 3600 + turn * 60 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 18000 ELSE 108000 END AS sec",
        "text",
    ).withColumn("ts_us", F.expr("1704067200000000 + sec * 1000000")).withColumn("ts", F.timestamp_micros("ts_us")).drop("sec")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five findings per document; layers and confidences by arithmetic so that both gates are met and missed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    roles = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(r).alias("role")) for i, r in enumerate(ROLES)])
    return d.withColumn("r", F.explode(roles)).selectExpr(
        "concat('inc-', doc_id) AS incident_id", "doc_id", "r.role AS role",
        "CASE (doc_id + r.i * r.i) % 3 WHEN 0 THEN 'NullPointerException' WHEN 1 THEN 'TimeoutException' ELSE 'SQLException' END AS error_type",
        "CASE WHEN (doc_id * 7 + r.i * r.i) % 5 < 2 THEN 'APPLICATION' WHEN (doc_id * 7 + r.i * r.i) % 5 < 4 THEN 'DATA_ACCESS' ELSE 'INFRASTRUCTURE' END AS layer",
        "array(concat(source, '.java'), concat('R', r.i, '.java')) AS suspected_files",
        "((doc_id * 13 + r.i * 29) % 100) / 100.0D * CASE WHEN doc_id % 10 = 3 THEN 0.25D ELSE 1.0D END AS confidence",
        "concat(lang, ' view ', r.i) AS rationale",
    )


ROLES = ("Backend Engineer", "DevOps Engineer", "Frontend Engineer", "Full Stack Engineer", "System Analyst")


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opslens.operators.consensus import consensus

    return consensus(findings(spark, sf_dir))


def eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: suggested and expected files, and the expected layer."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat('inc-', doc_id) AS incident_id",
        "transform(sequence(0, cast(doc_id % 8 AS int)), i -> concat('f', (doc_id + i * i) % 9)) AS suggested",
        "transform(sequence(0, cast(doc_id % 4 AS int)), i -> concat('f', (doc_id + i * 2) % 9)) AS expected_files",
        "CASE doc_id % 3 WHEN 0 THEN 'application' ELSE 'DATA_ACCESS' END AS expected_layer",
    )
