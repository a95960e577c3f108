"""Message envelopes: wrap, check, decode, dead-letter, replay; batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.functions import ids

# Schema names, topics and header names on the wire.
RAW_SCHEMA = "logs.raw.v1"
PREPROCESSED_SCHEMA = "logs.preprocessed.v1"
TICKETS_SCHEMA = "tickets.new.v1"
RAW_TOPIC = "logs.raw"
PREPROCESSED_TOPIC = "logs.preprocessed"
TICKETS_TOPIC = "tickets.new"
DLQ_TOPICS = ("logs.raw.dlq", "logs.preprocessed.dlq", "tickets.new.dlq")
MAX_ERROR_CHARS = 900

_TEXT = T.StringType()
LOG_ENTRY = T.StructType(
    [T.StructField(n, _TEXT) for n in ("service", "level", "message", "stackTrace", "traceId", "spanId", "occurredAt")]
    + [T.StructField("metadata", T.MapType(_TEXT, _TEXT))]
)
RECORD_SCHEMA = T.StructType(
    [T.StructField(n, _TEXT) for n in ("key", "value", "topic")]
    + [
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def envelope_schema(payload: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("schema", T.StringType()),
            T.StructField("messageId", T.StringType()),
            T.StructField("occurredAt", T.StringType()),
            T.StructField("producedAt", T.StringType()),
            T.StructField("traceId", T.StringType()),
            T.StructField("tenantId", T.StringType()),
            T.StructField("payload", payload),
        ]
    )


def iso(ts: Column) -> Column:
    return F.date_format(ts, _TIME_FORMAT)


def log_entry(df: DataFrame) -> Column:
    """The log columns of ``df`` as the payload struct; absent columns are null."""
    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    return F.struct(
        F.col("service").alias("service"), F.col("level").alias("level"), F.col("message").alias("message"),
        col("stack_trace").alias("stackTrace"), col("trace_id").alias("traceId"), col("span_id").alias("spanId"),
        iso(F.col("occurred_at")).alias("occurredAt"), col("metadata", "map<string,string>").alias("metadata"),
    )


def to_envelope(
    df: DataFrame,
    schema_id: str,
    key_col: str,
    payload: Column | None = None,
    default_tenant: str = ids.DEFAULT_TENANT,
    message_id: Column | None = None,
    produced_at: Column | None = None,
    trace: Column | None = None,
    tenant: Column | None = None,
) -> DataFrame:
    """Records (key, value, headers) of one topic.

    Message id and produce time default to fresh ones, which is right at a sink only; pass columns where
    a re-run must give the same records.
    """
    if trace is None:
        trace = ids.resolve_trace(F.lit(None).cast("string"), F.col("trace_id") if "trace_id" in df.columns else F.lit(None).cast("string"))
    if tenant is None:
        tenant = ids.resolve_tenant(F.col("metadata"), default_tenant) if "metadata" in df.columns else F.lit(default_tenant)
    staged = df.select(
        F.col(key_col).cast("string").alias("key"),
        F.lit(schema_id).alias("schema"),
        (message_id if message_id is not None else F.uuid()).alias("messageId"),
        iso(F.col("occurred_at")).alias("occurredAt"),
        iso(produced_at if produced_at is not None else F.current_timestamp()).alias("producedAt"),
        trace.alias("traceId"), tenant.alias("tenantId"),
        (payload if payload is not None else log_entry(df)).alias("payload"),
    )
    body = F.struct("schema", "messageId", "occurredAt", "producedAt", "traceId", "tenantId", "payload")
    return staged.select("key", F.to_json(body).alias("value"), headers(F.col("traceId"), F.col("tenantId")).alias("headers"))


def headers(trace: Column, tenant: Column) -> Column:
    """Trace and tenant as record headers, each only when it has a value."""
    def one(name: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.lit(name).alias("key"), F.encode(c, "UTF-8").alias("value")))

    return F.array_compact(F.array(one("traceId", trace), one("tenantId", tenant)))


def valid_envelope(value: Column) -> Column:
    """Contract check of a raw JSON value: seven fields present, texts non-empty, times text or number."""
    v = F.try_parse_json(value)
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID"))

    def text(name: str) -> Column:
        return (kind(name) == "STRING") & (F.length(F.coalesce(F.get_json_object(value, f"$.{name}"), F.lit(""))) > 0)

    def when(name: str) -> Column:
        return kind(name).rlike("^(STRING|BIGINT|DECIMAL.*|DOUBLE)$")

    ok = F.array_contains(keys, "payload")
    for name in ("schema", "messageId", "traceId", "tenantId"):
        ok = ok & text(name)
    for name in ("occurredAt", "producedAt"):
        ok = ok & when(name)
    return F.coalesce(ok & v.isNotNull(), F.lit(False))


def wire_time(c: Column) -> Column:
    """Instant from RFC-3339 text or epoch seconds."""
    return F.coalesce(F.try_to_timestamp(c), F.timestamp_seconds(c.try_cast("double")))


def decode(df: DataFrame, payload: T.DataType = LOG_ENTRY) -> DataFrame:
    """Record columns plus ``env`` (decoded envelope) and ``decode_error`` (null when it decoded).

    The decoded value goes through a one-row explode: filters on it then stay above, where a plain column
    would be parsed again inside every filter that is pushed down.
    """
    schema = envelope_schema(payload).add("_corrupt", T.StringType())
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    out = df.select("*", F.explode(F.array(F.from_json(F.col("value").cast("string"), schema, opts))).alias("env"))
    error = (
        F.when(F.col("value").isNull(), F.lit("EmptyValue"))
        .when(F.col("env").isNull() | F.col("env._corrupt").isNotNull(), F.lit("MalformedJson"))
        .when(F.col("env.payload").isNull(), F.lit("MissingPayload"))
    )
    return out.withColumn("decode_error", error)


def split_poison(df: DataFrame, required: tuple[str, ...] = ("service", "level", "message")) -> tuple[DataFrame, DataFrame]:
    """(good, dead-letter) of a decoded record frame.

    Dead letters keep key, value and partition, and say why and from where in their headers.
    """
    missing = F.lit(None).cast("string")
    for name in reversed(required):
        missing = F.when(F.col(f"env.payload.{name}").isNull(), F.lit(f"MissingField:{name}")).otherwise(missing)
    marked = df.withColumn("decode_error", F.coalesce("decode_error", missing))
    good = marked.filter(F.col("decode_error").isNull()).drop("decode_error")
    return good, dead_letters(marked.filter(F.col("decode_error").isNotNull()))


def dead_letters(df: DataFrame) -> DataFrame:
    def header(name: str, c: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), F.encode(c, "UTF-8").alias("value"))

    added = F.array(
        header("x-error-class", F.split_part(F.col("decode_error"), F.lit(":"), F.lit(1))),
        header("x-error-message", F.substring(F.concat(F.col("decode_error"), F.lit(" in "), F.coalesce(F.col("value").cast("string"), F.lit("null"))), 1, MAX_ERROR_CHARS)),
        header("x-error-original-topic", F.col("topic")),
        header("x-error-original-partition", F.col("partition").cast("string")),
        header("x-error-original-offset", F.col("offset").cast("string")),
    )
    old = F.coalesce(F.col("headers"), F.array().cast("array<struct<key:string,value:binary>>")) if "headers" in df.columns else None
    return df.select(
        "key", "value", F.concat(F.col("topic"), F.lit(".dlq")).alias("topic"), "partition",
        (F.concat(old, added) if old is not None else added).alias("headers"), "decode_error",
    )


def flatten(good: DataFrame) -> DataFrame:
    """Decoded envelopes as log rows, event time first and produce time in its absence."""
    p = "env.payload."
    return good.select(
        F.col("env.messageId").alias("event_id"), F.col(p + "service").alias("service"),
        F.col(p + "level").alias("level"), F.col(p + "message").alias("message"),
        F.col(p + "stackTrace").alias("stack_trace"), F.col(p + "metadata").alias("metadata"),
        F.col("env.traceId").alias("trace_id"), F.col("env.tenantId").alias("tenant_id"),
        F.coalesce(
            wire_time(F.col(p + "occurredAt")), wire_time(F.col("env.occurredAt")), wire_time(F.col("env.producedAt"))
        ).alias("occurred_at"),
    )


def read_records(spark: SparkSession, fmt: str, options: dict[str, str], streaming: bool = True) -> DataFrame:
    """Keyed records from Kafka or a folder of files."""
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if fmt == "kafka":
        return reader.load().select(
            F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
            "topic", "partition", "offset", "timestamp",
        )
    return reader.schema(RECORD_SCHEMA).load()


def read_envelopes(spark: SparkSession, fmt: str, options: dict[str, str], payload: T.DataType = LOG_ENTRY,
                   streaming: bool = True) -> DataFrame:
    return decode(read_records(spark, fmt, options, streaming), payload)


def write_envelopes(df: DataFrame, fmt: str, options: dict[str, str], checkpoint: str | None = None,
                    trigger: dict | None = None, mode: str = "append"):
    """Write keyed records; a streaming frame starts a query with its own checkpoint."""
    out = df if fmt == "kafka" else df.withColumn("headers", F.to_json(F.transform("headers", lambda h: F.struct(h["key"].alias("key"), F.decode(h["value"], "UTF-8").alias("value")))))
    if not df.isStreaming:
        out.write.format(fmt).options(**options).mode(mode).save()
        return None
    if checkpoint is None:
        raise ValueError("a streaming write needs a checkpoint folder")
    w = out.writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(**trigger) if trigger else w).start()


def replay(spark: SparkSession, src: str, dst: str, start: str | None = None, end: str | None = None,
           time_col: str = "timestamp", fmt: str = "parquet") -> None:
    """Copy a stored topic or table, or a time range of it, into another for reprocessing.

    The range is a plain filter, so it prunes files and row groups; key and value stay apart.
    """
    time_range(spark.read.format(fmt).load(src), time_col, start, end).write.format(fmt).mode("append").save(dst)


def time_range(df: DataFrame, time_col: str, start: str | None, end: str | None) -> DataFrame:
    """Rows with start <= time < end; an open side is unbounded."""
    if start is not None:
        df = df.filter(F.col(time_col) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(time_col) < F.lit(end).cast("timestamp"))
    return df
