"""Log entries in, parsed logs out; the stored log table; the golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions import ids, text

MAX_MESSAGE_CHARS = 262_144
MAX_BATCH_ROWS = 1_000

GOLDEN_SCHEMA = (
    "log string, expected_files array<string>, expected_layer string, error_type string, severity string"
)


def preprocess(df: DataFrame) -> DataFrame:
    """Parse, template and fingerprint: one narrow projection."""
    return df.withColumn("template", text.normalize(text.log_body(F.col("message")))).withColumn(
        "fingerprint", text.fingerprint(F.col("service"), F.col("level"), F.col("template"))
    )


def store_rows(df: DataFrame) -> DataFrame:
    """Rows of the stored log table: all entry columns plus the store-side fingerprint and the day."""
    fp = text.ingest_fingerprint(F.col("service"), F.col("level"), text.normalize(F.col("message")))
    return df.withColumn("fingerprint", fp).withColumn("event_date", F.to_date("occurred_at"))


def ingest_logs(df: DataFrame, path: str, partition_col: str = "event_date", fmt: str = "parquet",
                rows_per_file: int = 5_000_000, rebalance: bool = False) -> None:
    """Append a batch to the day-partitioned log table.

    Log batches mostly come in time order, so each task writes the few days it holds and nothing is
    shuffled; the record limit keeps files readable when one day holds most of the batch. ``rebalance``
    is for batches that mix many days: it gathers days into well-sized files and splits a crowded day.
    """
    rows = store_rows(df)
    if rebalance:
        rows = rows.hint("rebalance", partition_col)
    (
        rows.write.mode("append").format(fmt)
        .option("maxRecordsPerFile", rows_per_file).partitionBy(partition_col).save(path)
    )


def validation_errors(col_service: Column, col_level: Column, col_message: Column, col_time: Column) -> Column:
    """Names of the broken rules, as an array; empty for a valid entry."""
    def blank(c: Column) -> Column:
        return c.isNull() | (c == "")

    rules = {
        "service_empty": blank(col_service),
        "level_empty": blank(col_level),
        "message_empty": blank(col_message),
        "message_too_long": F.coalesce(F.length(col_message) > MAX_MESSAGE_CHARS, F.lit(False)),
        "occurred_at_missing": col_time.isNull(),
    }
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def validate_entries(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected rows carry their ``errors``."""
    marked = df.withColumn(
        "errors", validation_errors(F.col("service"), F.col("level"), F.col("message"), F.col("occurred_at"))
    )
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def batch_errors(df: DataFrame, batch_col: str, max_rows: int = MAX_BATCH_ROWS) -> DataFrame:
    """Batches outside 1..max_rows entries; a counted aggregate, so no batch is gathered."""
    return df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > max_rows)


def for_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """Only the rows of one tenant; a plain equality, so it reaches the scan."""
    return df.filter(F.col("tenant_id") == tenant_id)


def with_tenant(df: DataFrame, default: str = ids.DEFAULT_TENANT) -> DataFrame:
    return df.withColumn("tenant_id", ids.resolve_tenant(F.col("metadata"), default))


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines evaluation set; blank lines are skipped by the reader."""
    return spark.read.schema(GOLDEN_SCHEMA).json(path)
