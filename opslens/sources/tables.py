"""Upserts into stored tables without a transactional format."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from opslens.session import cut_lineage

BUCKET, BUCKETS = "key_bucket", "key_buckets"
DEFAULT_BUCKETS = 256


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` with its bucket columns; None if nothing is stored there, an error if it is no such table."""
    try:
        old = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if BUCKET not in old.columns or BUCKETS not in old.columns:
        raise ValueError(f"{path} is not a bucketed table of this module")
    return old


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str],
                 merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int | None = None) -> None:
    """Merge ``batch`` (one row per key) into the table at ``path``.

    The table is split by a hash of its key. Only the buckets the batch touches are read, merged and
    replaced, so a small batch does not rewrite a large table. The merged rows are materialised before the
    old ones are replaced. One writer at a time. The number of buckets is chosen when the table is made and
    is part of its folders; asking for another number later is an error.
    """
    stored = stored_table(spark, path)
    if stored is None:
        buckets = buckets or DEFAULT_BUCKETS
    else:
        has = stored.select(F.max(BUCKETS)).first()[0]  # one number
        if buckets not in (None, has):
            raise ValueError(f"{path} has {has} buckets, not {buckets}")
        buckets = has
    at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = batch.withColumn(BUCKET, at)
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    old = None if stored is None else stored.filter(F.col(BUCKET).isin(touched)).drop(BUCKET, BUCKETS)
    merged = cut_lineage(merge(old, new.drop(BUCKET)).withColumn(BUCKET, at).withColumn(BUCKETS, F.lit(buckets)))
    (
        merged.repartition(max(1, len(touched)), BUCKET).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKETS, BUCKET).parquet(path)
    )
