"""Small helpers that the operators share: Arrow batches in and out of tasks, lineage cuts, hot-safe lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.session import cut_lineage as cut  # noqa: F401  (checkpoint in the shared folder)

SLICE_BYTES = 1 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) only, whatever else the table has; a null text is an empty one."""
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``most`` bytes; a longer text stands alone."""
    off = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    at, got = 0, 0
    for i, n in enumerate(off):
        if i > at and got + n > most:
            yield at, i
            at, got = i, 0
        got += int(n)
    if at < len(off):
        yield at, len(off)


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
