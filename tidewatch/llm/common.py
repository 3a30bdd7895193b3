"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import materialize, scratch_dir

__all__ = ["crc_bucket", "distinct_sample", "documents", "materialize", "row_blocks", "scratch_dir", "table"]

#: Text bytes that a Python worker holds of one Arrow batch at a time.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``; a null value counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def crc_bucket_of(value: object, modulus: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % modulus


def distinct_sample(rows: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` different rows, those with the smallest hashes of all their columns. Only hashes are gathered, each
    once, and only the chosen rows travel; the sample depends neither on how the rows are dealt nor on repeated ones."""
    marked = rows.withColumn("_pick", F.xxhash64(*rows.columns))
    picks = materialize(marked.select("_pick").distinct().orderBy("_pick").limit(bound), "sample")
    chosen = marked.join(F.broadcast(picks), "_pick").groupBy("_pick").agg(F.min(F.struct(*rows.columns)).alias("row"))
    return chosen.select("row.*")


def row_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` bytes of ``column`` (one row at least), so that memory does not
    depend on how long the texts of a batch are."""
    for batch in batches:
        sizes = batch.column(column)
        total, begin, held = batch.num_rows, 0, 0
        lengths = pa.compute.binary_length(sizes).fill_null(0).to_numpy(zero_copy_only=False)
        for i in range(total):
            if held and held + lengths[i] > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(lengths[i])
        if begin < total:
            yield batch.slice(begin, total - begin)
    release_memory()


def release_memory() -> None:
    """Give freed memory back at the end of a task, as workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
