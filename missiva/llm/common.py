"""Shared pieces: tables staged in the shared folder, worker-wide caches, batch helpers."""

from __future__ import annotations

import ctypes
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.session import ensure_checkpoint_dir

# A space that follows a non-blank sign always starts a new match of the byte-level patterns.
BOUNDARY = re.compile(r"(?<=\S)(?= )")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def staged(df: DataFrame) -> DataFrame:
    """Write a table below `spark.checkpoint.dir` and read it again: cuts lineage, survives lost executors.

    What was shuffled for it is not kept.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/staged-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand memory that Arrow and the C library hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work`, which gives back at its end: idle workers live on, and count beside those of later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def worker_cache(name: str) -> dict:
    """A dict that outlives the task, for loaded vocabularies; worker processes are reused.

    A worker holds one such dict: asking for another name lets the former one go.
    """
    held = sys.__dict__.setdefault("_missiva_worker", {})
    if name not in held:
        held.clear()
        held[name] = {}
    return held[name]


def learns(doc_id: str | Column) -> Column:
    """Rows whose labels may be learnt from: crc32 of the id as text, modulo 3, is not 1; null ids never."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 3 != 1, F.lit(False))


def held_out(doc_id: str | Column) -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 3 == 1, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of about `size` bytes of text; a longer text stands alone."""
    i, n = 0, batch.num_rows
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    while i < n:
        j, total = i + 1, lengths[i]
        while j < n and total + lengths[j] <= size:
            total += lengths[j]
            j += 1
        yield batch.slice(i, j - i)
        i = j
