"""Shared Spark plumbing of the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitchlake import storage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; an error where a cluster names none."""
    storage.folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from those files, so that later steps neither recompute nor lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table: smaller, and read by column. It stays until storage.clear()."""
    return storage.stored(df, "zstd")


def sliced(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes in that binary column each."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if size and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, by: str | None = None, most: int = 8 << 20, at_end: Callable[[], None] | None = None) -> DataFrame:
    """Apply fn to each Arrow batch of df (no shuffle), or to parts of it with about `most` bytes in the column `by`.

    Workers are used again for other tasks: at_end is called when a task is through, to drop what it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in sliced(batch, by, most) if by else [batch]:
                    if part.num_rows:
                        yield fn(part)
        finally:
            release(at_end)

    return df.mapInArrow(run, schema)


def release(at_end: Callable[[], None] | None = None) -> None:
    """Give a task's memory back to the system, as the worker that runs it goes on to other tasks."""
    if at_end:
        at_end()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def utf8(text: str | Column) -> Column:
    """A text column as UTF-8 bytes; null stays null."""
    return F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8")


def free_name(df: DataFrame, name: str) -> str:
    """That name, with as many underscores before it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, as (doc_id, text), whatever else df has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
