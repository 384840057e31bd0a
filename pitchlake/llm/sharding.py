"""Sharding by a two-pass external shuffle.

Pass one scatters the rows into buckets by a seeded hash, uniformly and so
small that a bucket fits in a task's memory. Pass two shuffles each bucket
(Spark's shuffle() of an array is a Fisher-Yates shuffle) and lays the buckets
end to end; the row at place g goes to shard g mod n at slot g div n, so the
shards' row counts are at most one apart and slots have no gaps.

The result depends on the rows and the seed alone: the number of buckets comes
from the rows' size; a bucket's rows are sorted before they are shuffled; and
bucket i is alone in partition i, so that its generator starts at seed + i,
whatever the cluster's settings and whichever task runs again.

Defined results: a null or empty text has no bytes (size 8, CRC 0); a very long
text is one row as any other; a null doc_id is scattered like any other; rows that are equal in all columns are numbered
first, so that however many there are they spread over all buckets, and which of
them gets which slot does not matter; an empty table gives an empty result.
write_shards keeps all columns of the input under their names; an input column
called `shard` is written as `shard_input` (and so on until the name is free), as the
folders are named by shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import stored

BUCKET_BYTES = 32 << 20
SEED = 42


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def crc_of(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


def bucket_count(total_bytes: int, bucket_bytes: int) -> int:
    """Buckets of about bucket_bytes."""
    return max(1, math.ceil(total_bytes / bucket_bytes))


def shuffled(rows: DataFrame, n_shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, shard, slot) of rows(row, size, mark): row is a struct that can be ordered, mark a hash of it."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = bucket_count(total, bucket_bytes)
    alike = Window.partitionBy("mark").orderBy("mark")
    scattered = rows.select("row", "mark", F.row_number().over(alike).alias("copy"))
    scattered = scattered.select(F.pmod(F.xxhash64(F.lit(seed), "mark", "copy"), F.lit(n)).cast("int").alias("bucket"), "row")
    buckets = stored(scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("row")).alias("rows")))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each bucket
    offsets = buckets.select("bucket", F.size("rows").cast("long").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    alone = buckets.join(offsets, "bucket").repartitionById(n, "bucket")
    laid = alone.select("offset", F.posexplode(F.shuffle("rows", seed)).alias("at", "row"))
    return laid.select("row", ((F.col("offset") + F.col("at")) % n_shards).cast("int").alias("shard"), F.expr(f"cast((offset + at) div {n_shards} as long)").alias("slot"))


def assign(docs: DataFrame, n_shards: int = 24, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each document; the law is `rows`."""
    records = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), size_of().alias("size"), crc_of().alias("text_crc32")).alias("row"))
    records = stored(records.select("row", "row.size", F.xxhash64("row.doc_id", "row.size", "row.text_crc32").alias("mark")))
    laid = shuffled(records, n_shards, seed, bucket_bytes)
    return laid.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the whole documents, a folder a shard; a file's rows are in slot order."""
    for name in [c for c in docs.columns if c.lower() == "shard"]:
        free = f"{name}_input"
        while free in docs.columns:
            free += "_input"
        docs = docs.withColumnRenamed(name, free)
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(every.alias("row"), size_of().alias("size"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("mark"))
    laid = shuffled(rows, n_shards, seed, bucket_bytes).sortWithinPartitions("shard", "slot")
    laid.select("row.*", "shard").write.partitionBy("shard").parquet(path)
