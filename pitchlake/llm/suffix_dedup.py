"""Removal of repeated byte strings across a corpus, by sparse suffix arrays.

suffixes.py has the method; this module lays it out over Spark. Hashes only say
which runs may meet; every repeat is found by comparing bytes.

1. documents -> runs, without their bytes, without a shuffle. Of runs of a batch
   that are equal byte for byte only the earliest goes on, the others are repeats,
   so that a passage that very many documents share comes as one row a batch;
2. minimizers are counted, and runs whose minimizer comes once drop out;
3. the others' pieces are fetched from the texts and sorted in buckets of whole
   minimizer groups. A group of more than ``hot`` runs is first sorted in parts:
   runs of which every window repeats drop out, so that copies collapse, and the
   others meet again; a group that does not get smaller by that is cut into
   finer groups, level by level, of which each holds all equal windows, at last single windows;
4. the ranges found are cut out of the texts.

Defined results: a null text is empty; texts shorter than the window lose
nothing; very long texts are read in segments that overlap, whole; a null doc_id
loses nothing and takes nothing from others; rows that share a doc_id are
documents of the same age, which take nothing from each other, and each gets the
result of its own text; repeated rows all get that row's result; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import id_text, map_batches, stored, utf8
from pitchlake.llm.suffixes import K, WINDOW, repeated_windows, runs

HOT = 1000
BUCKET_ROWS = 10_000
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<start:long,end:long>>"
#: A document is known by its id and a hash of its text; a run by that and its place.
DOC = ["doc_id", "row"]


def pack(start: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A run's place as one number, in order of its start."""
    return start << 16 | count << 8 | offset


def unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 16, pos >> 8 & 255, pos & 255


def run_rows(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(mh, doc_id, row, pos, repeats) of texts(doc_id, row, raw): a batch's runs, and ranges of a document that are equal to
    an earlier run of the batch, as rows with repeats alone."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = batch.column("raw").to_pylist()
        text, start, count, offset, mh, piece = runs(raws, window, k)
        doc, row = batch.column("doc_id").to_numpy()[text], batch.column("row").to_numpy()[text]
        by = np.lexsort((start, row, doc, piece, mh))
        text, start, count, offset, mh, piece, doc, row = (x[by] for x in (text, start, count, offset, mh, piece, doc, row))
        keep = np.ones(len(by), dtype=bool)
        if len(by):
            new = np.ones(len(by), dtype=bool)
            new[1:] = (mh[1:] != mh[:-1]) | (piece[1:] != piece[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = doc > doc[head]
            again[1:] |= ~new[1:] & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (start[1:] != start[:-1])
            for i in np.flatnonzero(again).tolist():  # equal hashes route, equal bytes decide
                a, b = start[head[i]], start[i]
                keep[i] = raws[text[head[i]]][a : a + count[i] - 1 + window] != raws[text[i]][b : b + count[i] - 1 + window]
        gone = np.flatnonzero(~keep)
        gone = gone[np.lexsort((start[gone], text[gone]))]
        ranges, owners = [], []
        edges = np.flatnonzero(np.diff(text[gone], prepend=-1)).tolist()
        for lo, hi in zip(edges, [*edges, len(gone)][1:], strict=True):
            g = gone[lo:hi]
            ranges.append([{"start": s, "end": e} for s, e in merge(start[g], start[g] + count[g] - 1 + window)])
            owners.append(g[0])
        owners = np.array(owners, dtype=np.int64)
        kept = np.flatnonzero(keep)
        kept = kept[np.lexsort((start[kept], text[kept]))]  # in order of place, neighbours compress better
        none = pa.nulls(len(owners), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(mh[kept].view(np.int64)), none]), pa.array(np.concatenate([doc[kept], doc[owners]])), pa.array(np.concatenate([row[kept], row[owners]])),
                pa.concat_arrays([pa.array(pack(start[kept], count[kept], offset[kept])), none]), pa.concat_arrays([pa.nulls(len(kept), pa.list_(SPAN)), pa.array(ranges, pa.list_(SPAN))]),
            ],
            ["mh", "doc_id", "row", "pos", "repeats"],
        )

    return map_batches(texts, run, f"mh long, doc_id long, row long, pos long, repeats {SPANS}", by="raw")


def merge(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Ranges with overlapping and touching ones joined, in order."""
    if not len(start):
        return []
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(end[by])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), reach[np.append(first[1:], len(start)) - 1].tolist(), strict=True))


def shared_runs(rows: DataFrame) -> DataFrame:
    """(doc_id, row, spans, members): each document's repeats so far, and its runs whose minimizer comes more than once.

    Runs are dealt by minimizer and counted as they stream by, so that texts are cut into runs once; rows with repeats alone are dealt by document.
    """
    dealt = rows.withColumn("deal", F.coalesce("mh", F.xxhash64(*DOC))).repartition("deal")
    counted = dealt.withColumn("n", F.count("mh").over(Window.partitionBy("deal"))).filter("repeats is not null or n > 1")
    member = F.when(F.col("mh").isNotNull(), F.struct("pos", "mh"))
    return counted.groupBy(*DOC).agg(F.flatten(F.collect_list("repeats")).alias("spans"), F.collect_list(member).alias("members"))


RUN = "mh long, doc_id long, row long, pos long, bytes binary"


def members(texts: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The runs to compare, with their bytes, as RUN; texts have z, the compressed bytes."""
    asked = docs.filter(F.size("members") > 0).select(*DOC, "members")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, row, mh, pos, piece = [], [], [], [], []
        for d, r, raw, ms in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), map(unzipped, batch.column("z").to_pylist()), batch.column("members").to_pylist(), strict=True):
            for m in ms:
                start, count = m["pos"] >> 16, m["pos"] >> 8 & 255
                doc.append(d)
                row.append(r)
                mh.append(m["mh"])
                pos.append(m["pos"])
                piece.append(raw[start : start + count - 1 + window])
        return pa.RecordBatch.from_arrays([pa.array(mh, pa.int64()), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(pos, pa.int64()), pa.array(piece, pa.binary())], ["mh", "doc_id", "row", "pos", "bytes"])

    return map_batches(texts.join(asked, DOC), run, RUN, by="z", most=1 << 20)


def compare_sorted(rows: DataFrame, n_rows: int, bucket_rows: int, window: int, k: int, survivors: bool = False) -> DataFrame:
    """Repeats among the runs of rows(grp, RUN) that share a group, as RUN with `end`: pos is a range's start, mh and bytes are null.
    With survivors also the runs of which some window does not repeat, with mh and bytes and without end."""
    at_least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(at_least, math.ceil(n_rows / bucket_rows))

    def run(t: pa.Table) -> pa.Table:
        _, once = np.unique(np.stack([t.column(c).to_numpy() for c in ("grp", "doc_id", "row", "pos")]), axis=1, return_index=True)
        t = t.take(pa.array(once))  # a document that is there twice is compared once
        start, count, offset = unpack(t.column("pos").to_numpy())
        doc, row = t.column("doc_id").to_numpy(), t.column("row").to_numpy()
        _, group = np.unique(t.column("grp").to_numpy(), return_inverse=True)
        found, whole = repeated_windows(group, doc, row, start, count, offset, t.column("bytes").to_pylist(), window, k)
        at = np.array([r for r, *_ in found], dtype=np.int64)
        none = lambda kind: pa.nulls(len(found), kind)
        out = pa.table({"mh": none(pa.int64()), "doc_id": pa.array(doc[at]), "row": pa.array(row[at]), "pos": pa.array([s for _, s, _ in found], pa.int64()), "bytes": none(pa.binary()), "end": pa.array([e for *_, e in found], pa.int64())})
        if not survivors:
            return out
        left = t.filter(pa.array(~whole)).select(["mh", "doc_id", "row", "pos", "bytes"])
        return pa.concat_tables([out, left.append_column("end", pa.nulls(left.num_rows, pa.int64())).cast(out.schema)])

    bucket = F.pmod(F.xxhash64("grp"), F.lit(n_buckets)).alias("bucket")
    return rows.select(bucket, "grp", "mh", *DOC, "pos", "bytes").groupBy("bucket").applyInArrow(run, f"{RUN}, end long")


def split(rows: DataFrame, size: int, window: int) -> DataFrame:
    """Runs cut where the minimizer's offset passes a multiple of size, with new groups.

    All windows of a part hold its core, the bytes that windows at any offset of
    that block share; so parts whose cores differ have no window in common, and
    the core's hash is the parts' new group.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for m, d, r, place, raw in zip(*(batch.column(c).to_pylist() for c in ("mh", "doc_id", "row", "pos", "bytes")), strict=True):
            start, count, offset = place >> 16, place >> 8 & 255, place & 255
            for block in range((offset - count + 1) // size, offset // size + 1):
                lo, hi = block * size, (block + 1) * size
                i, j = max(0, offset - hi + 1), min(count - 1, offset - lo)
                core = xxhash.xxh3_64_intdigest(raw[offset - lo : offset - hi + 1 + window] + struct.pack("<qhh", m, block, size))
                out.append((core - (1 << 64) if core >> 63 else core, d, r, (start + i) << 16 | (j - i + 1) << 8 | (offset - i), raw[i : j + window]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["mh", "doc_id", "row", "pos", "bytes"])

    return map_batches(rows.select("mh", *DOC, "pos", "bytes"), run, RUN, by="bytes", most=1 << 20)


def settle_windows(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, start, end) of rows (RUN) of one window each that an earlier one equals: the smallest doc_id stays, each document's first."""
    every = rows.select("bytes", *DOC, F.shiftright("pos", 16).alias("start"))
    mine = every.groupBy("bytes", *DOC).agg(F.min("start").alias("first"))
    oldest = every.groupBy("bytes").agg(F.min("doc_id").alias("oldest"))
    judged = every.join(mine, ["bytes", *DOC]).join(oldest, "bytes").filter((F.col("doc_id") > F.col("oldest")) | (F.col("start") > F.col("first")))
    return judged.select(*DOC, "start", (F.col("start") + window).alias("end"))


def resolve(rows: DataFrame, window: int, k: int, hot: int, bucket_rows: int) -> list[DataFrame]:
    """All repeats among rows (RUN), as (doc_id, row, start, end)."""
    found: list[DataFrame] = []

    def take(compared: DataFrame) -> None:
        found.append(compared.filter("end is not null").select(*DOC, F.col("pos").alias("start"), "end"))

    for size in (0, 32, 16, 8, 4, 2):
        if size:
            rows = stored(split(rows, size, window))
        before = None
        while True:
            sizes = rows.groupBy("mh").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            sized = stored(rows.join(sizes, "mh"))
            n_cold, n_large = sized.agg(F.count_if(F.col("n") <= hot), F.count_if(F.col("n") > hot)).first()
            if n_cold:
                cold = sized.filter(F.col("n") <= hot).withColumn("grp", F.col("mh"))
                take(stored(compare_sorted(cold, n_cold, bucket_rows, window, k)))
            if not n_large:
                return found
            rows = sized.filter(F.col("n") > hot)
            if before and n_large > 0.8 * before:
                break
            before = n_large
            salt = F.pmod(F.xxhash64(*DOC, "pos"), F.ceil(2 * F.col("n") / hot))
            parts = stored(compare_sorted(rows.withColumn("grp", F.xxhash64("mh", salt)), n_large, bucket_rows, window, k, survivors=True))
            take(parts)
            rows = parts.filter("end is null").select("mh", *DOC, "pos", "bytes")
    # what is left are equal windows of documents of one age, or texts that part ways everywhere: window by window
    return [*found, settle_windows(split(rows, 1, window), window)]


def zipped(texts: DataFrame) -> DataFrame:
    """texts(doc_id, row, raw) as (doc_id, row, z), compressed: texts are shuffled to be joined, and this is what is shuffled."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=6, write_checksum=False)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([z.compress(r) for r in batch.column("raw").to_pylist()], pa.binary())], ["doc_id", "row", "z"])

    return map_batches(texts, run, "doc_id long, row long, z binary", by="raw")


def unzipped(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def repeats(docs: DataFrame, window: int = WINDOW, k: int = K, hot: int = HOT, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, z, spans): each document's bytes, compressed, and the byte ranges to remove, in any order and with overlaps."""
    both = id_text(docs, id_col, text_col).select("doc_id", utf8(F.coalesce("text", F.lit(""))).alias("raw"))
    both = both.select("doc_id", F.xxhash64("raw").alias("row"), "raw")
    texts = both.filter("doc_id is not null")
    found = stored(shared_runs(run_rows(texts, window, k)))
    marks = resolve(stored(members(zipped(texts), found, window)), window, k, hot, bucket_rows)
    every = found.select(*DOC, "spans")
    if marks:
        every = every.unionByName(reduce(DataFrame.unionByName, marks).groupBy(*DOC).agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    spans = every.groupBy(*DOC).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    nothing = F.array().cast(SPANS)
    with_id = zipped(texts).join(spans, DOC, "left").select("doc_id", "z", F.coalesce("spans", nothing).alias("spans"))
    return with_id.unionByName(zipped(both.filter("doc_id is null")).select("doc_id", "z", nothing.alias("spans")))


def remove(found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of repeats()'s rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_bytes, n_removed, n_spans, sha = [], [], [], []
        for raw, spans in zip(map(unzipped, batch.column("z").to_pylist()), batch.column("spans").to_pylist(), strict=True):
            cuts = merge(np.array([x["start"] for x in spans], dtype=np.int64), np.array([x["end"] for x in spans], dtype=np.int64))
            at, digest = 0, hashlib.sha256()
            for s, e in cuts:
                digest.update(raw[at:s])
                at = e
            digest.update(raw[at:])
            n_bytes.append(len(raw))
            n_removed.append(sum(e - s for s, e in cuts))
            n_spans.append(len(cuts))
            sha.append(digest.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_batches(found, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", by="z", most=2 << 20)
