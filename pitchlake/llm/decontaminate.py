"""Benchmark decontamination by winnowing.

Every window of ``width`` consecutive words is fingerprinted by the smallest
hash among its k-grams (k + (widths of the winnowing window) - 1 = width), for
the benchmark and for the documents alike. Equal windows have equal
fingerprints, so each shared span of at least ``width`` words is found.
Documents' fingerprints are joined with the benchmark's; a hit is extended to its
whole window, which is compared word by word. Items of fewer words have one
window, their whole text, with the hash of all its words for a fingerprint.

There is one plan whatever the benchmark's size. A bitmap of the benchmark's
fingerprints, of ``FILTER_BITS`` at most, lets a document's windows through; those
alone leave the document, and meet the benchmark's in an equality join on
fingerprint and window. A full bitmap lets more through, and loses nothing.

Defined results: a null, empty or wordless text has no words and no hits; items
with a null id or without words match nothing; items that share an id count as
one; very long texts are searched whole; repeated documents each get a row; empty
tables are fine on either side; other columns are ignored (uncontaminated() keeps them).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import free_name, id_text, map_batches, stored, utf8
from pitchlake.llm.textkernels import ALNUM, chunked, gram_hashes, sliding_min, span_hashes, word_table

WIDTH = 10
K = 6
#: The bitmap has 256 bits a fingerprint, but no more than 2 ** 26: 8 MB.
FILTER_BITS = 26
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
CANDIDATE = pa.struct([("n", pa.int32()), ("fp", pa.int64()), ("win", pa.string()), ("starts", pa.list_(pa.int64()))])
CANDIDATES = "array<struct<n:int,fp:long,win:string,starts:array<long>>>"


def prints(hashes: np.ndarray, n: int, width: int, k: int) -> np.ndarray:
    """Fingerprint of each window of n words, from the words' hashes."""
    return sliding_min(gram_hashes(hashes, k), width - k + 1) if n == width else gram_hashes(hashes, n)


def line(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> str:
    """The n words from the word at on, joined by spaces."""
    return b" ".join([buf[s:e].tobytes() for s, e in zip(starts[at : at + n].tolist(), ends[at : at + n].tolist(), strict=True)]).decode("utf-8", "replace")


def benchmark_windows(benchmark: DataFrame, width: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(n, fp, win, item_id) of each window of each item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), utf8(F.col(text_col).cast("string")).alias("raw")).filter("item_id is not null and raw is not null")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: set[tuple[int, int, str, str]] = set()
        for item_id, raw in zip(batch.column("item_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            buf, starts, ends, _ = word_table([raw], ALNUM)
            n = min(width, len(starts))
            if n:
                fps = prints(span_hashes(buf, starts, ends), n, width, k).view(np.int64)
                out |= {(n, fp, line(buf, starts, ends, i, n), item_id) for i, fp in enumerate(fps.tolist())}
        return pa.RecordBatch.from_pylist([dict(zip(("n", "fp", "win", "item_id"), x, strict=True)) for x in out], pa.schema([("n", pa.int32()), ("fp", pa.int64()), ("win", pa.string()), ("item_id", pa.string())]))

    return map_batches(items, run, "n int, fp long, win string, item_id string", by="raw", most=1 << 20).distinct()


def bitmap(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bits of the fingerprints that windows has, and the lengths of windows there are."""
    n = windows.agg(F.approx_count_distinct("fp")).first()[0]
    bits = min(FILTER_BITS, max(6, (256 * n).bit_length()))
    at = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    words = windows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out, sorted(r.n for r in windows.select("n").distinct().collect())  # at most width


def passing(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of fingerprints whose bit is set."""
    at = fps & np.uint64(64 * len(bits) - 1)
    return np.flatnonzero(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))


def candidates(raws: list[bytes], bits: np.ndarray, lengths: list[int], width: int, k: int) -> Iterator[tuple[int, list[dict]]]:
    """Of each text: its words, and its distinct windows that pass the bitmap, with their places."""
    for lo, hi in chunked(raws):
        buf, starts, ends, bounds = word_table(raws[lo:hi], ALNUM)
        hashes = span_hashes(buf, starts, ends)
        doc_end = np.repeat(bounds[1:], np.diff(bounds))  # of each word
        found: dict[int, dict[tuple[int, int, str], list[int]]] = defaultdict(dict)
        for n in lengths:
            fps = prints(hashes, n, width, k)
            at = passing(fps, bits)
            at = at[at + n <= doc_end[at]] if len(at) else at
            for p, d, fp in zip(at.tolist(), (np.searchsorted(bounds, at, side="right") - 1).tolist(), fps[at].view(np.int64).tolist(), strict=True):
                found[d].setdefault((n, fp, line(buf, starts, ends, p, n)), []).append(p - int(bounds[d]))
        for d, n_words in enumerate(np.diff(bounds).tolist()):
            yield n_words, [{"n": n, "fp": fp, "win": win, "starts": own} for (n, fp, win), own in found.get(d, {}).items()]


def merged(spans) -> list[tuple[int, int]]:
    """Ranges in order of their starts, overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, k: int = K,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, spans, items): spans are the ranges of words that are hit, items the sorted ids of the items found."""
    windows = stored(benchmark_windows(benchmark, width, k, item_id_col, item_text_col))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(windows))

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, found = zip(*candidates([t or b"" for t in batch.column("raw").to_pylist()], *shared.value, width, k), strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.list_(CANDIDATE))], ["doc_id", "n_words", "found"])

    raws = id_text(docs, id_col, text_col).select("doc_id", utf8("text").alias("raw"))
    searched = map_batches(raws, search, f"doc_id long, n_words long, found {CANDIDATES}", by="raw", most=4 << 20)
    rows = stored(searched.withColumn("at", F.monotonically_increasing_id()))  # written once, so that a row keeps its number
    asked = rows.filter(F.size("found") > 0).select("at", F.explode("found").alias("c")).select("at", "c.*")
    hits = asked.join(windows, ["n", "fp", "win"]).groupBy("at").agg(F.collect_set(F.struct("n", "starts")).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("items"))

    def join_spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [merged(sorted((s, s + h["n"]) for h in row for s in h["starts"])) for row in batch.column("hits").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("at"), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(SPAN)), batch.column("items")], ["at", "spans", "items"])

    spans = map_batches(hits, join_spans, "at long, spans array<struct<start:long,end:long>>, items array<string>")
    none = F.array().cast("array<struct<start:long,end:long>>"), F.array().cast("array<string>")
    return rows.select("at", "doc_id", "n_words").join(spans, "at", "left").select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, k: int = K, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs."""
    windows = stored(benchmark_windows(benchmark, width, k, item_id_col, item_text_col))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(windows))

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [x for _, x in candidates([t or b"" for t in batch.column("raw").to_pylist()], *shared.value, width, k)]
        some = np.array([bool(x) for x in found])
        return pa.RecordBatch.from_arrays([batch.column("digest").filter(pa.array(some)), pa.array([x for x in found if x], pa.list_(CANDIDATE))], ["digest", "found"])

    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))  # what decides is the text alone
    raws = docs.select(digest.alias("digest"), utf8(F.col(text_col).cast("string")).alias("raw"))
    asked = map_batches(raws, search, f"digest string, found {CANDIDATES}", by="raw", most=4 << 20).select("digest", F.explode("found").alias("c")).select("digest", "c.n", "c.fp", "c.win")
    dirty = free_name(docs, "dirty")
    found = stored(asked.join(windows, ["n", "fp", "win"]).select(F.col("digest").alias(dirty)).distinct())
    return docs.join(found, digest == F.col(dirty), "left_anti")


def report(found: DataFrame) -> DataFrame:
    """Figures of contamination()'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: report()'s rows in DuckDB SQL, by comparing all windows.
ORACLE = f"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bl AS (SELECT item_id, w, least({WIDTH}, len(w)) AS n FROM bw WHERE len(w) > 0),
bx AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dx AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n),
ds AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM dx),
hit AS (SELECT rid, i, ds.n AS n, item_id FROM ds JOIN bx ON ds.n = bx.n AND ds.win = bx.win),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""
