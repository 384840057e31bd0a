"""Best-fit packing of tokenised documents into sequences, by sum of squares.

A document's ids are cut into pieces of at most `limit` tokens. Pieces of exactly
`limit` fill a sequence each; every other piece goes where the sum of the squared
numbers of open sequences per gap becomes smallest: into an open sequence, or a
new one. That keeps many different gaps open, so that later pieces fill some of
them to the last token. The smallest pieces (a share of the tokens) come last
and open a new sequence only where no gap holds them.

Only (row, length) decides, so neither texts nor ids are shuffled. Rows are dealt
by a hash of their number to buckets of about BUCKET pieces, whose number grows
with the corpus; each bucket is packed on its own and leaves less than one
sequence too many or so, whatever lengths repeat.

Defined results: a null text is empty, and an empty document is the closing id
alone; repeated rows are packed once each; documents of equal length are
interchangeable, and which is which follows from their place in the stored table;
a text of any length is encoded whole; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.bpe import byte_letters, vocabulary_path
from pitchlake.llm.common import id_text, map_batches, stored

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 2048
#: Pieces that are packed together.
BUCKET = 1 << 16
#: The smallest pieces, with this share of a bucket's tokens, but of this many sequences at least, come last.
LAST_SHARE, LAST_SEQUENCES = 0.05, 64
#: Fixed value: how the byte-level splitter cuts a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of a byte-level vocabulary file, as the tokenizers library gives them.

    Where merges stand in the order of the ids that they make, tiktoken gives the
    same ids several times faster from the file's own vocabulary; it cannot take
    runs of very many spaces, which go to the library, as other vocabularies do.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        byte = {x: b for b, x in enumerate(byte_letters())}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        splitter = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        ordered = all(a < b for a, b in zip(made, made[1:], strict=False)) and len(made) + 256 == len(vocab) and not spec["normalizer"] and (spec["pre_tokenizer"] or {}) | splitter == spec["pre_tokenizer"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in self.special}
        self.fast = Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special) if ordered else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except ValueError:  # its splitter's stack is full
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(maxsize=1)
def load(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the limit."""
    short = n % limit if n > limit else n
    return ([(0, short)] if short else []) + [(at, limit) for at in range(short, n, limit)]


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document's ids and the closing id; with their ids if asked for."""
    closing = np.array([end_id], dtype="<u4").tobytes()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        columns: list[list] = [[] for _ in names]
        ids = []
        encoder = load(path or vocabulary_path(VOCABULARY))
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = encoder.encode(text or "").tobytes() + closing
            for i, (at, length) in enumerate(cuts(len(raw) // 4, limit)):
                own = raw[4 * at : 4 * (at + length)]
                for column, value in zip(columns, (doc, i, at, length, zlib.crc32(own)), strict=True):
                    column.append(value)
                if with_ids:
                    ids.append(np.frombuffer(own, dtype="<i4"))
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]) if with_ids else pa.RecordBatch.from_arrays(arrays, names)

    return map_batches(id_text(docs, id_col, text_col), run, PIECES + (", ids array<int>" if with_ids else ""), by="text", most=4 << 20)


def sum_of_squares(lengths: np.ndarray, limit: int, last: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, placed in the given order; the last `last` of them open a sequence only if no gap holds them."""
    counts = np.zeros(limit + 1, dtype=np.int64)  # open sequences by gap; full ones (gap 0) and empty ones do not count
    at_gap: list[list[int]] = [[] for _ in range(limit + 1)]
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    opened, sparing = 0, len(lengths) - last
    for i, size in enumerate(lengths.tolist()):
        # moving a sequence from gap g to g - size changes the sum by 2 * (counts[g - size] - counts[g]) + 2; filling it, by 1 - 2 * counts[g]
        here = counts[size:limit]
        change = 2 * (counts[: limit - size] - here) + 2
        if len(change):
            change[0] -= 1
            change[here == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
        if len(change) and here[best] and (i >= sparing or change[best] <= 2 * counts[limit - size] + 1):
            gap = size + best
            chosen = at_gap[gap].pop()
            counts[gap] -= 1
        else:
            gap, chosen = limit, opened
            opened += 1
        sequence[i], offset[i] = chosen, limit - gap
        if gap > size:
            at_gap[gap - size].append(chosen)
            counts[gap - size] += 1
    return sequence, offset


def order(lengths: np.ndarray, limit: int, seed: int) -> tuple[np.ndarray, int]:
    """An order to place pieces in, a seeded shuffle with the smallest at the end, falling; and how many those are."""
    rising = np.argsort(lengths, kind="stable")
    sums = np.cumsum(lengths[rising])
    few = int(np.searchsorted(sums, max(LAST_SHARE * sums[-1], LAST_SEQUENCES * limit), side="right")) if len(sums) else 0
    rest = np.sort(rising[few:])
    return np.concatenate([np.random.default_rng(seed).permutation(rest), rising[:few][::-1]]), few


def pack(cut: DataFrame, limit: int = LIMIT, bucket: int = BUCKET, seed: int = 42) -> DataFrame:
    """pieces(), with sequence_id and offset of each; other columns of cut stay behind (join them by doc_id and piece).

    cut is read twice, so it should be a stored table.
    """
    buckets = max(1, -(-cut.count() // bucket))
    rows = cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(buckets)))

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        lengths = group.column("length").to_numpy()
        sequence, offset = np.empty(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        short = np.flatnonzero(lengths < limit)
        turn, few = order(lengths[short], limit, seed)
        sequence[short[turn]], offset[short[turn]] = sum_of_squares(lengths[short[turn]], limit, few)
        used = int(sequence[short].max()) + 1 if len(short) else 0
        full = np.flatnonzero(lengths >= limit)
        sequence[full] = used + np.arange(len(full))
        sequence += key[0].as_py() << 32
        return group.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return rows.groupBy("bucket").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its place; tokenised once."""
    return pack(stored(pieces(docs, path, limit, end_id)), limit)


def sequences(placed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids) of each sequence, from pack() and pieces(with_ids=True) of a table whose doc_ids are its key."""
    both = placed.select("doc_id", "piece", "sequence_id", "offset").join(with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # a sequence has at most `limit` tokens
    return both.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.size(p["ids"])).alias("n_tokens"), F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids")
    )
