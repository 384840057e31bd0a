"""Language-model scoring by cross-entropy difference.

Two bigram models of the same form share one vocabulary: a target model of good
labelled documents and a background model of the whole corpus. A document's
score is its mean loss per token under the target model less that under the
background model; lower is closer to the target. Each document is scored by
what the *other* documents hold: its own counts are taken out of the background,
and out of the target if it is a target document, so that no score recalls the
document itself.

    p(w | v) = MIX * c(v, w) / c(v) + (1 - MIX) * (c(w) + 1) / (T + V)

(only the second part, unweighted, after nothing or a v without counts). c are exact counts,
T the model's tokens, V the vocabulary's size. Words are runs of letters and digits, lower-cased
in A-Z, and runs of other characters that are not space. The vocabulary is every
word that comes twice or more in the target, all others being one unknown word.

Layout over Spark: 1. the vocabulary and both models' word counts, sums of
batches; 2. exact pair counts of the ``HEAD`` most frequent words with each
other, a dense table of fixed size: so no other pair has more than a share of
1 / HEAD of the tokens, and none is hot; 3. all other pairs of a document go, by
pair, to buckets that count them and return each document's losses; 4. the losses
go back to the documents. Losses are added as whole numbers of 2^-20 nats, so that
sums do not depend on their order.

All good labelled documents are the target, and all counts cover all documents. ``max_target``, if it
is given, takes a seeded share of about that many; nothing here gives it. The driver and each task hold the
vocabulary and its counts, some 50 bytes a word that comes twice or more in the target.

Defined results: a null or empty text or one of spaces has no tokens and null losses and
score, and is not selected; a null doc_id is scored but is never a target; a
doc_id that is repeated is a target in each of its rows; a label that is repeated
counts once; ties of frequency go to the word with the smaller hash; very long
texts are one batch of their own; without target documents the target model is
uniform over one unknown word; repeated rows each get a row and count each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import map_batches, release, sliced, stored, utf8
from pitchlake.llm.textkernels import ALNUM, LOWER, NONSPACE, chunked, mix, span_hashes

MIX = 0.6
MAX_TARGET = 20_000
#: Ids that are sent to every task; of more, texts are dealt by id.
MAX_SENT = 1_000_000
#: Words whose pairs with each other are counted in a dense table.
HEAD = 1000
#: Bytes of text that are cut up together, and bytes of text whose pairs share a bucket, about.
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
#: A bucket whose entries take more than so many times that is settled in parts.
LARGE = 4
#: Entries whose losses are worked out at once.
PART = 1 << 16
ONE = float(1 << 20)


@dataclass
class Model:
    """Word counts of the target and of the background, by word; word 0 is the unknown one."""

    words: np.ndarray  # sorted hashes of the vocabulary; word i + 1 has the hash words[i]
    n: np.ndarray = field(default_factory=lambda: np.zeros((2, 1), dtype=np.int64))
    head: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))  # the most frequent words
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 0, 0), dtype=np.int64))  # counts of pairs of head words

    @property
    def size(self) -> int:
        return len(self.words) + 1

    def place(self) -> np.ndarray:
        """Of each word: its place in head, or -1."""
        out = np.full(self.size, -1, dtype=np.int64)
        out[self.head] = np.arange(len(self.head))
        return out


def hashed(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, end to end, and the bounds of texts."""
    parts, lengths = [np.empty(0, dtype=np.uint64)], []
    for lo, hi in chunked(raws):
        buf = LOWER[np.frombuffer(b" ".join(raws[lo:hi]), dtype=np.uint8)]
        kind = np.where(ALNUM[buf], 2, NONSPACE[buf].astype(np.int8))
        edges = np.flatnonzero(np.diff(kind, prepend=0, append=0))
        word = kind[edges[:-1]] > 0
        starts, ends = edges[:-1][word], edges[1:][word]
        parts.append(span_hashes(buf, starts, ends))
        lengths += np.diff(np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws[lo:hi]]))).tolist()
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)


def ids_of(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), dtype=np.int64)
    distinct, back = np.unique(hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(vocabulary, distinct), len(vocabulary) - 1)
    return np.where(vocabulary[at] == distinct, at + 1, 0)[back]


@dataclass
class Counts:
    """Of a batch: each document's words, and its distinct pairs with their own counts."""

    length: np.ndarray  # tokens, by document
    word_doc: np.ndarray
    word: np.ndarray
    word_n: np.ndarray
    first: np.ndarray  # the first word of documents that have one
    doc: np.ndarray
    before: np.ndarray
    after: np.ndarray
    n: np.ndarray

    def own(self, doc: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
        """How often each document has each word; it has it."""
        return self.word_n[np.searchsorted(self.word_doc * size + self.word, doc * size + word)]


def counts_of(raws: list[bytes], vocabulary: np.ndarray) -> Counts:
    hashes, bounds = hashed(raws)
    w, size = ids_of(hashes, vocabulary), len(vocabulary) + 1
    length = np.diff(bounds)
    doc = np.repeat(np.arange(len(raws)), length)
    words, word_n = np.unique(doc * size + w, return_counts=True)
    inner = np.ones(len(w), dtype=bool)
    inner[bounds[:-1][length > 0]] = False
    at = np.flatnonzero(inner)
    pairs, n = np.unique((doc[at] * size + w[at - 1]) * size + w[at], return_counts=True)
    return Counts(length, words // size, words % size, word_n, w[bounds[:-1][length > 0]], pairs // size // size, pairs // size % size, pairs % size, n)


def losses(model: Model, target: np.ndarray, length: np.ndarray, before: np.ndarray | None, after: np.ndarray, own_before: np.ndarray | None, own_after: np.ndarray, pair: np.ndarray | None, own: np.ndarray) -> np.ndarray:
    """Nats * 2^20 of `own` tokens each, under the target and the background model, as whole numbers.

    target and length belong to each entry's document; pair are the pair's counts in both models. PART entries go by at once,
    as what is held between steps is several times the entries.
    """
    if len(own) > PART:
        some = lambda x, at: None if x is None else x[..., at]
        cuts = [slice(i, i + PART) for i in range(0, len(own), PART)]
        return np.concatenate([losses(model, *(some(x, at) for x in (target, length, before, after, own_before, own_after, pair, own))) for at in cuts], axis=1)
    out = []
    for which in (0, 1):
        mine = target if which == 0 else np.ones(len(own), dtype=np.int64)  # are the document's counts in this model?
        total = model.n[which].sum() - mine * length
        p = (model.n[which][after] - mine * own_after + 1.0) / (total + model.size)
        if before is not None:
            c = model.n[which][before] - mine * own_before
            # a last word has no pair after it: counts of words are taken as they are
            p = np.where(c > 0, MIX * (pair[which] - mine * own) / np.maximum(c, 1) + (1 - MIX) * p, p)
        out.append(np.rint(-np.log(p) * ONE).astype(np.int64) * own)
    return np.stack(out)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, by byte planes, compressed."""
    planes = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpacked(z: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    """n columns of packed(), as numbers of that kind, which holds them."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), dtype=np.uint8).reshape(n, 8, -1)
    out = np.empty((n, planes.shape[2]), dtype=kind)
    for column, p in zip(out, planes, strict=True):
        column[:] = np.ascontiguousarray(p.T).reshape(-1).view("<i8")
    return out


def flagged(docs: DataFrame, target_ids: DataFrame, max_target: int | None = None) -> DataFrame:
    """(doc_id, raw, target) of docs: target are the ids, or about max_target of them at most."""
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    n = ids.count()
    if max_target is not None and n > max_target:
        unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
        ids, n = ids.filter(unit < max_target / n), max_target
    chosen = ids.withColumn("target", F.lit(1).cast("long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text").cast("string")).alias("raw"))
    few = n <= MAX_SENT
    both = rows.join(F.broadcast(chosen) if few else chosen, "doc_id", "left").select("doc_id", "raw", F.coalesce("target", F.lit(0).cast("long")).alias("target"))
    return both if few else stored(both)  # texts go to their ids once, not for each count


def read(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    return [r or b"" for r in batch.column("raw").to_pylist()], batch.column("target").to_numpy()


def summed(rows: DataFrame, count, width: int) -> np.ndarray:
    """Sums over all batches of count(raws, target), a dense array of that width; only entries that are there are shuffled."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = count(*read(batch))
        at = np.flatnonzero(parts)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(parts[at])], ["entry", "n"])

    sums = map_batches(rows, run, "entry long, n long", by="raw", most=BATCH_BYTES).groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width, dtype=np.int64)
    out[sums.column("entry").to_numpy()] = sums.column("n").to_numpy()
    return out


def fit(rows: DataFrame) -> Model:
    """Vocabulary, word counts and the head's pair counts of rows(doc_id, raw, target)."""

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, n = np.unique(hashed(read(batch)[0])[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "n"])

    seen = map_batches(rows.filter("target = 1"), words, "word long, n long", by="raw", most=BATCH_BYTES).groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").select("word").toArrow()
    model = Model(np.sort(seen.column("word").to_numpy().view(np.uint64)))
    sc, size = rows.sparkSession.sparkContext, model.size
    vocabulary = sc.broadcast(model.words)

    def unigrams(raws: list[bytes], target: np.ndarray) -> np.ndarray:
        hashes, bounds = hashed(raws)
        w = ids_of(hashes, vocabulary.value)
        return np.concatenate([np.bincount(w[np.repeat(target, np.diff(bounds)) == 1], minlength=size), np.bincount(w, minlength=size)])

    model.n = summed(rows, unigrams, 2 * size).reshape(2, size)
    model.head = np.lexsort((np.arange(size), -model.n[1]))[:HEAD]
    k, shared = len(model.head), sc.broadcast((model.words, model.place()))

    def pairs(raws: list[bytes], target: np.ndarray) -> np.ndarray:
        words, place = shared.value
        hashes, bounds = hashed(raws)
        a = place[ids_of(hashes, words)]
        ok = np.flatnonzero((a[:-1] >= 0) & (a[1:] >= 0)) if len(a) else np.empty(0, dtype=np.int64)
        doc = np.repeat(np.arange(len(raws)), np.diff(bounds))
        ok = ok[doc[ok] == doc[ok + 1]]
        code = a[ok] * k + a[ok + 1]
        return np.concatenate([np.bincount(code[target[doc[ok]] == 1], minlength=k * k), np.bincount(code, minlength=k * k)])

    model.pairs = summed(rows, pairs, 2 * k * k).reshape(2, k, k)
    return model


def score(rows: DataFrame, model: Model, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, target, n_tokens, target_loss, background_loss) of rows(doc_id, raw, target)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    n_buckets = 1 + (rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) // bucket_bytes
    step = "batch long, bucket long, entries binary, docs binary"

    def cut_one(batch: pa.RecordBatch, batch_id: int, place: np.ndarray) -> pa.RecordBatch:
        """A batch's entries by bucket, and its documents."""
        model = shared.value
        raws, target = read(batch)
        c = counts_of(raws, model.words)
        own_before, own_after = c.own(c.doc, c.before, model.size), c.own(c.doc, c.after, model.size)
        total = np.zeros((2, len(raws)), dtype=np.int64)
        full = np.flatnonzero(c.length)
        if len(full):
            total[:, full] += losses(model, target[full], c.length[full], None, c.first, None, c.own(full, c.first, model.size), None, np.ones(len(full), dtype=np.int64))
        head = np.flatnonzero((place[c.before] >= 0) & (place[c.after] >= 0))
        d, pair = c.doc[head], model.pairs[:, place[c.before[head]], place[c.after[head]]]
        loss = losses(model, target[d], c.length[d], c.before[head], c.after[head], own_before[head], own_after[head], pair, c.n[head])
        for which in (0, 1):
            np.add.at(total[which], d, loss[which])
        ids = batch.column("doc_id")
        known = np.array([x is not None for x in ids.to_pylist()], dtype=np.int64)
        own = packed(ids.fill_null(0).to_numpy(), known, target, c.length, *total)
        rest = np.flatnonzero((place[c.before] < 0) | (place[c.after] < 0))
        bucket = (mix((c.before[rest] * model.size + c.after[rest]).astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        by = np.lexsort((c.doc[rest], c.after[rest], c.before[rest], bucket))
        rest, bucket = rest[by], bucket[by]
        edge = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(rest) else np.empty(0, dtype=np.int64)
        out = [(batch_id % n_buckets, None, own)]  # the documents themselves pass through
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(rest)], strict=False):
            r = rest[lo:hi]
            d = c.doc[r]
            out.append((int(bucket[lo]), packed(d, np.diff(c.before[r], prepend=0), c.after[r], c.n[r], own_before[r], own_after[r], target[d], c.length[d]), None))
        return pa.RecordBatch.from_arrays([pa.array([batch_id] * len(out)), pa.array([b for b, *_ in out], pa.int64()), pa.array([e for _, e, _ in out], pa.binary()), pa.array([o for *_, o in out], pa.binary())], ["batch", "bucket", "entries", "docs"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id, place = TaskContext.get().partitionId() << 32, shared.value.place()
        try:
            for whole in batches:
                for batch in sliced(whole, "raw", BATCH_BYTES):
                    yield cut_one(batch, batch_id, place)
                    batch_id += 1
        finally:
            release()  # the worker goes on to other tasks, or idles beside them

    def frugal(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
        """fn, and its memory given back after large groups."""

        def run(t: pa.Table) -> pa.Table:
            try:
                return fn(t)
            finally:
                if t.nbytes > 1 << 20:
                    release()

        return run

    def entries_of(t: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray]:
        """Of a bucket: batches, their entries, and the pairs of all entries."""
        batches, parts = t.column("batch").to_pylist(), [unpacked(z, 8, np.int32) for z in t.column("entries").to_pylist()]
        before = np.concatenate([np.cumsum(p[1], dtype=np.int64) for p in parts]) if parts else np.empty(0, dtype=np.int64)
        return batches, parts, before * shared.value.size + (np.concatenate([p[2] for p in parts]) if parts else before)

    def losses_of(batches: list[int], parts: list[np.ndarray], code: np.ndarray, pair: np.ndarray) -> pa.Table:
        """Each batch's documents' losses, with the corpus' counts (target, all) of each entry's pair."""
        doc, _, after, n, own_before, own_after, target, length = np.concatenate(parts, axis=1)
        loss = losses(shared.value, target, length, code // shared.value.size, after, own_before, own_after, pair, n)
        at, out = 0, []
        for p in parts:
            d, i = np.unique(doc[at : at + p.shape[1]], return_inverse=True)
            mine = np.zeros((2, len(d)), dtype=np.int64)
            for which in (0, 1):
                np.add.at(mine[which], i, loss[which, at : at + p.shape[1]])
            out.append(packed(np.diff(d, prepend=0), *mine))
            at += p.shape[1]
        return pa.table({"batch": pa.array(batches, pa.int64()), "entries": pa.array(out, pa.binary()), "docs": pa.array([None] * len(out), pa.binary())})

    def counted(code: np.ndarray, n: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, the place of each entry's among them, their counts in target and all)."""
        codes, back = np.unique(code, return_inverse=True)
        return codes, back, np.stack([np.bincount(back, weights=n * target, minlength=len(codes)), np.bincount(back, weights=n, minlength=len(codes))]).astype(np.int64)

    def settle(t: pa.Table) -> pa.Table:
        """A bucket's pairs are counted over the corpus; each batch gets its documents' losses."""
        batches, parts, code = entries_of(t)
        _, back, pair = counted(code, *(np.concatenate([p[i] for p in parts]) for i in (3, 6)))
        return losses_of(batches, parts, code, pair[:, back])

    def count_part(t: pa.Table) -> pa.Table:
        """Of a part of a large bucket: its pairs and their counts there."""
        _, parts, code = entries_of(t)
        codes, _, pair = counted(code, *(np.concatenate([p[i] for p in parts]) for i in (3, 6)))
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "counts": pa.array([packed(np.diff(codes, prepend=0), *pair)], pa.binary())})

    def add_up(t: pa.Table) -> pa.Table:
        """The parts' counts of a large bucket, together: as many as it has different pairs."""
        codes, n_target, n = np.concatenate([np.stack([np.cumsum(c[0]), c[1], c[2]]) for c in (unpacked(z, 3) for z in t.column("counts").to_pylist())], axis=1)
        at, back = np.unique(codes, return_inverse=True)
        pair = [np.bincount(back, weights=v, minlength=len(at)).astype(np.int64) for v in (n_target, n)]
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "counts": pa.array([packed(np.diff(at, prepend=0), *pair)], pa.binary())})

    def settle_part(t: pa.Table) -> pa.Table:
        """settle() of a part of a large bucket, with the whole bucket's counts."""
        counts = next(z for z in t.column("counts").to_pylist() if z is not None)
        codes, *pair = unpacked(counts, 3)
        batches, parts, code = entries_of(t.filter(t.column("entries").is_valid()))
        at = np.searchsorted(np.cumsum(codes), code)
        return losses_of(batches, parts, code, np.stack(pair)[:, at]) if parts else pa.table({"batch": pa.array([], pa.int64()), "entries": pa.array([], pa.binary()), "docs": pa.array([], pa.binary())})

    def gather(t: pa.Table) -> pa.Table:
        ids, known, target, n, *total = unpacked(next(x for x in t.column("docs").to_pylist() if x is not None), 6)
        total = np.stack(total)
        for z in t.column("entries").to_pylist():
            if z is not None:
                d, *loss = unpacked(z, 3)
                total[:, np.cumsum(d)] += np.stack(loss)
        mean, empty = total / np.maximum(n, 1) / ONE, n == 0
        return pa.table({"doc_id": pa.array(ids, mask=known == 0), "target": pa.array(target), "n_tokens": pa.array(n), "target_loss": pa.array(mean[0], mask=empty), "background_loss": pa.array(mean[1], mask=empty)})

    pieces = stored(rows.mapInArrow(cut_up, step))
    entries = pieces.filter("entries is not null").select("batch", "bucket", "entries")
    # a pair that very many documents have makes its bucket large: it is counted and settled in parts
    size = F.sum(F.octet_length("entries"))
    large = stored(entries.groupBy("bucket").agg(size.alias("size")).filter(F.col("size") > LARGE * bucket_bytes).select("bucket", F.ceil(F.col("size") / bucket_bytes).alias("parts")))
    done = "batch long, entries binary, docs binary"
    settled = entries.join(large, "bucket", "left_anti").groupBy("bucket").applyInArrow(frugal(settle), done)
    dealt = entries.join(large, "bucket").withColumn("part", F.pmod(F.xxhash64("batch"), F.col("parts"))).drop("parts")
    partial = dealt.groupBy("bucket", "part").applyInArrow(frugal(count_part), "bucket long, counts binary")
    counts = partial.groupBy("bucket").applyInArrow(frugal(add_up), "bucket long, counts binary")
    to_parts = counts.join(large, "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "counts")
    in_parts = dealt.unionByName(to_parts, allowMissingColumns=True).groupBy("bucket", "part").applyInArrow(frugal(settle_part), done)
    documents = pieces.filter("docs is not null").select("batch", F.lit(None).cast("binary").alias("entries"), "docs")
    return documents.unionByName(settled).unionByName(in_parts).groupBy("batch").applyInArrow(frugal(gather), "doc_id long, target long, n_tokens long, target_loss double, background_loss double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, max_target: int | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score, selected), with the documents labelled as good quality for the target.

    The target model has fewer tokens than the background, which lifts every score; selected are the documents that are
    nearer to the mean score of the target documents (of which each is scored without its own counts) than to the mean of all.
    """
    rows = flagged(docs, labels.filter("quality = 1"), max_target)
    scored = stored(score(rows, fit(rows), bucket_bytes).withColumn("score", F.col("target_loss") - F.col("background_loss")))
    means = scored.agg(F.avg(F.when(F.col("target") == 1, F.col("score"))).alias("good"), F.avg("score").alias("every")).first()
    limit = (means.good + means.every) / 2 if means.good is not None else 0.0
    return scored.select("doc_id", "n_tokens", "target_loss", "background_loss", "score", F.coalesce(F.col("score") < limit, F.lit(False)).alias("selected"))
