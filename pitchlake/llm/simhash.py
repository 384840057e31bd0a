"""Near-duplicate documents by SimHash, with deletion-variant signatures.

The 64 bits of a fingerprint are cut into so few segments that two fingerprints
that differ in at most ``max_bits`` bits differ in at most one bit in some
segment. Each fingerprint is indexed under every segment with one bit left out
(a wildcard); an equality join on these variants finds all pairs, which are
verified inside the join. A pair can meet under several variants and is kept
under the first one only, so each link is made once.

Copies never meet in the join: it works on distinct fingerprints.

near_duplicates() links by bits alone, at any 64-bit distance. At a similarity of
0.8 some 15 % of bits differ, which no few bits of 64 can tell from chance:
similar() therefore takes wide fingerprints with the same signatures, and settles
what they propose by the exact similarity of the shingle sets.

Defined results: a null or wordless text has fingerprint zero, which links like
any other; a null doc_id takes part and gets the component of its fingerprint
(whose id is the smallest non-null doc_id, or null if there is none); repeated
rows are each returned; ties go to the smallest doc_id; very long texts are
fingerprinted whole, part by part; an empty table gives an empty result; other
columns of the input are ignored. In similar(), null and wordless texts are copies
of each other and rows without a doc_id take no part; one_of_each() keeps these.
Rows that share a doc_id are judged by their own texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import cut, free_name, id_text, map_batches, stored, utf8
from pitchlake.llm.components import connected_components
from pitchlake.llm.textkernels import NONSPACE, chunked, gram_hashes, mix, span_hashes, word_table

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: similar(): words of a shingle; least similarity, as a fraction; 64-bit words of a fingerprint; bits that are sure to be found.
WIDE_SHINGLE = 5
LEAST = (4, 5)
WIDE_WORDS = 6
WIDE_MAX_BITS = 37
#: Of 384 bits, 58 differ on average at similarity 0.8 (deviation 6), 50 at 0.85, 192 by chance. Pairs up to NEAR come first,
#: a leader with each; then, between components, all up to PROPOSE.
NEAR = 50
PROPOSE = 72
WORD_SEEDS = mix(np.arange(1, WIDE_WORDS + 1, dtype=np.uint64))
#: Shingles whose bits are counted at once, and rows of a group that are compared at once.
PART = 1 << 14
GROUP_ROWS = 1 << 15


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, unsigned."""
    words = raw.lower().split() if raw else []  # of bytes: both treat ASCII only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        stop = ends[shingle - 1 :] - 1
        start = np.concatenate(([0], ends[: len(stop) - 1]))
        hashes = [digest(line[s:e], SEED) for s, e in zip(start.tolist(), stop.tolist(), strict=True)]
    n = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(id_text(docs, id_col, text_col).withColumn("text", utf8("text")), run, "doc_id long, fp long")


def segments(max_bits: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments of which one differs by at most one bit."""
    n = max_bits // 2 + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): pairs a < b of the distinct fingerprints in fps(fp) that differ in at most max_bits bits, each once."""
    segs = segments(max_bits)
    wide = max(n for _, n in segs)
    masks = [((1 << n) - 1) << at for at, n in segs]
    variants = [(s, bit) for s, (_, n) in enumerate(segs) for bit in range(n)]
    first = {s: next(v for v, (t, _) in enumerate(variants) if t == s) for s in range(len(segs))}

    def variant(v: int, s: int, bit: int) -> Column:
        at, _ = segs[s]
        rest = F.col("fp").bitwiseAND(F.lit(signed(masks[s] & ~(1 << (at + bit)))))
        return F.shiftrightunsigned(rest, at) + F.lit(v << wide)

    keyed = fps.select("fp", F.explode(F.array(*[variant(v, s, bit) for v, (s, bit) in enumerate(variants)])).alias("key"))
    a, b = F.col("a.fp"), F.col("b.fp")
    diff = a.bitwiseXOR(b)
    v = F.shiftright("a.key", wide)
    in_seg = [diff.bitwiseAND(F.lit(signed(m))) for m in masks]
    once = F.lit(False)
    for s in range(len(segs)):
        here = (v >= first[s]) & (v < first[s] + segs[s][1]) & ((in_seg[s] != 0) | (v == first[s]))
        for t in range(s):
            here &= F.bit_count(in_seg[t]) > 1
        once |= here
    # no broadcast: Spark takes the exploded variants to be as small as the fingerprints that they come from
    met = keyed.alias("a").hint("merge").join(keyed.alias("b"), (F.col("a.key") == F.col("b.key")) & (a < b) & (F.bit_count(diff) <= max_bits) & once)
    return met.select(a.alias("a"), b.alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links."""
    fps = stored(fingerprints(docs, shingle, id_col, text_col))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    label = connected_components(cut(links(nodes.select("fp"), max_bits)), "a", "b")  # (node, root), linked ones only
    rooted = nodes.join(label, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = rooted.filter(F.col("root").isNotNull()).join(smallest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- links at a given similarity, by wide fingerprints


def shingle_sets(raws: list[bytes], k: int = WIDE_SHINGLE) -> list[np.ndarray]:
    """Of each text: sorted hashes of its distinct shingles."""
    out: list[np.ndarray] = []
    for lo, hi in chunked(raws):
        buf, starts, ends, bounds = word_table(raws[lo:hi], NONSPACE)
        words = span_hashes(buf, starts, ends)
        grams = gram_hashes(words, k)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            n = b - a
            out.append(np.unique(grams[a : b - k + 1]) if n >= k else gram_hashes(words[a:b], n) if n else words[:0])
    return out


def set_name(shingles: np.ndarray) -> int:
    """A hash of the set, as a signed number; 0 for the empty one."""
    return int(mix(mix(shingles ^ np.uint64(len(shingles))).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]) if len(shingles) else 0


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WIDE_WORDS words of 64 bits of a set of shingle hashes."""
    ones = np.zeros(64 * WIDE_WORDS, dtype=np.int64)
    for i in range(0, len(shingles), PART):
        part = mix(shingles[i : i + PART, None] ^ WORD_SEEDS)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8 * WIDE_WORDS), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")


def segment_bits(fps: np.ndarray, at: int, n: int) -> np.ndarray:
    """Bits at:at+n of wide fingerprints (rows of words)."""
    word, shift = divmod(at, 64)
    bits = fps[:, word] >> np.uint64(shift)
    if shift + n > 64:
        bits = bits | fps[:, word + 1] << np.uint64(64 - shift)
    return bits & np.uint64((1 << n) - 1)


#: Each segment in two halves: where at most one bit of it differs, one half is equal.
WIDE_SEGMENTS = segments(WIDE_MAX_BITS, 64 * WIDE_WORDS)
HALVES = [(at + first, n, at + other, m) for at, w in WIDE_SEGMENTS for first, n, other, m in ((0, w // 2, w // 2, w - w // 2), (w // 2, w - w // 2, 0, w // 2))]
FP = [f"f{i}" for i in range(WIDE_WORDS)]


def text_digest(text: str) -> Column:
    """Tells texts apart; null and empty are one."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, f0..) of docs(doc_id, text): its text's digest, the name of its shingle set, and its wide fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([r or b"" for r in batch.column("raw").to_pylist()])
        fps = np.stack([wide_fingerprint(s) for s in sets]).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array([set_name(s) for s in sets], pa.int64()), *[pa.array(fps[:, i]) for i in range(WIDE_WORDS)]], ["doc_id", "digest", "node", *FP])

    return map_batches(docs.select("doc_id", text_digest("text").alias("digest"), utf8("text").alias("raw")), run, f"doc_id long, digest string, node long, {', '.join(f'{f} long' for f in FP)}", by="raw")


NODE = ["node", "root", "size", *FP]
NODE_SCHEMA = ", ".join(f"{c} long" for c in NODE)


def keyed_halves(nodes: DataFrame) -> DataFrame:
    """(key, *NODE): each node once for each half of each segment; key holds the half's number and bits."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.stack([batch.column(f).to_numpy() for f in FP], axis=1).view(np.uint64)
        key = np.concatenate([segment_bits(fps, at, n).astype(np.int64) | h << 32 for h, (at, n, _, _) in enumerate(HALVES)])
        rows = batch.take(pa.array(np.tile(np.arange(batch.num_rows), len(HALVES))))
        return pa.RecordBatch.from_arrays([pa.array(key), *rows.columns], ["key", *NODE])

    return map_batches(nodes.select(*NODE), run, f"key long, {NODE_SCHEMA}")


def first_half(diff: np.ndarray) -> np.ndarray:
    """Of differences between fingerprints that share a variant: the first half under which they do."""
    out = np.full(len(diff), len(HALVES), dtype=np.int64)
    for h in range(len(HALVES) - 1, -1, -1):
        at, n, other, m = HALVES[h]
        out[(segment_bits(diff, at, n) == 0) & (np.bitwise_count(segment_bits(diff, other, m)) <= 1)] = h
    return out


def near_pairs(half: int, rows: np.ndarray, star: bool, bit: int | None = None, apart: np.ndarray | None = None, spoken: list[np.ndarray] | None = None, nearest: bool = False) -> list[np.ndarray]:
    """Pairs of nodes that share a variant and nearly agree as a whole. rows are (node, root, size, fingerprint) in order of (size, root, node).

    All share a half; a variant is the other half with one bit left out (only that bit, if given: then all rows share it).
    Under each variant, the first row leads: it is
    compared with the rest and leaves, until none is left. As a star, those within NEAR bits of it are its pairs and leave
    with it, so that there are no more pairs than rows; these are added to spoken, if it is given. Else its pairs are those of other roots within PROPOSE bits, and a
    variant is through when all that are left have one root: the largest component is only ever compared with. Where
    apart is given, only rows that differ in it are pairs. With nearest, of a leader's pairs with one root only the nearest
    is told, and (in a third row) whether there are more.

    A pair is told under the first half that the two share. A star still leaves no row alone: if the pair with its leader is left
    out here, the row leads or has a leader under that earlier half.
    """
    node, root, fps = rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
    _, _, at, n = HALVES[half]
    rest, bits_out = segment_bits(fps, at, n), range(n) if bit is None else [bit]
    variant = np.concatenate([(rest & ~np.uint64(1 << b)) | np.uint64(b << 32) for b in bits_out])
    row = np.tile(np.arange(len(node)), len(bits_out))
    by = np.argsort(variant, kind="stable")
    variant, row = variant[by], row[by]
    found = []
    while len(row):
        first = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
        sizes = np.diff(np.append(first, len(row)))
        open_ = sizes > 1 if star else root[row[first]] != root[row[first + sizes - 1]]
        keep = np.repeat(open_, sizes)
        variant, row, sizes = variant[keep], row[keep], sizes[open_]
        if not len(row):
            break
        first = np.cumsum(sizes) - sizes
        lead = np.repeat(row[first], sizes)
        bits = np.bitwise_count(fps[row] ^ fps[lead]).sum(axis=1, dtype=np.int64)
        near = (bits <= NEAR) & (row != lead) if star else (bits <= PROPOSE) & (root[row] != root[lead])
        if apart is not None:
            near &= apart[row] != apart[lead]
        pair = np.unique(np.stack([lead[near], row[near]]), axis=1)
        if star and spoken is not None:
            spoken.append(node[pair[1]])
        pair = pair[:, first_half(fps[pair[0]] ^ fps[pair[1]]) == half]  # the two meet under each half that they share: it is told once
        if bit and not star:  # and under each bit, where the whole half is equal: under the first
            pair = pair[:, rest[pair[0]] != rest[pair[1]]]
        if nearest:
            apart_by = np.bitwise_count(fps[pair[0]] ^ fps[pair[1]]).sum(axis=1, dtype=np.int64)
            pair = pair[:, np.lexsort((pair[1], apart_by, root[pair[1]], pair[0]))]
            to = np.stack([pair[0], root[pair[1]]])
            at_first = np.flatnonzero(np.concatenate(([True], (to[:, 1:] != to[:, :-1]).any(axis=0)))) if pair.shape[1] else np.empty(0, dtype=np.int64)
            many = np.diff(np.append(at_first, pair.shape[1])) > 1
            found.append(np.concatenate([node[pair[:, at_first]], [many]]))
        else:
            found.append(node[pair])
        left = row != lead
        if star:
            left &= ~near
        variant, row = variant[left], row[left]
    return found


#: A key is a half's number above 32 bits that hold its bits; in a key by variant, the bit left out, and the other half's bits, too.
HALF_AT, BIT_AT, OTHER_AT, BY_VARIANT = 32, 40, 48, 1 << 62


def half_keys() -> Column:
    """keyed_halves()' keys of a row, worked out without Python, to be counted."""
    word = [F.col(f) for f in FP]

    def bits(at: int, n: int) -> Column:
        w, shift = divmod(at, 64)
        low = F.shiftrightunsigned(word[w], shift)
        return (low if shift + n <= 64 else low.bitwiseOR(F.shiftleft(word[w + 1], 64 - shift))).bitwiseAND(F.lit((1 << n) - 1))

    return F.array(*[bits(at, n).bitwiseOR(F.lit(h << HALF_AT)) for h, (at, n, _, _) in enumerate(HALVES)])


def keyed_variants(rows: DataFrame) -> DataFrame:
    """keyed_halves()' rows, each once for every bit of the other half that is left out: what shares a key is one variant."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = batch.column("key").to_numpy()
        fps = np.stack([batch.column(f).to_numpy() for f in FP], axis=1).view(np.uint64)
        keys, taken = [], []
        for h in np.unique(key >> HALF_AT).tolist():
            mine = np.flatnonzero(key >> HALF_AT == h)
            _, _, at, n = HALVES[h]
            rest = segment_bits(fps[mine], at, n).astype(np.int64)
            for b in range(n):
                keys.append(BY_VARIANT | (rest & ~(1 << b)) << OTHER_AT | b << BIT_AT | h << HALF_AT | key[mine] & (1 << HALF_AT) - 1)
                taken.append(mine)
        rows = batch.select(NODE).take(pa.array(np.concatenate(taken)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *rows.columns], ["key", *NODE])

    return map_batches(rows.select("key", *NODE), run, f"key long, {NODE_SCHEMA}")


def spread(nodes: DataFrame) -> DataFrame:
    """(key, low, high, part, *NODE): keyed_halves() in groups (key, low, high) of about GROUP_ROWS rows, however many rows share a key.

    Halves that more rows share are dealt by whole variants, of which there are a thousand times as many. What is still
    larger, as a family of near copies may be, is cut into parts by a hash of the node, and each two parts meet
    in one group: there only rows of different parts are pairs, and each part has a group for its own pairs.
    """
    large = nodes.select(F.explode(half_keys()).alias("key")).groupBy("key").count().filter(F.col("count") > GROUP_ROWS).select("key")
    keyed = keyed_halves(nodes)
    large = F.broadcast(stored(large))  # of some 60,000 keys that there can be, whatever the corpus
    usual = keyed.join(large, "key", "left_anti").select("key", *[F.lit(0).cast("long").alias(c) for c in ("low", "high", "part")], *NODE)
    by_variant = keyed_variants(keyed.join(large, "key", "left_semi"))
    sizes = by_variant.groupBy("key").count().filter(F.col("count") > GROUP_ROWS).select("key", F.ceil(F.col("count") / GROUP_ROWS).alias("parts"))
    dealt = by_variant.join(sizes, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return usual.unionByName(dealt.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", *NODE))


def proposed(nodes: DataFrame, star: bool, nearest: bool = False) -> DataFrame:
    """(a, b) with a < b: near_pairs() of nodes(*NODE); some come several times. With nearest, also more: 1 if some of the leader's pairs with that root are not told.

    As a star, leaders of a large group that goes by in parts stay, GROUP_ROWS of them at most: what it misses
    the other form finds.
    """

    names = ["a", "b", "more"] if nearest else ["a", "b"]

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        ab = np.concatenate([np.empty((len(names), 0), dtype=np.int64), *found], axis=1)
        ab[:2] = np.sort(ab[:2], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(ab, axis=1)], names)

    def pairs(at: tuple[int, int, int], held: list[np.ndarray], spoken: list[np.ndarray] | None = None) -> list[np.ndarray]:
        rows = np.concatenate(held)
        if len(rows) < 2:
            return []
        key, low, high = at
        half, bit = (key >> HALF_AT & 0xFF, key >> BIT_AT & 0xFF) if key & BY_VARIANT else (key >> HALF_AT, None)
        return near_pairs(half, rows[:, 1:], star, bit, rows[:, 0] if low != high else None, spoken, nearest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")], axis=1)
            rows = np.stack([batch.column(c).to_numpy() for c in ("part", *NODE)], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))).tolist() if len(key) else []
            found: list[np.ndarray] = []
            for lo, hi in zip(edges, [*edges, len(key)][1:], strict=True):
                if (now := tuple(key[lo].tolist())) != at:
                    found += pairs(at, held) if held else []
                    at, held, size = now, [], 0
                held.append(rows[lo:hi])
                size += hi - lo
                if star and size > 2 * GROUP_ROWS:
                    spoken: list[np.ndarray] = [rows[:0, 1]]
                    found += pairs(at, held, spoken)
                    held = np.concatenate(held)
                    held = [held[~np.isin(held[:, 1], np.concatenate(spoken))][:GROUP_ROWS]]
                    size = len(held[0])
            yield out(found)
        if held:
            yield out(pairs(at, held))

    keyed = keyed_halves(nodes).select("key", *[F.lit(0).cast("long").alias(c) for c in ("low", "high", "part")], *NODE) if star else spread(nodes)
    order = ["key", "low", "high", "size", "root", "node"]
    return keyed.repartition("key", "low", "high").sortWithinPartitions(*order).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the sets in wanted(doc_id, node), read again from their documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes = batch.column("node").to_pylist()
        sets = zip(nodes, shingle_sets([r or b"" for r in batch.column("raw").to_pylist()]), strict=True)
        same = [(n, s) for n, s in sets if set_name(s) == n]  # a doc_id can have several texts
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in same], pa.int64()), pa.array([s.view(np.int64) for _, s in same], pa.list_(pa.int64()))], ["node", "shingles"])

    rows = docs.join(wanted, "doc_id").select("node", utf8("text").alias("raw"))
    return map_batches(rows, run, "node long, shingles array<long>", by="raw").dropDuplicates(["node"])


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs(a, b) whose sets have the least similarity or more."""
    num, den = LEAST
    x, y = (shingles.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))  # within the row, without Python
    return pairs.join(x, "a").join(y, "b").filter(den * both >= num * (F.size("x") + F.size("y") - both)).select("a", "b")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, root, component_id) of each row of docs(doc_id, text) with a doc_id; links are pairs of texts whose five-word shingle
    sets have a similarity of LEAST or more; component_id is the smallest doc_id reachable over links, root tells groups apart that share one; digest is text_digest()."""
    docs = docs.filter("doc_id is not null")
    sketched = stored(sketches(docs))
    nodes = stored(sketched.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.min(f).alias(f) for f in FP]))

    def links(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        shingles = stored(contents(docs, nodes.join(ends, "node").select(F.col("rep").alias("doc_id"), "node")))
        return cut(verified(pairs, shingles))

    def placed(label: DataFrame) -> DataFrame:
        sizes = label.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        return stored(some.join(label.join(sizes, "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), *FP))

    def merged(label: DataFrame, more: DataFrame) -> DataFrame:
        return connected_components(label.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b")

    some = nodes.filter("node != 0")
    label = connected_components(links(stored(proposed(some.select("*", F.col("node").alias("root"), F.lit(1).cast("long").alias("size")), star=True).distinct())), "a", "b")
    # between components: the nearest of each that a row meets, as one link joins the two; what stays apart and has more, in full
    near = stored(proposed(placed(label), star=False, nearest=True).groupBy("a", "b").agg(F.max("more").alias("more")))
    label = merged(label, links(near.select("a", "b")))
    now = placed(label)
    root_of = lambda end: now.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    open_ = near.filter("more = 1").join(root_of("a"), "a").join(root_of("b"), "b").filter("root_a != root_b")
    roots = stored(open_.select(F.explode(F.array("root_a", "root_b")).alias("root")).distinct())
    if not roots.isEmpty():
        rest = proposed(now.join(roots, "root", "left_semi").select(*NODE), star=False).distinct().join(near, ["a", "b"], "left_anti")
        label = merged(label, links(stored(rest)))  # (node, root), linked ones only
    rooted = nodes.join(label, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_node = rooted.join(smallest, "root").select("node", "root", "component_id")
    return sketched.select("doc_id", "digest", "node").join(by_node, "node")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of the rows with a doc_id, by grouped()."""
    return grouped(id_text(docs, id_col, text_col)).select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group in grouped(). Rows without a doc_id stay.

    Of a group it is a row of the smallest doc_id, with the smallest digest of its text where that doc_id has several texts; of equal
    rows, one. Each row is judged by its own text, also where a doc_id is repeated.
    """
    groups = grouped(id_text(docs)).filter("doc_id = component_id").groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    # texts that differ but are in one group, under the same doc_id: the first stands for them
    first = groups.groupBy("root").agg(F.min("digest").alias("digest"))
    own, text, many = (free_name(docs, n) for n in ("kept_id", "kept_text", "kept_rows"))
    keep = groups.join(first, ["root", "digest"]).select(F.col("doc_id").alias(own), F.col("digest").alias(text), F.col("n").alias(many))
    mine = docs.join(keep, (F.col("doc_id").cast("long") == F.col(own)) & (text_digest("text") == F.col(text)))
    several = mine.filter(F.col(many) > 1).dropDuplicates([own, text])  # rows that repeat, only these are shuffled
    return mine.filter(F.col(many) == 1).unionByName(several).select(*docs.columns).unionByName(docs.filter("doc_id is null"))
