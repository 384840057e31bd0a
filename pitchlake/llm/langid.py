"""Language identification by prediction by partial matching.

For each language, byte counts in contexts of 0 to 3 bytes form a context tree.
A byte seen in its context costs -log2(c / (n + q)) bits, where the context
came n times with q different bytes after it, c times with this one; an unseen
byte costs the escape, -log2(q / (n + q)), and then what it costs in the next
shorter context, down to 8 bits flat. After training, the statistics are
frozen. A tree is kept sparse, as sorted tables of the grams and contexts that
were seen, each with its bits: no context is left out, and a language takes as
much memory as its own tree. A text's exact code length is a sum of table look-ups.

Training uses labelled documents outside the held-out fifth, a seeded sample of
about ``docs_per_lang`` of each language (the whole language if it has fewer),
which bounds the model whatever the corpus holds; scoring covers every document
in full.

Defined results: a null or empty text or one without letters is `und` with score
0, and so is everything if no document can be learned from; a null doc_id is
never learned from and not held out; ties go to the first language by name; very
long texts are read in parts, whole; repeated rows each get a row; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import map_batches, utf8
from pitchlake.llm.textkernels import chunked

ORDER = 3
DOCS_PER_LANG = 400
START = b"\n" * ORDER
LETTER = regex.compile(r"\p{L}")


@dataclass
class Tree:
    """Bits of one language's grams and escapes, by order: sorted keys and costs. A key is its bytes as a number."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]
    prior: np.ndarray  # bits, by language


def grams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte grams of the texts, each after START, and their counts."""
    counts: dict[int, int] = {}
    for lo, hi in chunked(raws):
        b = np.frombuffer(START + START.join(raws[lo:hi]), dtype=np.uint8).astype(np.uint32)
        starts = np.cumsum([0] + [len(r) + ORDER for r in raws[lo : hi - 1]])
        code = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        own = np.ones(len(code), dtype=bool)
        for k in range(1, ORDER + 1):  # grams that run from one text into the next
            own[(starts[1:] - k)[starts[1:] - k < len(own)]] = False
        keys, n = np.unique(code[own], return_counts=True)
        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
            counts[k] = counts.get(k, 0) + c
    return np.fromiter(counts.keys(), dtype=np.int64, count=len(counts)), np.fromiter(counts.values(), dtype=np.int64, count=len(counts))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Context trees of the languages of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not seen:
        return Model([], [], np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang, n in seen.items() for x in (lang, docs_per_lang / n)])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(unit < F.element_at(share, F.col("lang"))).select("lang", utf8("text").alias("raw"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_lang: dict[str, list[bytes]] = {}
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(raw)
        found = [(lang, *grams(raws)) for lang, raws in by_lang.items()]
        return pa.RecordBatch.from_arrays([pa.array([lang for lang, k, _ in found for _ in k], pa.string()), pa.array(np.concatenate([k for _, k, _ in found])), pa.array(np.concatenate([n for *_, n in found]))], ["lang", "gram", "n"])

    table = map_batches(sample, count, "lang string, gram long, n long", by="raw", most=4 << 20).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(seen)
    return build([(table[table.lang == x].gram.to_numpy(np.int64), table[table.lang == x].n.to_numpy(np.int64)) for x in langs], langs, [seen[x] for x in langs])


def build(by_lang: list[tuple[np.ndarray, np.ndarray]], langs: list[str], sizes: list[int]) -> Model:
    """Freeze gram counts into trees."""
    trees = []
    for gram, count in by_lang:
        tree = Tree([], [])
        for k in range(ORDER + 1):
            keys, at = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.bincount(at, weights=count, minlength=len(keys))
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            n, q = np.bincount(of, weights=c, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
            tree.grams.append((keys, np.log2((n + q)[of] / c)))
            tree.escapes.append((contexts, np.log2((n + q) / q)))
        trees.append(tree)
    return Model(langs, trees, -np.log2(np.array(sizes) / sum(sizes)))


def looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the table, and its cost if so (else 0)."""
    if not len(table[0]):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    found = table[0][at] == keys
    return found, np.where(found, table[1][at], 0.0)


def gram_costs(codes: np.ndarray, tree: Tree) -> np.ndarray:
    """Bits of the last byte of each four-byte gram."""
    bits, left = np.zeros(len(codes)), np.arange(len(codes))
    for k in range(ORDER, -1, -1):
        keys = codes[left] & ((1 << 8 * (k + 1)) - 1)
        found, cost = looked_up(tree.grams[k], keys)
        bits[left[found]] += cost[found]
        left, keys = left[~found], keys[~found]
        bits[left] += looked_up(tree.escapes[k], keys >> 8)[1]
    bits[left] += 8.0
    return bits


def distinct_of(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and each key's place among them; keys are below size. A table where it is small, else a sort."""
    if size > 1 << 24:
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(size, dtype=bool)
    seen[keys] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[keys]


def code_lengths(raws: list[bytes], model: Model) -> np.ndarray:
    """Bits of each text under each language, without priors."""
    out = np.zeros((len(raws), len(model.langs)))
    for lo, hi in chunked(raws):
        lengths = np.array([len(r) for r in raws[lo:hi]])
        full = np.flatnonzero(lengths)
        if not len(full):
            continue
        b = np.frombuffer(START + START.join(raws[lo:hi]), dtype=np.uint8)
        inside = np.ones(len(b), dtype=bool)  # bytes of the texts themselves
        starts = np.cumsum(lengths + ORDER) - lengths
        inside[:ORDER] = False
        for j in range(1, ORDER + 1):
            inside[starts[1:] - j] = False
        used, c = distinct_of(b, 256)
        a = len(used)
        contexts, before = distinct_of(((c[:-3] * a + c[1:-2]) * a + c[2:-1])[inside[3:]], a**3)
        distinct, back = distinct_of(before.astype(np.int64) * a + c[3:][inside[3:]], len(contexts) * a)
        contexts, last = contexts[distinct // a], distinct % a
        codes = used[contexts // (a * a)] << 24 | used[contexts // a % a] << 16 | used[contexts % a] << 8 | used[last]
        first = np.cumsum(lengths[full]) - lengths[full]
        for x, tree in enumerate(model.trees):
            out[lo + full, x] = np.add.reduceat(gram_costs(codes, tree)[back], first)
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): score is the best language's posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = classify(batch.column("text").to_pylist(), shared.value)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(rows, run, "doc_id long, lang_pred string, score double", by="text", most=4 << 20)


def classify(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    bits = code_lengths([(t or "").encode("utf-8") for t in texts], model) + model.prior
    langs, scores = [], []
    for text, row in zip(texts, bits, strict=True):
        if text is None or not model.langs or not LETTER.search(text):
            langs.append("und")
            scores.append(0.0)
        else:
            best = int(np.argmin(row))
            langs.append(model.langs[best])
            scores.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
    return langs, scores


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text is in one of the model's languages (not `und`)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, _ = classify(batch.column(text_col).to_pylist(), shared.value)
        return batch.filter(pa.array([x != "und" for x in langs]))

    return map_batches(docs, run, docs.schema, by=text_col, most=4 << 20)


def identify(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from docs itself."""
    return predict(docs, fit(docs, docs_per_lang)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
