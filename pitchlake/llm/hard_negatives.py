"""Hard-negative mining by exact inner products, through an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a pair of code
words is a cell. For a query q, no row of cell (i, j) scores more than the sum of
two half-scores, q1.c_i + |q1| r_i and q2.c_j + |q2| r_j, where r is the largest
distance of any row's half from its code word. A multi-sequence heap takes cells by
that sum, falling, and stops as soon as it is below what each window of the query
is already certain to reach: the window's lower end, or its k-th best score among
the rows of a bounded sample of the index. Cells whose rows all score above every
window are passed over, too. So results are exact; how many cells are visited
depends on how the vectors cluster (without clusters, all of them).

Codebooks are fitted on at most SAMPLE rows; every row is indexed. Rows of a cell
stand in blocks of some thousand rows (more, the more rows there are, up to MOST_BLOCK), small neighbouring cells together, a large cell
(many equal vectors) in several. A block's rows meet the queries that
visit it in one task, which holds one block and streams the queries; it gives at
most k rows a query and window, and the best k of all blocks are kept by a window
function, whose limit is applied before the shuffle.

Positives are searched first (one window without ends, own label), then the windows
that they span (other labels).

Defined results: rows whose id, label or vector is null, whose vector is empty, holds a
null, NaN or infinity, or has another length than most take no part; ties go to the
smaller id; rows that share an id are rows of their own, but never each other's
positives; repeated rows repeat in results; a negative positive score spans no
window; other columns are ignored; an empty table, or one without anchors,
positives or negatives, gives no rows. Scores beyond a long are an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import release, stored
from pitchlake.llm.vectors import matrix, products, same_length, sound, whole

#: Rows that codebooks and first bounds are taken from.
SAMPLE = 4096
#: Code words of a half.
CODES = 32
#: Rows of a block: a share of all, within these bounds; with larger ones a query is sent to fewer.
BLOCK_SHARE, LEAST_BLOCK, MOST_BLOCK = 64, 1 << 12, 1 << 17
#: Queries that are routed together, and scores that are held at once.
QUERIES, SCORES = 256, 1 << 22
#: Below and above every score.
LEAST, MOST = -(1 << 62), 1 << 62

ROWS = "block int, query boolean, id long, label int, x array<long>"
ASKED = ROWS + ", ask long, same boolean, low array<long>, high array<long>"
FOUND = "ask long, window int, id long, score long"


# --- the index


def codebook(x: np.ndarray, codes: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Code words of the rows of x by k-means, started from rows taken in turn with chances that grow with their distance."""
    rng, x = np.random.default_rng(seed), x.astype(np.float64)
    words = [x[rng.integers(len(x))]]
    far = ((x - words[0]) ** 2).sum(axis=1)
    while len(words) < codes and far.sum() > 0:
        words.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - words[-1]) ** 2).sum(axis=1))
    words = np.array(words)
    for _ in range(rounds):
        own = nearest(x, words)[0]
        for c in np.unique(own):
            words[c] = x[own == c].mean(axis=0)
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's code word and its distance from it."""
    code = ((words**2).sum(axis=1) - 2 * (x.astype(np.float64) @ words.T)).argmin(axis=1)
    return code, np.sqrt(((x - words[code]) ** 2).sum(axis=1))


@dataclass(frozen=True)
class Index:
    """Codebooks, radii (upper bounds), the blocks of each cell, and the sample's rows."""

    half: int
    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    first_block: np.ndarray  # by cell, -1 where it has no rows
    n_blocks: np.ndarray
    sample_ids: np.ndarray
    sample_labels: np.ndarray
    sample: np.ndarray

    def visits(self, q: np.ndarray, low: int, high: int) -> set[int]:
        """Blocks with a cell that may hold a score from low to high, by the multi-sequence heap."""
        halves = q[: self.half].astype(np.float64), q[self.half :].astype(np.float64)
        centre = [w @ h for w, h in zip(self.words, halves, strict=True)]
        reach = [np.linalg.norm(h) * r for h, r in zip(halves, self.radii, strict=True)]
        # a little more than the bounds, for the rounding of doubles
        slack = 1 + 1e-9 * sum(float(np.abs(c).max() + r.max()) for c, r in zip(centre, reach, strict=True))
        turn = [np.argsort(-(c + r)) for c, r in zip(centre, reach, strict=True)]
        best = [(c + r)[t] for c, r, t in zip(centre, reach, turn, strict=True)]
        worst = [(c - r)[t] for c, r, t in zip(centre, reach, turn, strict=True)]
        codes = len(self.words[1])
        heap, out = [(-(best[0][0] + best[1][0]), 0, 0)], set()
        while heap:
            bound, i, j = heapq.heappop(heap)
            if slack - bound < low:
                break
            cell = int(turn[0][i]) * codes + int(turn[1][j])
            if self.n_blocks[cell] and worst[0][i] + worst[1][j] - slack <= high:
                out.update(range(self.first_block[cell], self.first_block[cell] + self.n_blocks[cell]))
            # each pair enters once: along the second half always, along the first from its start only
            if j + 1 < len(best[1]):
                heapq.heappush(heap, (-(best[0][i] + best[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(best[0]):
                heapq.heappush(heap, (-(best[0][i + 1] + best[1][0]), i + 1, 0))
        return out


def labelled(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, x) of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & sound("v"))
    return same_length(rows.select("id", "label", whole("v").alias("x")), "x")


def build(rows: DataFrame, codes: int = CODES, sample: int = SAMPLE, block: int | None = None, seed: int = 42) -> tuple[DataFrame, Index] | None:
    """Every row with its block, as a stored table, and the index; None without rows."""
    spark = rows.sparkSession
    few = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id", "label", "x").limit(sample).collect()
    if not few:
        return None
    x = np.array([r.x for r in few], dtype=np.int64)
    half = x.shape[1] // 2
    words = codebook(x[:, :half], codes, seed=seed), codebook(x[:, half:], codes, seed=seed + 1)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            (a, far_a), (b, far_b) = nearest(x[:, :half], words[0]), nearest(x[:, half:], words[1])
            own = [pa.array(a * len(words[1]) + b, pa.int32()), pa.array(far_a), pa.array(far_b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "cell", "far_a", "far_b"])
        release()

    coded = stored(rows.mapInArrow(code, "id long, label int, x array<long>, cell int, far_a double, far_b double"))
    cells = coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("far_a").alias("far_a"), F.max("far_b").alias("far_b")).orderBy("cell").collect()  # a row for each pair of code words at most
    block = block or min(MOST_BLOCK, max(LEAST_BLOCK, sum(c.n for c in cells) // BLOCK_SHARE))
    radii = np.zeros(len(words[0])), np.zeros(len(words[1]))
    first, parts = np.full(len(words[0]) * len(words[1]), -1), np.zeros(len(words[0]) * len(words[1]), dtype=np.int64)
    at, room = -1, 0
    for c in cells:
        i, j = divmod(c.cell, len(words[1]))
        radii[0][i], radii[1][j] = max(radii[0][i], c.far_a * (1 + 1e-9)), max(radii[1][j], c.far_b * (1 + 1e-9))
        if c.n > room:
            at, room = at + 1, block
        first[c.cell], parts[c.cell] = at, max(1, -(-c.n // block))
        at += int(parts[c.cell]) - 1
        room = max(0, room - c.n) if parts[c.cell] == 1 else 0
    index = Index(half, words, radii, first, parts, np.array([r.id for r in few]), np.array([r.label for r in few]), x)
    place = spark.createDataFrame([(int(c.cell), int(first[c.cell]), int(parts[c.cell])) for c in cells], "cell int, first int, parts int")
    dealt = coded.select("id", "label", "x", "cell", F.monotonically_increasing_id().alias("row")).join(F.broadcast(place), "cell")
    return dealt.select((F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).alias("block"), F.lit(False).alias("query"), "id", "label", "x"), index


# --- the search


def routed(asks: DataFrame, index: Index, k: int) -> DataFrame:
    """Each query (ask, id, label, x, same, low, high) once for every block that it visits, with windows raised to what the sample makes certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, QUERIES):
                batch = whole_batch.slice(start, QUERIES)
                x, ids, labels = matrix(batch.column("x")), batch.column("id").to_pylist(), batch.column("label").to_pylist()
                scores = products(x, index.sample)
                rows, lows, blocks = [], [], []
                for i, (same, low, high) in enumerate(zip(batch.column("same").to_pylist(), batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True)):
                    fits = (index.sample_labels == labels[i]) & (index.sample_ids != ids[i]) if same else index.sample_labels != labels[i]
                    own = np.sort(scores[i][fits])
                    raised = []
                    for a, b in zip(low, high, strict=True):
                        within = own[: np.searchsorted(own, b, side="right")]
                        raised.append(max(a, int(within[-k])) if len(within) >= k else a)
                    open_ones = [(a, b) for a, b in zip(raised, high, strict=True) if a <= b]
                    for at in sorted(index.visits(x[i], min(a for a, _ in open_ones), max(b for _, b in open_ones))) if open_ones else ():
                        rows.append(i)
                        lows.append(raised)
                        blocks.append(at)
                taken = batch.take(pa.array(rows, pa.int64()))
                columns = {"block": pa.array(blocks, pa.int32()), "query": pa.array([True] * len(rows)), **{c: taken.column(c) for c in ("id", "label", "x", "ask", "same")}, "low": pa.array(lows, pa.list_(pa.int64())), "high": taken.column("high")}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return asks.select("ask", "id", "label", "x", "same", "low", "high").mapInArrow(run, ASKED)


def best_in_block(batch: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    """The first k rows of a block in each window of each query."""
    own_ids, own_labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
    same = np.array(batch.column("same").to_pylist(), dtype=bool)
    low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
    scores = products(matrix(batch.column("x")), x)
    fits = (labels == own_labels[:, None]) == same[:, None]
    fits &= ~same[:, None] | (ids != own_ids[:, None])
    fits &= scores >= np.array([min(w) for w in low])[:, None]
    fits &= scores <= np.array([max(w) for w in high])[:, None]
    out: list[tuple[int, int, int, int]] = []
    for q, ask in enumerate(batch.column("ask").to_pylist()):
        at = np.flatnonzero(fits[q])
        if not len(at):
            continue
        turn = at[np.lexsort((ids[at], -scores[q, at]))]
        falling = -scores[q, turn]
        for window, (a, b) in enumerate(zip(low[q], high[q], strict=True)):
            start, end = np.searchsorted(falling, -b, side="left"), np.searchsorted(falling, -a, side="right")
            out += [(ask, window, int(ids[r]), int(scores[q, r])) for r in turn[start : min(end, start + k)]]
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["ask", "window", "id", "score"])


def segments(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(block, are they queries, rows) of runs of rows."""
    block, query = batch.column("block").to_numpy(), np.array(batch.column("query").to_pylist(), dtype=bool)
    edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(query) != 0)) + 1
    for start, end in zip([0, *edges], [*edges, len(block)], strict=True):
        yield int(block[start]), bool(query[start]), batch.slice(start, end - start)


def search(rows: DataFrame, index: Index, asks: DataFrame, k: int) -> DataFrame:
    """(ask, window, id, score, place): the first k rows (place from 1) of each window of each query, by falling score, then id.

    asks has (ask, id, label, x, same, low, high): the windows' ends, included, and
    whether rows of the own label (but not the own id) or of other labels are sought.
    """
    queries = routed(asks, index, k)
    empty = {"ask": "long", "same": "boolean", "low": "array<long>", "high": "array<long>"}
    both = rows.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in empty.items())).unionByName(queries)
    together = both.repartition("block").sortWithinPartitions("block", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, query, part in segments(batch) if batch.num_rows else ():
                if block != now:
                    now, held, ready = block, [], None
                if not query:
                    held.append(part)
                    continue
                if ready is None and held:
                    ready = [np.concatenate([p.column(c).to_numpy() for p in held]) for c in ("id", "label")] + [np.concatenate([matrix(p.column("x")) for p in held])]
                step = max(1, SCORES // len(ready[0])) if ready else 1
                for start in range(0, part.num_rows, step) if ready else ():
                    yield best_in_block(part.slice(start, step), *ready, k)
        release()

    order = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "id")
    return together.mapInArrow(run, FOUND).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80, codes: int = CODES, sample: int = SAMPLE, block: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of a table (id, label, x) from labelled().

    is_anchor is an expression on id and label. Negatives of a positive score from `low` percent of its score up to its score.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    made = build(df, codes, sample, block)
    if made is None:
        return df.sparkSession.createDataFrame([], schema)
    rows, index = made
    anchors = stored(df.filter(is_anchor).select("id", "label", "x", F.monotonically_increasing_id().alias("ask")))
    one = lambda v: F.array(F.lit(v).cast("long"))
    near = search(rows, index, anchors.select("*", F.lit(True).alias("same"), one(LEAST).alias("low"), one(MOST).alias("high")), n_positives)
    positives = stored(near.select("ask", (F.col("place") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    own = F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("own")  # n_positives at most
    # ceil(low * score / 100) in whole numbers; a score below zero makes an empty window
    lowest = F.expr(f"transform(own.positive_score, s -> (s * {low} + pmod(-s * {low}, 100)) div 100)")
    windows = positives.groupBy("ask").agg(own).select("ask", lowest.alias("low"), F.col("own.positive_score").alias("high"))
    negatives = search(rows, index, anchors.join(windows, "ask").withColumn("same", F.lit(False)), n_negatives)
    found = negatives.select("ask", "window", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(found, ["ask", "window"]).join(anchors.select("ask", F.col("id").alias("anchor_id")), "ask").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """hard_negatives() with anchors whose id is divisible by 100, after every seventh id's label has moved on by one, of ten."""
    rows = labelled(df, id_col, label_col, vector_col)
    return hard_negatives(rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), F.col("id") % 100 == 0)


#: mined() of the table embeddings, in DuckDB SQL.
ORACLE = """
WITH rows_in AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_bool_and([c IS NOT NULL AND isfinite(c) FOR c IN embedding])
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
    FROM rows_in a JOIN rows_in b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
