"""Hard negatives and whitening against plain versions; packing by its laws and the library's ids."""

import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pitchlake.llm import hard_negatives, packing, vectors, whitening
from pitchlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, x string, block string, component string, n string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "b", "c", "n") for i, v, label in rows], SCHEMA)


def odd_rows(seed=0, many=90, d=6):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.normal(size=d).round(2)], int(rng.integers(3))) for i in range(many)]
    rows += [(200 + i, rows[7][1], i % 3) for i in range(40)]  # one vector, many times
    rows += [(300, None, 1), (301, [], 1), (302, [0.1] * 5 + [None], 1), (303, [0.1] * 5 + [NAN], 2), (304, [INF] + [0.1] * 5, 0), (305, [0.1] * 5, 1), (306, [0.2] * 6, None), (400, [0.0] * 6, 1), (500, [-0.5] * 6, 2)]
    return rows + [rows[0], rows[3]]


def taking_part(rows, d=6):
    return [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v], label) for i, v, label in rows if i is not None and v is not None and len(v) == d and label is not None and all(c is not None and np.isfinite(c) for c in v)]


# -- hard negatives


def brute_negatives(rows):
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    out = []
    for a, x, label in rows:
        if a % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y, strict=True)), b, other) for b, y, other in rows if b != a))
        for s, b, _ in [r for r in scored if r[2] == label][:5]:
            fits = [(t, c) for t, c, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, b, r + 1, c, -s, -t) for r, (t, c) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_equal_all_pairs(spark):
    rows = odd_rows()
    got = sorted(map(tuple, hard_negatives.mined(table_of(spark, rows)).collect()))
    # an anchor that is there twice asks twice; a row is not its own positive
    want = brute_negatives(taking_part(rows))
    assert sorted(set(got)) == sorted(set(want)) and got and len({r[0] for r in got}) > 2


@pytest.mark.parametrize("block", [3, 17, 1000])
@pytest.mark.parametrize("sample", [5, 1000])
def test_blocks_and_samples_do_not_matter(spark, block, sample):
    rows = [(i, v, label) for i, v, label in odd_rows(5)[:90]] + [(600 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(50)]
    df = hard_negatives.labelled(table_of(spark, rows))
    from pyspark.sql import functions as F

    found = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, codes=4, sample=sample, block=block)
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())
    plain = []
    for a, x, label in (part := taking_part(rows)):
        if a % 10 == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), b, other) for b, y, other in part if b != a)
            for s, b, _ in [r for r in scored if r[2] == label][:5]:
                fits = [(t, c) for t, c, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
                plain += [(a, b, r + 1, c, -s, -t) for r, (t, c) in enumerate(fits)]
    assert got == sorted(plain)


def test_heap_passes_over_cells_that_cannot_matter(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 6))
    rows = [(i, [float(v) for v in centres[i % 8] + rng.normal(size=6) * 0.001], i % 2) for i in range(800)]
    _, index = hard_negatives.build(hard_negatives.labelled(table_of(spark, rows)), codes=8, block=20)
    x = np.array([int(np.floor(256 * np.float32(v))) for v in rows[0][1]])
    top = int(x @ x)
    near, every = index.visits(x, int(top * 0.98), top + 1000), index.visits(x, hard_negatives.LEAST, hard_negatives.MOST)
    assert near < every and len(near) <= len(every) // 3


def test_exact_products_beyond_doubles():
    a = np.array([[1 << 40, 3], [5, 7]], dtype=np.int64)
    assert vectors.products(a, a).tolist() == [[(1 << 80) + 9, 5 * (1 << 40) + 21], [5 * (1 << 40) + 21, 74]]


def test_hard_negatives_without_rows(spark):
    df = table_of(spark, odd_rows())
    assert hard_negatives.mined(df.filter("false")).count() == 0
    assert hard_negatives.mined(df.filter("vec_id % 100 <> 0")).count() == 0
    assert hard_negatives.mined(df.filter("label = 1")).count() >= 0
    assert hard_negatives.mined(df.filter("vec_id = 400")).count() == 0


def test_hard_negatives_match_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got = QUERIES["op11_hard_negatives"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(ORACLE_SQL["op11_hard_negatives"]).fetchall()) and got.columns == [d[0] for d in c.description]


# -- whitening


def determinant(m):
    m, sign = [[Fraction(v) for v in row] for row in m], 1
    for c in range(len(m)):
        pivot = next((r for r in range(c, len(m)) if m[r][c]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != c:
            m[c], m[pivot], sign = m[pivot], m[c], -sign
        for r in range(c + 1, len(m)):
            f = m[r][c] / m[c][c]
            m[r] = [a - f * b for a, b in zip(m[r], m[c], strict=True)]
    out = Fraction(sign)
    for c in range(len(m)):
        out *= m[c][c]
    return out


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (2, 2), (5, 5), (6, 3), (7, 0)])
def test_characteristic_polynomial_at_points(spark, d, rank):
    rng = np.random.default_rng(d)
    x = rng.integers(-40, 40, (20, rank)) @ rng.integers(-5, 5, (rank, d)) if rank < d else rng.integers(-10**6, 10**6, (20, d))
    m = [[int(v) for v in row] for row in (20 * x.T @ x - np.outer(x.sum(0), x.sum(0))).astype(object)]
    p = whitening.characteristic_polynomial(spark, m)
    for at in (-3, 0, 1, 10**9 + 7):
        assert sum(c * at**i for i, c in enumerate(p)) == determinant([[at * (i == j) - m[i][j] for j in range(d)] for i in range(d)])


def test_roots_of_known_polynomials():
    poly = [1]
    for root in (9, 9, 4, 1, 0, 0):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    found = whitening.largest_roots(poly, 4, bits=8)
    assert [(Fraction(2 * place - 1, 512), many) for place, many in found] == [(9 - Fraction(1, 512), 2), (4 - Fraction(1, 512), 1), (1 - Fraction(1, 512), 1)]
    assert whitening.largest_roots([0, 0, 1], 4) == []


def test_close_eigenvalues_part(spark):
    """Two eigenvalues that differ in the sixteenth digit: their vectors are those of the axes."""
    big = 10**16
    values, v = whitening.solve(spark, [[big, 0, 0], [0, big + 1, 0], [0, 0, 5]], 3)
    assert [round(x) for x in values] == [big + 1, big, 5] and np.allclose(np.abs(v), [[0, 1, 0], [1, 0, 0], [0, 0, 1]], atol=1e-15)


def test_equal_eigenvalues_give_an_orthonormal_basis(spark):
    values, v = whitening.solve(spark, [[7, 0, 0], [0, 7, 0], [0, 0, 7]], 4)
    assert len(values) == 3 and np.allclose(v @ v.T, np.eye(3), atol=1e-15)


def check_whitening(got, rows):
    x = np.array(sorted({tuple(v) for _, v, _ in rows}))
    n, s = len(x), x.sum(0)
    e, v = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    e, v = e[::-1], v[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == [1, 2, 3, 4] and all(len(b) == len(rows) for b in by.values())
    assert {(r.n, r.identity_error) for r in got} == {(n, got[0].identity_error)} and got[0].identity_error < 1e-10
    exact = {}
    for i, own, _ in rows:
        exact.setdefault(i, []).append((sum((n * c - int(t)) ** 2 for c, t in zip(own, s, strict=True)), (np.array(own) - s / n) @ v[:, :4] / np.sqrt(e[:4])))
    for k, b in by.items():
        assert abs(b[0].explained - e[k - 1] / e.sum()) < 1e-9
        sign = np.sign(sum(r.whitened * exact[r.vec_id][0][1][k - 1] for r in b))
        for r in b:
            assert r.deviation == r.deviation_exact and any(r.deviation == d and abs(sign * r.whitened - y[k - 1]) < 1e-8 for d, y in exact[r.vec_id])


def test_whitening_equals_a_plain_version(spark):
    rows = [r for r in odd_rows(3) if r[2] is not None]
    check_whitening(whitening.whiten(table_of(spark, rows)).collect(), taking_part(rows))


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, [int(np.floor(256 * float(c))) for c in r.embedding], 0) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op13_embedding_whitening"](spark, SF).collect(), rows)


def test_sums_beyond_64_bits(spark):
    rows = spark.createDataFrame([([1 << 61, -(1 << 61)],), ([-(1 << 60), 5],), ([(1 << 61) + 3, 1],)], "x array<long>")
    sums = whitening.exact_sums(rows, 2)
    assert sums[0, 0] == (1 << 122) + (1 << 120) + ((1 << 61) + 3) ** 2 and sums[1, 2] == -(1 << 61) + 6 and sums[2, 2] == 3


def test_whitening_degenerate(spark):
    df = table_of(spark, odd_rows())
    columns = "vec_id component n deviation whitened explained identity_error".split()
    for none in (df.filter("false"), df.filter("vec_id = 7"), df.filter("vec_id between 200 and 239"), df.filter("vec_id in (300, 301)")):
        out = whitening.whiten(none)
        assert out.columns[:7] == columns and out.count() == 0
    two = whitening.whiten(df.filter("vec_id in (1, 2)")).collect()  # two vectors have one component
    assert {r.component for r in two} == {1} and sorted(abs(r.whitened) for r in two) == pytest.approx([1, 1]) and two[0].explained == pytest.approx(1)


# -- packing

TEXTS = [
    (1, None), (2, ""), (3, "one"), (4, "word " * 5000), (5, " \n\t  x <|endoftext|> y\x1c z " * 40), (6, "é中１ß" * 900), (7, "q" * 20000), (8, " " * 300_000 + "x"),
    (9, "a" + " b" * 2046), (10, "a" + " b" * 2047), (11, "a" + " b" * 4095), (3, "one"), (None, "no id"), *((100 + i, "lorem ipsum dolor sit " * (i % 97)) for i in range(700)),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(got, texts, library):
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    expected = []
    for doc, text in texts:
        ids = np.array(ids_of(library, text), dtype="<u4")
        short = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        ends = [e for e in [short, *range(short + 2048, len(ids) + 1, 2048)] if e]
        starts = [0, *ends[:-1]]
        expected += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(expected, key=repr)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(filled), -(-sum(r.length for r in got) // 2048)


@pytest.fixture(scope="module")
def odd_texts(spark):
    return spark.createDataFrame([(i, t, "p", "s", 7, 8) for i, t in TEXTS], "doc_id long, text string, piece string, start string, length int, row int")


def test_packing_of_odd_texts(spark, odd_texts, library):
    used, least = check_packing(packing.packed(odd_texts).collect(), TEXTS, library)
    assert used <= least + 1
    assert packing.packed(odd_texts.filter("false")).count() == 0


def test_packing_in_buckets(spark, odd_texts, library):
    cut = packing.stored(packing.pieces(odd_texts))
    got = packing.pack(cut, bucket=200).collect()
    used, least = check_packing(got, TEXTS, library)
    buckets = {r.sequence_id >> 32 for r in got}
    assert len(buckets) > 3 and used <= least + 2 * len(buckets)
    again = packing.pack(cut.repartition(1), bucket=200)
    assert again.count() == len(got)


def test_packing_of_the_table(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = check_packing(QUERIES["op12_best_fit_packing"](spark, SF).collect(), docs, library)
    assert used <= least + 2


def test_sequences_hold_the_ids(spark, odd_texts, library):
    few = odd_texts.filter("doc_id between 100 and 160 or doc_id = 4")
    rows = packing.sequences(packing.packed(few), packing.pieces(few, with_ids=True)).collect()
    ids = sum((ids_of(library, t) for i, t in TEXTS if i and (100 <= i <= 160 or i == 4)), [])
    assert sorted(x for r in rows for x in r.ids) == sorted(ids) and all(r.n_tokens == len(r.ids) <= 2048 for r in rows)


def test_each_placement_is_the_smallest_sum(spark):
    """Replays placements against the sum of squares worked out for every choice."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 40, 400)
    sequence, offset = packing.sum_of_squares(lengths, 40)
    gaps = {}
    for size, own, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        def squares(change):
            after = gaps | change
            return sum(v * v for v in np.unique([g for g in after.values() if g], return_counts=True)[1].tolist())

        choices = [squares({b: g - size}) for b, g in gaps.items() if g >= size] + [squares({len(gaps): 40 - size})]
        assert at == 40 - gaps.get(own, 40) and squares({own: gaps.get(own, 40) - size}) == min(choices)
        gaps[own] = gaps.get(own, 40) - size


def test_every_character_is_encoded_as_by_the_library(library):
    encoder = packing.load(public_tokenizers.path(packing.VOCABULARY))
    assert encoder.fast is not None
    for start in range(0, 0x20000, 64):
        text = "".join(f"a{c}1{c}!{c} {c}{c}  a" for c in map(chr, range(start, start + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
