"""Whitening of embeddings by principal components with exact eigenvalues.

Components are multiplied by 256 and rounded down, so vectors x are integers and
the scatter matrix M = n * sum(x x') - S S' of the distinct ones is one of
integers, too: n^2 times their covariance. Its characteristic polynomial is worked
out modulo many primes (Hessenberg reduction, a prime a row of a small table,
on the executors) and put together by the Chinese remainder theorem. All its roots
are real, so Descartes' rule of signs counts those above any point exactly: the
largest are isolated by halving, to far more digits than a double has. A
component spans the null space of M - eigenvalue, found by inverse iteration
in decimal arithmetic; roots that do not part are one component space, of which an
orthonormal basis is taken. The number of components that there are is the rank,
which the polynomial's last coefficient that is not zero gives exactly.

Sums over rows are exact: each task multiplies its vectors without rounding and
gives sums in two limbs, which Spark adds up. What comes to the driver has
(d + 1)^2 / 2 numbers for vectors of d components, however many rows there are.

Defined results: rows whose vector is null or empty, holds a null, NaN or infinity,
or has another length than most (the longest of equally many) are dropped; equal
vectors count once in the fit, and each row gets its own result, repeated rows and
null ids too; where fewer than k eigenvalues are above zero there are fewer
components, and no rows at all where all vectors are equal or the table is empty;
a deviation beyond a long is null (deviation_exact has it); equal eigenvalues give
any orthonormal basis of their space, the same one each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from math import comb, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.common import release, stored
from pitchlake.llm.vectors import highest, matrix, same_length, sound, whole

#: Sums are handed on as high * 2^LIMB + low.
LIMB = 60
#: Binary digits after the point to which eigenvalues of the scatter matrix (integers' scale) are isolated.
ROOT_BITS = 96
#: Decimal digits beyond those of the matrix in inverse iteration.
GUARD_DIGITS = 60
ROUNDS = 3


@dataclass(frozen=True)
class Whitening:
    """Components as rows; values are eigenvalues of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: tuple[float, ...]
    explained: tuple[float, ...]
    components: np.ndarray


# --- exact sums


def gram(x: np.ndarray) -> list[list[int]] | np.ndarray:
    """x' x without rounding."""
    if highest(x) ** 2 * max(1, len(x)) < 1 << 53:
        return np.rint(x.T.astype(np.float64) @ x.astype(np.float64)).astype(np.int64)
    return x.T.astype(object) @ x.astype(object)


def exact_sums(fit: DataFrame, d: int) -> dict[tuple[int, int], int]:
    """Sums of products (i, j) of components over fit's rows; component d is 1 everywhere, so (i, d) are sums and (d, d) is n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            x = matrix(batch.column("x"))
            own = np.asarray(gram(np.hstack([x, np.ones((len(x), 1), dtype=np.int64)])), dtype=object)
            total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(d + 1)
            sums = [int(v) for v in total[i, j]]
            low = [Decimal(v & (1 << LIMB) - 1) for v in sums]
            high = [Decimal(v >> LIMB) for v in sums]
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(high, kind), pa.array(low, kind)], ["i", "j", "high", "low"])
        release()

    parts = fit.select("x").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    return {(r.i, r.j): (int(r.high) << LIMB) + int(r.low) for r in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}


def scatter(sums: dict[tuple[int, int], int], d: int) -> list[list[int]]:
    """n * sum(x x') - S S'."""
    n = sums[d, d]
    return [[n * sums[min(i, j), max(i, j)] - sums[i, d] * sums[j, d] for j in range(d)] for i in range(d)]


# --- characteristic polynomial


def is_prime(p: int) -> bool:
    """Miller and Rabin's test, which these bases make exact below 3.2e9."""
    if p < 2 or p % 2 == 0:
        return p == 2
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if p == base or x in (1, p - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes(above: int) -> list[int]:
    """Primes below 2^31, the largest first, whose product is above that number."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= above:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(m: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - m) modulo the prime p < 2^31, the lowest first; m holds residues."""
    h, d = m.astype(np.int64) % p, len(m)
    for c in range(d - 2):  # to Hessenberg form, by similarity
        rows = np.flatnonzero(h[c + 1 :, c])
        if not len(rows):
            continue
        pivot = c + 1 + int(rows[0])
        if pivot != c + 1:
            h[[pivot, c + 1]] = h[[c + 1, pivot]]
            h[:, [pivot, c + 1]] = h[:, [c + 1, pivot]]
        factors = h[c + 2 :, c] * pow(int(h[c + 1, c]), -1, p) % p
        for at in np.flatnonzero(factors):
            h[c + 2 + at] = (h[c + 2 + at] - factors[at] * h[c + 1]) % p
            h[:, c + 1] = (h[:, c + 1] + factors[at] * h[:, c + 2 + at]) % p
    polys = [np.array([1], dtype=np.int64)]
    for k in range(d):  # the leading k + 1 rows' polynomial from the smaller ones
        q = np.zeros(k + 2, dtype=np.int64)
        q[1:] = polys[k]
        q[:-1] = (q[:-1] - h[k, k] * polys[k]) % p
        along = 1
        for i in range(k - 1, -1, -1):
            along = along * int(h[i + 1, i]) % p
            q[: i + 1] = (q[: i + 1] - along * int(h[i, k]) % p * polys[i]) % p
        polys.append(q)
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x I - m), the lowest first, of a matrix without negative eigenvalues; a prime a row, on the executors."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    # the k-th symmetric function of d numbers of that sum, none negative, is largest where they are equal
    bound = max(comb(d, k) * -(-(trace**k) // d**k) for k in range(d + 1))
    chosen = primes(2 * bound + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                residues = polynomial_modulo(np.array([[v % p for v in row] for row in m], dtype=np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([residues], pa.list_(pa.int64()))], ["p", "residues"])

    tasks = min(len(chosen), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(chosen), 1, tasks).select(F.element_at(F.lit(chosen), (F.col("id") + 1).cast("int")).cast("long").alias("p"))
    product, values = 1, [0] * (d + 1)
    for r in sorted(rows.mapInArrow(run, "p long, residues array<long>").collect(), key=lambda r: r.p):
        inverse = pow(product % r.p, -1, r.p)
        values = [v + product * ((c - v) * inverse % r.p) for v, c in zip(values, r.residues, strict=True)]
        product *= r.p
    return [v - product if 2 * v > product else v for v in values]


# --- roots


def sign_changes(coefficients: list[int]) -> int:
    signs = [c > 0 for c in coefficients if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def shifted(coefficients: list[int], a: int) -> list[int]:
    """Coefficients of p(x + a)."""
    out = list(coefficients)
    for i in range(len(out) - 1):
        carry = out[-1]
        for j in range(len(out) - 2, i - 1, -1):
            carry = out[j] = out[j] + a * carry
    return out


def largest_roots(coefficients: list[int], k: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """(place, how many) of the k largest positive roots of a real-rooted polynomial, falling: how many lie in (place - 1, place] / 2^bits.

    The last may reach beyond k, as roots that do not part come together. By
    Descartes' rule p(x + a) has as many sign changes as p has roots above a,
    since all roots are real.
    """
    d = len(coefficients) - 1
    scaled = [c << bits * (d - i) for i, c in enumerate(coefficients)]  # of the polynomial with roots 2^bits times as large
    above = lambda a: sign_changes(shifted(scaled, a))
    top = 1
    while above(top):
        top <<= 1
    out, found = [], 0
    k = min(k, above(0))
    while found < k:
        low, high, many = 0, top, 0  # more than `found` roots above low, at most that many above high
        while high - low > 1:
            middle = (low + high) // 2
            count = above(middle)
            low, high, many = (middle, high, count) if count > found else (low, middle, many)
        many = above(low)
        out.append((high, many - found))
        found, top = many, high
    return out


# --- components


def null_space(m: list[list[int]], root: Decimal, many: int, digits: int, seed: int = 42) -> np.ndarray:
    """`many` orthonormal vectors that span the null space of m - root, by inverse iteration with that many decimal digits."""
    d = len(m)
    with localcontext(Context(prec=digits)):
        size = max((abs(v) for row in m for v in row), default=1)
        tiny = Decimal(size).scaleb(-digits)
        a = [[Decimal(v) - root if i == j else Decimal(v) for j, v in enumerate(row)] for i, row in enumerate(m)]
        turn = list(range(d))
        for c in range(d):  # rows by their largest entry, factors kept below
            pivot = max(range(c, d), key=lambda r: abs(a[r][c]))
            a[c], a[pivot], turn[c], turn[pivot] = a[pivot], a[c], turn[pivot], turn[c]
            if abs(a[c][c]) < tiny:
                a[c][c] = tiny
            own = a[c]
            for r in range(c + 1, d):
                row = a[r]
                f = row[c] = row[c] / own[c]
                if f:
                    for j in range(c + 1, d):
                        row[j] -= f * own[j]
        rng = np.random.default_rng(seed)
        vectors = [[Decimal(int(v)) for v in rng.integers(-999, 1000, d)] for _ in range(many)]
        for _ in range(ROUNDS):
            basis: list[list[Decimal]] = []
            for v in vectors:
                y = [v[t] for t in turn]
                for i in range(d):
                    y[i] -= sum((a[i][j] * y[j] for j in range(i)), Decimal(0))
                for i in range(d - 1, -1, -1):
                    y[i] = (y[i] - sum((a[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
                for _ in range(2):
                    for b in basis:
                        along = sum((p * q for p, q in zip(b, y, strict=True)), Decimal(0))
                        y = [q - along * p for p, q in zip(b, y, strict=True)]
                length = sum((q * q for q in y), Decimal(0)).sqrt()
                basis.append([q / length for q in y])
            vectors = basis
        return np.array([[float(q) for q in v] for v in vectors])


def solve(spark: SparkSession, m: list[list[int]], k: int) -> tuple[list[Decimal], np.ndarray]:
    """The k largest eigenvalues above zero of an integer scatter matrix, falling, and their unit eigenvectors as rows."""
    shared = gcd(*(v for row in m for v in row)) or 1
    m = [[v // shared for v in row] for row in m]
    values: list[Decimal] = []
    vectors: list[np.ndarray] = []
    digits = 2 * len(str(max((abs(v) for row in m for v in row), default=1))) + ROOT_BITS * 3 // 10 + GUARD_DIGITS
    for place, many in largest_roots(characteristic_polynomial(spark, m), k):
        with localcontext(Context(prec=digits)):
            root = Decimal(2 * place - 1) / Decimal(2 << ROOT_BITS)
            values += [root * shared] * many
        vectors.append(null_space(m, root, many, digits))
    return values[:k], np.concatenate(vectors)[:k] if vectors else np.empty((0, len(m)))


def fit(vectors: DataFrame, k: int = 4) -> Whitening | None:
    """The whitening of the distinct integer vectors x of a table (x); None where there are none."""
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    sums = exact_sums(vectors, d)
    n, m = sums[d, d], scatter(sums, d)
    values, components = solve(vectors.sparkSession, m, k)
    trace = sum(m[i][i] for i in range(d))
    with localcontext(Context(prec=60)):
        covariance = tuple(float(v / (n * n)) for v in values)
        explained = tuple(float(v / trace) for v in values)
    return Whitening(n, tuple(sums[i, d] for i in range(d)), covariance, explained, components)


# --- projection


def centred(x: np.ndarray, w: Whitening) -> np.ndarray:
    """n * x - S, exactly."""
    if highest(x) * w.n + max((abs(s) for s in w.sums), default=0) < 1 << 62:
        return w.n * x - np.array(w.sums, dtype=np.int64)
    return w.n * x.astype(object) - np.array(w.sums, dtype=object)


def projected(c: np.ndarray, w: Whitening) -> np.ndarray:
    """Whitened coordinates of centred rows."""
    return (c.astype(np.float64) / w.n) @ (w.components / np.sqrt(np.array(w.values))[:, None]).T


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over the distinct vectors."""
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = projected(centred(matrix(batch.column("x")), w), w)
            yield pa.RecordBatch.from_arrays([pa.array(y[:, i]) for i in range(k)], [f"y{i}" for i in range(k)])

    y = vectors.select("x").mapInArrow(run, ", ".join(f"y{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = y.agg(*(F.covar_pop(f"y{i}", f"y{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue, deviation_exact), a row for each vector and component."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(sound("v"))
    rows = same_length(rows.select("vec_id", whole("v").alias("x")), "x")
    distinct = stored(rows.select("x").distinct())
    w = fit(distinct, k)
    kinds = {"vec_id": pa.int64(), "component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.float64(), "explained": pa.float64(), "identity_error": pa.float64(), "eigenvalue": pa.float64(), "deviation_exact": pa.decimal128(38, 0)}
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, deviation_exact decimal(38,0)"
    if w is None or not w.values:
        return rows.sparkSession.createDataFrame([], schema)
    error, many = identity_error(distinct, w), len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = centred(matrix(batch.column("x")), w)
            y = projected(c, w)
            big = highest(c) ** 2 * max(1, c.shape[1]) >= 1 << 63
            deviation = [int(v) for v in ((c.astype(object) if big else c) ** 2).sum(axis=1) for _ in range(many)]
            values = {
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(y)), many))), "component": np.tile(np.arange(1, many + 1), len(y)), "n": np.full(y.size, w.n),
                "deviation": [v if v < 1 << 63 else None for v in deviation] if big else deviation, "whitened": y.ravel(), "explained": np.tile(w.explained, len(y)),
                "identity_error": np.full(y.size, error), "eigenvalue": np.tile(w.values, len(y)), "deviation_exact": [Decimal(v) for v in deviation],
            }
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) if not isinstance(v, pa.Array) else v for c, v in values.items()], list(values))

    return rows.mapInArrow(run, schema)
