"""Robust homographies from pixels to the pitch: sample consensus over points and lines.

A point says where a pixel lies; a line says which line of the pitch two pixels lie on. Either gives two
equations, so any four of them make a homography. A frame draws samples of four in an order
that its key seeds, keeps what most correspondences agree with, and fits these again. Samples and
fits that do not settle all eight numbers are passed over; without one, the frame has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far, in metres, a correspondence may be off; samples drawn at once, and at most.
TOLERANCE = 0.2
DRAWN, MOST = 64, 1024
#: The chance that no sample was free of outliers, at which drawing stops.
MISSED = 1e-9
#: Least ratio of the eighth singular value to the first, of normalised equations.
SETTLED = 1e-6
#: Fixed value: pixels of a full-HD frame through which homographies of neighbouring frames are averaged.
CORNERS = ((0.0, 0.0), (1920.0, 0.0), (1920.0, 1080.0), (0.0, 1080.0))

CORRESPONDENCE = "struct<u:double, v:double, u2:double, v2:double, px:double, py:double, a:double, b:double, c:double>"


def points(df: DataFrame, keys: list[str]) -> DataFrame:
    """Point correspondences (keys..., u, v, px, py) in the form of solve()."""
    no = F.lit(None).cast("double")
    return df.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in "uv"], no.alias("u2"), no.alias("v2"), F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"), no.alias("a"), no.alias("b"), no.alias("c")).alias("m"))


def lines(df: DataFrame, keys: list[str]) -> DataFrame:
    """Line correspondences (keys..., u, v, u2, v2, a, b, c) in the form of solve(): both pixels lie on a x + b y + c = 0 of the pitch."""
    no = F.lit(None).cast("double")
    return df.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in ("u", "v", "u2", "v2")], no.alias("px"), no.alias("py"), *[F.col(c).cast("double").alias(c) for c in "abc"]).alias("m"))


def equations(m: np.ndarray) -> np.ndarray:
    """(correspondences, 2, 9): what each says of the homography's numbers; m has the fields of CORRESPONDENCE."""
    u, v, u2, v2, x, y, a, b, c = m.T
    one, zero = np.ones(len(m)), np.zeros(len(m))
    point = np.stack([np.stack([u, v, one, zero, zero, zero, -x * u, -x * v, -x], axis=1), np.stack([zero, zero, zero, u, v, one, -y * u, -y * v, -y], axis=1)], axis=1)
    on = lambda p, q: np.stack([a * p, a * q, a, b * p, b * q, b, c * p, c * q, c], axis=1)
    line = np.stack([on(u, v), on(u2, v2)], axis=1)
    return np.where(np.isnan(x)[:, None, None], line, point)


def solved(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(homographies, are they settled?) of batches (many, equations, 9)."""
    e = e / np.maximum(np.linalg.norm(e, axis=2, keepdims=True), 1e-12)
    _, s, vt = np.linalg.svd(e, full_matrices=True)
    return vt[:, -1], s[:, 7] > SETTLED * s[:, 0]


def mapped(h: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, w) of pixels under homographies (many, 9): (many, pixels)."""
    h = h[:, :, None]
    w = h[:, 6] * u + h[:, 7] * v + h[:, 8]
    safe = np.where(np.abs(w) < 1e-12, np.nan, w)
    return (h[:, 0] * u + h[:, 1] * v + h[:, 2]) / safe, (h[:, 3] * u + h[:, 4] * v + h[:, 5]) / safe, w


def errors(h: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(many, correspondences): metres that each is off."""
    u, v, u2, v2, px, py, a, b, c = m.T
    x, y, _ = mapped(h, u, v)
    x2, y2, _ = mapped(h, np.nan_to_num(u2), np.nan_to_num(v2))
    long = np.maximum(np.sqrt(a * a + b * b), 1e-12)
    off = np.where(np.isnan(px), np.maximum(np.abs(a * x + b * y + c), np.abs(a * x2 + b * y2 + c)) / long, np.sqrt((x - px) ** 2 + (y - py) ** 2))
    return np.where(np.isnan(off), np.inf, off)


def normaliser(p: np.ndarray) -> np.ndarray:
    """Moves points (n, 2) to mean zero and mean distance sqrt(2)."""
    centre = p.mean(axis=0)
    s = np.sqrt(2) / max(1e-9, float(np.linalg.norm(p - centre, axis=1).mean()))
    return np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])


def consensus(m: np.ndarray, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """(homography, which correspondences agree with it) of correspondences m (n, 9); None where they do not settle one."""
    n = len(m)
    none = None, np.zeros(n, dtype=bool)
    if n < 4:
        return none
    # both sides near one, where the equations are well-conditioned
    pixels = np.concatenate([m[:, :2], m[~np.isnan(m[:, 2]), 2:4]])
    t = normaliser(pixels)
    r = np.array([[1 / 50, 0, -1.05], [0, 1 / 50, -0.68], [0, 0, 1.0]])  # the pitch is about 105 by 68
    z = m.copy()
    for i in (0, 2):
        z[:, i], z[:, i + 1] = t[0, 0] * m[:, i] + t[0, 2], t[1, 1] * m[:, i + 1] + t[1, 2]
    z[:, 4], z[:, 5] = r[0, 0] * m[:, 4] + r[0, 2], r[1, 1] * m[:, 5] + r[1, 2]
    z[:, 6:] = m[:, 6:] @ np.linalg.inv(r)
    back = lambda h: (np.linalg.inv(r) @ h.reshape(-1, 3, 3) @ t).reshape(-1, 9)
    e, rng = equations(z), np.random.default_rng(seed)
    best, best_key, drawn = None, (0, 0.0), 0
    while drawn < MOST:
        sample = np.argsort(rng.random((DRAWN, n)), axis=1)[:, :4]
        drawn += DRAWN
        h, fine = solved(e[sample].reshape(DRAWN, 8, 9))
        if fine.any():
            off = errors(back(h[fine]), m)
            agree = off <= tolerance
            counts, sums = agree.sum(axis=1), np.where(agree, off, 0).sum(axis=1)
            top = int(np.lexsort((sums, -counts))[0])
            if (counts[top], -sums[top]) > best_key:
                best, best_key = agree[top], (int(counts[top]), -float(sums[top]))
        share = best_key[0] / n
        if share == 1 or (share and drawn * log(max(1e-300, 1 - share**4)) <= log(MISSED)):
            break
    if best is None or best.sum() < 4:
        return none
    out = None
    for _ in range(3):  # fitted again with all that agree
        h, fine = solved(e[best].reshape(1, -1, 9))
        if not fine[0]:
            return none
        out = back(h)
        agree = errors(out, m)[0] <= tolerance
        if agree.sum() < 4 or (agree == best).all():
            break
        best = agree
    _, _, w = mapped(out, m[best, 0], m[best, 1])
    if out is None or abs(out[0, 8]) < 1e-12 or not ((w > 0).all() or (w < 0).all()):  # a camera sees its points in front of it
        return none
    return out[0] / out[0, 8], best


def quads(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrices, are they settled?) that take a fixed square to four points p (..., 4, 2); unsettled where three of them are on a line."""
    x, y = np.moveaxis(p, -2, 0)[..., 0], np.moveaxis(p, -2, 0)[..., 1]
    # twice the areas of the triangles that leave a point out
    area = lambda i, j, k: (x[j] - x[i]) * (y[k] - y[i]) - (x[k] - x[i]) * (y[j] - y[i])
    parts = np.stack([area(3, 1, 2), area(0, 3, 2), area(0, 1, 3)])
    fine = np.minimum(np.abs(parts).min(axis=0), np.abs(area(0, 1, 2))) > SETTLED
    m = np.stack([x[:3] * parts, y[:3] * parts, parts])  # (row, column, ...)
    return np.moveaxis(m, (0, 1), (-2, -1)), fine


def adjugate(m: np.ndarray) -> np.ndarray:
    """The inverse of matrices (..., 3, 3), but for a factor."""
    a, b, c = (m[..., i, :] for i in range(3))
    cross = lambda p, q: np.stack([p[..., 1] * q[..., 2] - p[..., 2] * q[..., 1], p[..., 2] * q[..., 0] - p[..., 0] * q[..., 2], p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]], axis=-1)
    return np.stack([cross(b, c), cross(c, a), cross(a, b)], axis=-1)


def point_consensus(m: np.ndarray, seeds: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """consensus() of many frames with equally many points each, m (frames, n, 9), at once: (homographies, NaN where none; which agree).

    The samples are the same; four points settle a homography in closed form, so only the last fits take a decomposition.
    """
    many, n = m.shape[:2]
    out, agreed = np.full((many, 9), np.nan), np.zeros((many, n), dtype=bool)
    if n < 4 or not many:
        return out, agreed
    uv, xy = m[:, :, :2], m[:, :, 4:6]
    centre = uv.mean(axis=1)
    s = np.sqrt(2) / np.maximum(1e-9, np.linalg.norm(uv - centre[:, None], axis=2).mean(axis=1))
    zu, zx = (uv - centre[:, None]) * s[:, None, None], xy / 50 - (1.05, 0.68)
    rngs = [np.random.default_rng(int(k)) for k in seeds]
    best, counts, sums = np.zeros((many, n), dtype=bool), np.zeros(many, dtype=np.int64), np.zeros(many)
    drawn, live = 0, np.arange(many)
    while drawn < MOST and len(live):
        sample = np.argsort(np.stack([rngs[i].random((DRAWN, n)) for i in live]), axis=2)[:, :, :4]
        drawn += DRAWN
        rows = np.arange(len(live))[:, None, None]
        (from_square, fine), (to, fine_too) = quads(zu[live][rows, sample]), quads(zx[live][rows, sample])
        h = to @ adjugate(from_square)  # (frames, samples, 3, 3)
        z = np.concatenate([zu[live], np.ones((len(live), n, 1))], axis=2)
        p = h.reshape(len(live), -1, 3) @ z.transpose(0, 2, 1)
        p = p.reshape(len(live), DRAWN, 3, n)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            off = 50 * np.sqrt((p[:, :, 0] / p[:, :, 2] - zx[live][:, None, :, 0]) ** 2 + (p[:, :, 1] / p[:, :, 2] - zx[live][:, None, :, 1]) ** 2)
        agree = (off <= tolerance) & (fine & fine_too)[:, :, None]
        k, total = agree.sum(axis=2), np.where(agree, off, 0).sum(axis=2)
        top = np.lexsort((total, -k), axis=1)[:, 0]
        at = np.arange(len(live))
        k, total, agree = k[at, top], total[at, top], agree[at, top]
        better = (k > counts[live]) | ((k == counts[live]) & (k > 0) & (total < sums[live]))
        best[live[better]], counts[live[better]], sums[live[better]] = agree[better], k[better], total[better]
        share = counts[live] / n
        with np.errstate(divide="ignore"):
            done = (share == 1) | ((share > 0) & (drawn * np.log(np.maximum(1e-300, 1 - share**4)) <= log(MISSED)))
        live = live[~done]
    live = np.flatnonzero(counts >= 4)
    z = np.full((many, n, 9), np.nan)
    z[:, :, :2], z[:, :, 4:6] = zu, zx
    e = equations(z.reshape(-1, 9)).reshape(many, 2 * n, 9)
    e /= np.maximum(np.linalg.norm(e, axis=2, keepdims=True), 1e-12)
    t = np.zeros((many, 3, 3))
    t[:, 0, 0], t[:, 1, 1], t[:, 0, 2], t[:, 1, 2], t[:, 2, 2] = s, s, -s * centre[:, 0], -s * centre[:, 1], 1
    back = np.linalg.inv(np.array([[1 / 50, 0, -1.05], [0, 1 / 50, -0.68], [0, 0, 1.0]]))
    again = live
    for turn in range(3):  # fitted again with all that agree
        if not len(again):
            break
        part = e[again] * np.repeat(best[again], 2, axis=1)[:, :, None]  # rows of zeros say nothing
        _, values, vt = np.linalg.svd(np.concatenate([part, np.zeros((len(again), 1, 9))], axis=1), full_matrices=False)
        fine = values[:, 7] > SETTLED * values[:, 0]
        out[again] = np.where(fine[:, None], (back @ vt[:, -1].reshape(-1, 3, 3) @ t[again]).reshape(-1, 9), np.nan)
        h = out[again][:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            w = h[:, 6] * uv[again][:, :, 0] + h[:, 7] * uv[again][:, :, 1] + h[:, 8]
            w = np.where(np.abs(w) < 1e-12, np.nan, w)
            x, y = ((h[:, i] * uv[again][:, :, 0] + h[:, i + 1] * uv[again][:, :, 1] + h[:, i + 2]) / w for i in (0, 3))
            agree = np.sqrt((x - xy[again][:, :, 0]) ** 2 + (y - xy[again][:, :, 1]) ** 2) <= tolerance
        more = fine & (agree.sum(axis=1) >= 4) & (agree != best[again]).any(axis=1)
        best[again[more]] = agree[more]
        again = again[more]
    w = np.where(best, out[:, 6, None] * uv[:, :, 0] + out[:, 7, None] * uv[:, :, 1] + out[:, 8, None], np.nan)
    here = best & ~np.isnan(out[:, :1])
    front = (here.any(axis=1)) & (((w > 0) | ~here).all(axis=1) | ((w < 0) | ~here).all(axis=1)) & (np.abs(out[:, 8]) >= 1e-12)
    good = np.zeros(many, dtype=bool)
    good[live] = front[live]
    out[~good] = np.nan
    return out / out[:, 8:], best & good[:, None]


#: Frames whose samples are drawn at once.
FRAMES = 128
FIELDS = ("u", "v", "u2", "v2", "px", "py", "a", "b", "c")


def solve(correspondences: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(keys..., h, n, n_agree): the homography of each frame, nine numbers, and how many of its correspondences agree; h is null where none is settled.

    correspondences are points() and lines(), together; those that are not finite do not count. Frames of points alone are
    solved many at once, others one by one.
    """
    m = F.col("m")
    sound = ~F.isnan(F.coalesce(m["u"] + m["v"] + F.coalesce(m["px"] + m["py"], m["a"] + m["b"] + m["c"] + m["u2"] + m["v2"]), F.lit(float("nan"))))
    named = correspondences.groupBy(*keys).agg(F.collect_list(F.when(sound, m)).alias("ms")).withColumn("seed", F.crc32(F.concat_ws("/", *keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms, seeds = batch.column("ms"), batch.column("seed").to_numpy()
            flat = ms.flatten()
            values = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in FIELDS], axis=1) if len(flat) else np.zeros((0, 9))
            sizes = np.diff(ms.offsets.to_numpy())
            frame = np.repeat(np.arange(len(sizes)), sizes)
            # an order of their own, however rows arrive
            values = values[np.lexsort((*values.T[::-1], frame))]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            mixed = np.zeros(len(sizes), dtype=bool)
            mixed[frame[np.isnan(values[:, 4])]] = True
            h, agree = np.full((len(sizes), 9), np.nan), np.zeros(len(sizes), dtype=np.int32)
            for n in np.unique(sizes[~mixed]):
                alike = np.flatnonzero(~mixed & (sizes == n))
                for i in range(0, len(alike), FRAMES):
                    at = alike[i : i + FRAMES]
                    found, which = point_consensus(values[starts[at][:, None] + np.arange(n)], seeds[at], tolerance)
                    h[at], agree[at] = found, which.sum(axis=1)
            for i in np.flatnonzero(mixed):
                found, which = consensus(values[starts[i] : starts[i + 1]], tolerance, int(seeds[i]))
                if found is not None:
                    h[i] = found
                agree[i] = which.sum()
            none = np.isnan(h[:, 0])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(none, 0, 9))]).astype(np.int32), mask=np.append(none, False)), pa.array(h[~none].ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], lists, pa.array(sizes.astype(np.int32)), pa.array(agree)], [*keys, "h", "n", "n_agree"])

    schema = correspondences.select(*keys, F.lit(None).cast("array<double>").alias("h"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("int").alias("n_agree")).schema
    return named.mapInArrow(run, schema)


def smoothed(homographies: DataFrame, by: list[str], reach: int = 2) -> DataFrame:
    """homographies(by..., frame, h) with h averaged over the frames up to `reach` away, through where four pixels lie; a frame without one gets its neighbours'."""
    near = Window.partitionBy(*by).orderBy("frame").rangeBetween(-reach, reach)
    h = lambda i: F.get("h", i)
    w = lambda u, v: h(6) * u + h(7) * v + h(8)
    places = [(h(k) * u + h(k + 1) * v + h(k + 2)) / w(u, v) for u, v in CORNERS for k in (0, 3)]
    df = homographies.withColumn("_corners", F.array(*[F.avg(p).over(near) for p in places]))

    @F.pandas_udf("array<double>")
    def through(corners: pd.Series) -> pd.Series:
        def one(c):
            if any(x is None or np.isnan(x) for x in c):
                return None
            m = np.full((4, 9), np.nan)
            m[:, :2], m[:, 4:6] = CORNERS, np.array(c).reshape(4, 2)
            out = consensus(m, tolerance=1.0)[0]
            return None if out is None else out.tolist()

        return corners.map(one)

    return df.withColumn("h", through("_corners")).drop("_corners")
