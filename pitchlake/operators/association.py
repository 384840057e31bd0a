"""Tracks from boxes: constant-velocity prediction, optimal assignment, clips cut anywhere.

In each frame, tracks are predicted by a Kalman filter and matched with the boxes, sure
ones first, then the others with the tracks that are left, at the least total cost. A clip is
cut into segments of frames that overlap; each is a task's group of its own. In the overlap the same
boxes have a track of either segment, which says which tracks are one: chains of them are followed
by joins that double their reach, so their number is the logarithm of the number of segments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.storage import stored

#: Frames of a segment, and frames that it reaches into the segments before and after.
SEGMENT, OVERLAP = 1500, 50
#: A box at least this sure may start a track.
SURE = 0.5
#: Variances of the filter, in units of a box's height: of a position that is seen, and of what velocity gains in a frame.
SEEN, DRIVEN = 0.05**2, 0.02**2


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of the least total cost, as many as the smaller side has, by shortest augmenting paths; infinite costs are never taken.

    Infinite pairs count as dearer than any others together, so that as many finite ones as possible are made.
    """
    if not cost.size:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    finite = np.isfinite(c)
    big = 1 + 2 * np.abs(c[finite]).sum() if finite.any() else 1.0
    c = np.where(finite, c, big)
    n, m = c.shape
    row_price, column_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # the last column is where a path begins
    for r in range(n):
        owner[m] = r
        at, least, via, done = m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, dtype=bool)
        while owner[at] >= 0:
            done[at] = True
            row = owner[at]
            new = c[row] - row_price[row] - column_price[:m]
            better = ~done[:m] & (new < least)
            least[better], via[better] = new[better], at
            step = np.where(done[:m], np.inf, least)
            to = int(step.argmin())
            d = step[to]
            row_price[owner[done]] += d
            column_price[done] -= d
            least[~done[:m]] -= d
            at = to
        while at != m:
            owner[at] = owner[via[at]]
            at = via[at]
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0 and finite[owner[j], j]]
    return sorted((j, i) for i, j in pairs) if turned else sorted(pairs)


class Tracks:
    """Centres, sizes and velocities of the boxes of all live tracks, with their uncertainty; a row a track, each axis on its own."""

    def __init__(self) -> None:
        self.number, self.seen = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.place, self.speed, self.size = (np.zeros((0, 2)) for _ in range(3))
        self.cov = np.zeros((3, 0))  # of place, of place with velocity, of velocity
        self.at = 0

    def keep(self, which: np.ndarray) -> None:
        for name in ("number", "seen", "place", "speed", "size"):
            setattr(self, name, getattr(self, name)[which])
        self.cov = self.cov[:, which]

    def start(self, numbers: np.ndarray, boxes: np.ndarray) -> None:
        size, n = boxes[:, 2:] - boxes[:, :2], len(boxes)
        h2 = size[:, 1] ** 2
        self.number, self.seen = np.append(self.number, numbers), np.append(self.seen, np.full(n, self.at))
        self.place, self.speed, self.size = np.concatenate([self.place, (boxes[:, :2] + boxes[:, 2:]) / 2]), np.concatenate([self.speed, np.zeros((n, 2))]), np.concatenate([self.size, size])
        self.cov = np.concatenate([self.cov, np.stack([SEEN * h2, np.zeros(n), h2])], axis=1)

    def predict(self, frame: int) -> np.ndarray:
        """The boxes in that frame."""
        q = DRIVEN * self.size[:, 1] ** 2
        for _ in range(frame - self.at if len(self.number) else 0):
            self.place = self.place + self.speed
            a, b, c = self.cov
            self.cov = np.stack([a + b + (b + c) + 0.25 * q, b + c + 0.5 * q, c + q])
        self.at = frame
        return np.concatenate([self.place - self.size / 2, self.place + self.size / 2], axis=1)

    def update(self, which: np.ndarray, boxes: np.ndarray) -> None:
        a, b, c = self.cov[:, which]
        all_ = a + SEEN * self.size[which, 1] ** 2
        off = (boxes[:, :2] + boxes[:, 2:]) / 2 - self.place[which]
        g0, g1 = a / all_, b / all_
        self.place[which] += g0[:, None] * off
        self.speed[which] += g1[:, None] * off
        self.cov[:, which] = np.stack([a - g0 * a, b - g0 * b, c - g1 * b])
        self.size[which], self.seen[which] = 0.5 * self.size[which] + 0.5 * (boxes[:, 2:] - boxes[:, :2]), self.at


def costs(where: np.ndarray, height: np.ndarray, boxes: np.ndarray, min_iou: float) -> np.ndarray:
    """(tracks, boxes): one less the overlap; where boxes do not overlap, up to two by distance, as far as a height away. Infinite beyond."""
    a, b = where[:, None], boxes[None]
    wide = np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2])
    both = np.where((wide > 0).all(axis=2), wide[..., 0] * wide[..., 1], 0.0)
    area = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    union = area(a) + area(b) - both
    over = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
    dx = (a[..., :2] + a[..., 2:] - b[..., :2] - b[..., 2:]) / 2
    away = np.sqrt(dx[..., 0] ** 2 + dx[..., 1] ** 2) / np.maximum(1e-9, height)[:, None]
    return np.where(over >= min_iou, 1 - over, np.where(away <= 1, 1 + away, np.inf))


def pairs_of(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """assignment() as rows and columns. Where each row's one cheapest column is no other row's, these are it."""
    if not cost.size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    to, least = cost.argmin(axis=1), cost.min(axis=1)
    rows = np.flatnonzero(np.isfinite(least))
    to = to[rows]
    if len(np.unique(to)) == len(to) and (cost[rows] == least[rows, None]).sum() == len(rows):
        return rows, to
    found = np.array(assignment(cost), dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def follow(frames: np.ndarray, boxes: np.ndarray, conf: np.ndarray, min_iou: float, max_gap: int) -> np.ndarray:
    """The track of each box, in order of frames; -1 for an unsure box that belongs to none."""
    out, live, count = np.full(len(frames), -1, dtype=np.int64), Tracks(), 0
    starts = np.flatnonzero(np.concatenate(([True], frames[1:] != frames[:-1]))) if len(frames) else np.array([], dtype=int)
    for lo, hi in zip(starts, [*starts[1:], len(frames)], strict=True):
        f = int(frames[lo])
        near = f - live.seen <= max_gap
        if not near.all():
            live.keep(near)
        where, free, sure_ones = live.predict(f), np.arange(len(live.number)), conf[lo:hi] >= SURE
        for sure in (True, False):
            here = lo + np.flatnonzero(sure_ones == sure)
            if not len(here):
                continue
            t, i = pairs_of(costs(where[free], live.size[free, 1], boxes[here], min_iou))
            out[here[i]] = live.number[free[t]]
            live.update(free[t], boxes[here[i]])
            free = np.delete(free, t)
            if sure:
                fresh = np.delete(here, i)
                out[fresh] = np.arange(count, count + len(fresh))
                live.start(out[fresh], boxes[fresh])
                count += len(fresh)
    return out


def tracked(detections: DataFrame, min_iou: float = 0.2, max_gap: int = 10, segment: int = SEGMENT, overlap: int = OVERLAP) -> DataFrame:
    """detections(clip, frame, x1, y1, x2, y2, conf, ...) with track_id, unique in the clip; unsure boxes that no track takes are left out.

    The overlap should be longer than max_gap. A box is told by its clip, frame and place in (x1, y1, x2, y2, conf); equal boxes of a frame are one.
    """
    box = ["clip", "frame", "x1", "y1", "x2", "y2", "conf"]
    d = detections.select(*box)
    own, at = F.expr(f"frame div {segment}"), F.col("frame") % segment
    parts = F.array(F.when(at < overlap, own - 1), own, F.when(at >= segment - overlap, own + 1))  # what comes before a segment tells it which tracks there are
    d = d.withColumn("part", F.explode(F.filter(parts, lambda p: p >= 0)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(box).sort_values(["frame", "conf", "x1", "y1", "x2", "y2"], ascending=[True, False, True, True, True, True], kind="stable").reset_index(drop=True)
        ids = follow(rows["frame"].to_numpy(), rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["conf"].to_numpy(float), min_iou, max_gap)
        return rows.assign(number=ids)

    own = stored(d.groupBy("clip", "part").applyInPandas(run, d.withColumn("number", F.lit(0).cast("long")).schema).filter("number >= 0"))
    # in an overlap, the later segment's track goes with the earlier one that has most of its boxes there, and the other way round
    met = own.filter((F.col("frame") % segment < overlap) | (F.col("frame") % segment >= segment - overlap))  # no other box is in two parts
    shared = met.select(*box, F.col("part").alias("p0"), F.col("number").alias("n0")).join(met.select(*box, F.col("part").alias("p1"), F.col("number").alias("n1")), box).filter("p1 = p0 + 1")
    votes = shared.groupBy("clip", "p0", "n0", "p1", "n1").count()
    best = lambda side, other: F.row_number().over(Window.partitionBy("clip", "p0", side).orderBy(F.desc("count"), other))
    links = votes.withColumns({"a": best("n0", "n1"), "b": best("n1", "n0")}).filter("a = 1 and b = 1")
    heads = own.select("clip", "part", "number").distinct().join(links.select("clip", F.col("p1").alias("part"), F.col("n1").alias("number"), F.col("p0").alias("to_part"), F.col("n0").alias("to_number")), ["clip", "part", "number"], "left")
    heads = stored(heads.select("clip", "part", "number", F.coalesce("to_part", "part").alias("to_part"), F.coalesce("to_number", "number").alias("to_number")))
    while True:  # each round, a head is as far again
        onward = heads.select("clip", F.col("part").alias("to_part"), F.col("number").alias("to_number"), F.col("to_part").alias("next_part"), F.col("to_number").alias("next_number"))
        further = stored(heads.join(onward, ["clip", "to_part", "to_number"]).select("clip", "part", "number", F.col("next_part").alias("to_part"), F.col("next_number").alias("to_number"), (F.col("next_part") != F.col("to_part")).alias("moved")))
        heads = further.drop("moved")
        if further.filter("moved").isEmpty():
            break
    mine = own.filter(F.col("part") == F.expr(f"frame div {segment}")).join(heads, ["clip", "part", "number"])
    ids = mine.select(*box, (F.shiftleft(F.col("to_part"), 32) + F.col("to_number")).alias("track_id"))
    return detections.join(ids, box)
