"""From detections in video frames to the tracking table.

Detectors are outside; their output is a table of boxes. What is here: tracks
from boxes, teams from jersey colours, a homography for each frame and its use,
and how well calibration did.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.sources.schema import TRACKING, conform


def associate(detections: DataFrame, min_iou: float = 0.3, max_gap: int = 5) -> DataFrame:
    """detections(clip, frame, x1, y1, x2, y2, conf, ...) with track_id: boxes go to the track they overlap most, first confident ones, then the rest.

    A track ends when it is not seen for more than max_gap frames, so a clip is cut at longer gaps without any box, and each
    part is a group of its own; ids are unique in the clip."""
    w = Window.partitionBy("clip").orderBy("frame")
    apart = F.coalesce((F.col("frame") - F.lag("frame").over(w) > max_gap).cast("long"), F.lit(0))
    detections = detections.withColumn("_new", apart).withColumn("_part", F.sum("_new").over(w)).drop("_new")
    schema = detections.drop("_part").select("*", F.lit(0).cast("long").alias("track_id")).schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame", "conf", "x1", "y1"], ascending=[True, False, True, True], kind="stable").reset_index(drop=True)
        ids, last, next_id = np.zeros(len(rows), dtype=np.int64), {}, 0
        boxes, frames, sure = rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["frame"].to_numpy(), rows["conf"].to_numpy() >= 0.5
        for f in np.unique(frames):
            here, free = np.flatnonzero(frames == f), {t for t, (g, _) in last.items() if f - g <= max_gap}
            for tier in (True, False):
                for i in here[sure[here] == tier]:
                    best = max(((iou(boxes[i], last[t][1]), -t) for t in free), default=(0.0, 0))
                    if best[0] >= min_iou:
                        t = -best[1]
                        free.discard(t)
                    elif tier:
                        t, next_id = next_id, next_id + 1
                    else:
                        ids[i] = -1  # an unsure box starts no track
                        continue
                    ids[i], last[t] = t, (f, boxes[i])
        ids[ids >= 0] += int(rows["_part"].iloc[0]) << 32
        return rows.drop(columns="_part").assign(track_id=ids)

    return detections.groupBy("clip", "_part").applyInPandas(run, schema).filter("track_id >= 0")


def iou(a: np.ndarray, b: np.ndarray) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def assign_teams(tracks: DataFrame, rounds: int = 20) -> DataFrame:
    """tracks(clip, track_id, r, g, b) -> (clip, track_id, team): two means of the tracks' mean jersey colours, within each clip,
    as kits differ between clips; home is the team of the clip's first track."""
    mean = tracks.groupBy("clip", "track_id").agg(*[F.avg(c).alias(c) for c in "rgb"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:  # a row for each track of the clip
        rows = rows.sort_values("track_id", kind="stable").reset_index(drop=True)
        x = rows[["r", "g", "b"]].to_numpy(float)
        far = ((x - x[0]) ** 2).sum(axis=1).argmax()
        centre = np.stack([x[0], x[far]])
        for _ in range(rounds):
            side = ((x[:, None] - centre) ** 2).sum(axis=2).argmin(axis=1)
            new = np.stack([x[side == k].mean(axis=0) if (side == k).any() else centre[k] for k in (0, 1)])
            if np.array_equal(new, centre):
                break
            centre = new
        return rows[["clip", "track_id"]].assign(team=np.where(side == side[0], "home", "away"))

    return mean.groupBy("clip").applyInPandas(run, mean.select("clip", "track_id", F.lit("").alias("team")).schema)


def solve_homography(points: DataFrame, keys: list[str]) -> DataFrame:
    """points(keys..., u, v, px, py) -> (keys..., h, n_points): least-squares homography from pixels to pitch, nine numbers; null with fewer than four points."""
    g = points.groupBy(*keys).agg(F.collect_list(F.struct("u", "v", "px", "py")).alias("pts"))

    @F.pandas_udf("array<double>")
    def solve(pts: pd.Series) -> pd.Series:
        return pts.map(lambda rows: fit_homography(np.array([[r["u"], r["v"], r["px"], r["py"]] for r in rows], dtype=float)))

    return g.select(*keys, solve("pts").alias("h"), F.size("pts").alias("n_points"))


def fit_homography(p: np.ndarray) -> list[float] | None:
    if len(p) < 4:
        return None
    u, v, x, y = p.T
    one, zero = np.ones(len(p)), np.zeros(len(p))
    a = np.concatenate([np.stack([u, v, one, zero, zero, zero, -x * u, -x * v, -x], axis=1), np.stack([zero, zero, zero, u, v, one, -y * u, -y * v, -y], axis=1)])
    scale = np.abs(a).max(axis=0)
    h = np.linalg.svd(a / scale)[2][-1] / scale
    return None if abs(h[8]) < 1e-12 else (h / h[8]).tolist()


def apply_homography(points: DataFrame, homography: DataFrame, keys: tuple[str, ...] = ("match_id", "period", "frame")) -> DataFrame:
    """points(keys..., u, v) with px, py on the pitch; homography(keys..., h)."""
    h = lambda i: F.get("h", i)
    u, v = F.col("u"), F.col("v")
    w = h(6) * u + h(7) * v + h(8)
    return points.join(homography, list(keys)).withColumns({"px": (h(0) * u + h(1) * v + h(2)) / w, "py": (h(3) * u + h(4) * v + h(5)) / w}).drop("h")


def calibration_report(errors: DataFrame, ok_metres: float = 1.0) -> DataFrame:
    """errors(frame, error), null where calibration failed -> (n, success_rate, median_error) over frames."""
    good = F.coalesce(F.col("error") <= ok_metres, F.lit(False))
    return errors.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(good.cast("double")), 6).alias("success_rate"), F.round(F.median(F.when(good, F.col("error"))), 6).alias("median_error"))


def to_tracking(tracked: DataFrame, match_id: int, fps: int) -> DataFrame:
    """Tracked, placed and team-assigned boxes (period, frame, track_id, team, px, py) as the canonical table."""
    t = tracked.select(F.lit(match_id).alias("match_id"), "period", "frame", F.lit(fps).alias("fps"), F.col("track_id").alias("player_id"), "team", F.col("px").alias("x"), F.col("py").alias("y"))
    return conform(t.withColumn("t_ms", F.expr("frame * 1000 div fps")), TRACKING)
