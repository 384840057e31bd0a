"""Association of boxes and robust calibration."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import association, calibration, video

BOX = "clip string, frame long, x1 double, y1 double, x2 double, y2 double, conf double"


@pytest.mark.parametrize("seed", range(40))
def test_assignment_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    cost = rng.random((n, m)).round(2)
    cost[rng.random((n, m)) < 0.3] = np.inf
    best = (0, 0.0)
    rows = range(n)
    for k in range(min(n, m), 0, -1):
        options = [sum(cost[r, c] for r, c in zip(rs, cs, strict=True)) for rs in itertools.combinations(rows, k) for cs in itertools.permutations(range(m), k)]
        finite = [x for x in options if np.isfinite(x)]
        if finite:
            best = (k, min(finite))
            break
    got = association.assignment(cost)
    assert len(got) == best[0] and sum(cost[r, c] for r, c in got) == pytest.approx(best[1])
    assert len({r for r, _ in got}) == len({c for _, c in got}) == len(got)


def moving(n=120):
    """Two boxes that cross, one that stands, one that is unsure for a while; (rows, who is who)."""
    rows, who = [], {}
    for f in range(n):
        for name, (x, y, conf) in {"a": (10.0 + 3 * f, 100.0, 0.9), "b": (370.0 - 3 * f, 108.0, 0.9), "c": (200.0, 300.0, 0.9), "d": (50.0 + f, 200.0, 0.2 if 40 <= f < 60 else 0.8)}.items():
            if name == "c" and 70 <= f < 76:
                continue
            row = ("x", f, x, y, x + 20, y + 40, conf)
            rows.append(row)
            who[row] = name
    return rows, who


@pytest.mark.parametrize("segment", [10_000, 60, 40])
def test_crossing_paths_keep_their_ids_however_a_clip_is_cut(spark, segment):
    rows, who = moving()
    got = association.tracked(spark.createDataFrame(rows, BOX).repartition(5), segment=segment, overlap=15).collect()
    names = {}
    for r in got:
        names.setdefault(r.track_id, set()).add(who[tuple(r[:7])] if r[0] == "x" else None)
    assert len(got) == len(rows) and sorted(map(sorted, names.values())) == [["a"], ["b"], ["c"], ["d"]]


def test_segments_are_tasks_of_their_own(spark):
    rows = [("x", f, 5.0, 5.0, 25.0, 45.0, 0.9) for f in range(400)] + [("y", f, 5.0, 5.0, 25.0, 45.0, 0.9) for f in range(3)] + [("y", 2, 50.0, 5.0, 70.0, 45.0, 0.1)]
    got = association.tracked(spark.createDataFrame(rows, BOX), segment=50, overlap=15)
    assert {r.clip: r.n for r in got.groupBy("clip").agg(F.count_distinct("track_id").alias("n")).collect()} == {"x": 1, "y": 1}
    assert got.count() == len(rows) - 1  # an unsure box that no track takes
    assert association.tracked(spark.createDataFrame([], BOX)).count() == 0


TRUE = np.array([0.05, 0.004, 10.0, -0.003, 0.08, 4.0, 0.00002, 0.0004, 1.0])


def seen(rng, n, noise=0.0):
    u, v = rng.uniform(0, 1920, n), rng.uniform(100, 1080, n)
    x, y, _ = calibration.mapped(TRUE[None], u, v)
    return u, v, x[0] + rng.normal(size=n) * noise, y[0] + rng.normal(size=n) * noise


def test_outliers_are_left_out(spark):
    rng = np.random.default_rng(2)
    rows = []
    for f in range(12):
        u, v, x, y = seen(rng, 20, noise=0.03)
        bad = rng.permutation(20)[:8]  # two fifths
        x[bad] += rng.uniform(3, 30, 8)
        y[bad] -= rng.uniform(3, 30, 8)
        rows += [(f, *map(float, r)) for r in zip(u, v, x, y, strict=True)]
    df = spark.createDataFrame(rows, "frame long, u double, v double, px double, py double")
    got = calibration.solve(calibration.points(df, ["frame"]), ["frame"]).collect()
    assert len(got) == 12
    for r in got:
        u, v, x, y = seen(rng, 200)
        gx, gy, _ = calibration.mapped(np.array(r.h)[None], u, v)
        inside = (x > -5) & (x < 110) & (y > -5) & (y < 73)
        assert np.median(np.hypot(gx[0] - x, gy[0] - y)[inside]) < 0.2 and r.n == 20 and r.n_agree >= 11
    again = calibration.solve(calibration.points(df.repartition(7), ["frame"]), ["frame"]).collect()
    assert {r.frame: r.h for r in got} == {r.frame: r.h for r in again}


def test_lines_beside_points(spark):
    """Two points and three lines settle a homography; the lines are those of the pitch, seen through two pixels each."""
    inverse = np.linalg.inv(TRUE.reshape(3, 3))

    def pixel(x, y):
        p = inverse @ [x, y, 1]
        return float(p[0] / p[2]), float(p[1] / p[2])

    pts = [(1, *pixel(30, 20), 30.0, 20.0), (1, *pixel(60, 50), 60.0, 50.0)]
    lines = [(1, *pixel(0, 5), *pixel(0, 60), 1.0, 0.0, 0.0), (1, *pixel(10, 0), *pixel(70, 0), 0.0, 1.0, 0.0), (1, *pixel(52.5, 3), *pixel(52.5, 66), 1.0, 0.0, -52.5)]
    p = spark.createDataFrame(pts, "frame long, u double, v double, px double, py double")
    x = spark.createDataFrame(lines, "frame long, u double, v double, u2 double, v2 double, a double, b double, c double")
    both = calibration.points(p, ["frame"]).unionByName(calibration.lines(x, ["frame"]))
    r = calibration.solve(both, ["frame"]).first()
    assert np.allclose(r.h, TRUE, rtol=1e-6, atol=1e-9) and r.n_agree == 5


def test_degenerate_frames_have_none(spark):
    line = [(1, float(i), 2.0 * i, float(i), float(i)) for i in range(9)]
    same = [(2, 1.0, 2.0, 3.0, 4.0)] * 8
    few = [(3, 0.0, 0.0, 1.0, 1.0), (3, 5.0, 0.0, 2.0, 1.0), (3, 0.0, 5.0, 1.0, 3.0)]
    bad = [(4, float("nan"), 1.0, 2.0, 3.0), (4, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(line + same + few + bad, "frame long, u double, v double, px double, py double")
    assert {r.frame: r.h for r in calibration.solve(calibration.points(df, ["frame"]), ["frame"]).collect()} == {1: None, 2: None, 3: None, 4: None}


def test_smoothing_fills_a_gap(spark):
    rows = [(1, f, None if f == 4 else [float(x) for x in TRUE + np.array([0, 0, f * 0.1, 0, 0, 0, 0, 0, 0])]) for f in range(9)]
    got = {r.frame: r.h for r in calibration.smoothed(spark.createDataFrame(rows, "clip int, frame long, h array<double>"), ["clip"], reach=1).collect()}
    assert np.allclose(got[4], TRUE + np.array([0, 0, 0.4, 0, 0, 0, 0, 0, 0]), atol=1e-6) and np.allclose(got[2], TRUE + np.array([0, 0, 0.2, 0, 0, 0, 0, 0, 0]), atol=1e-6)


def test_calibration_report_of_figures(spark):
    e = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, None), (4, 9.0)], "frame long, error double")
    assert tuple(video.calibration_report(e).first()) == (4, 0.5, 0.2)


def test_tracks_of_the_table_are_of_one_player_mostly(spark):
    from pitchlake.queries import QUERIES

    rows = QUERIES["player_tracks"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.n_boxes == 22 * 1200 and r.n_right >= 0.8 * r.n_boxes and 22 <= r.n_tracks < 60 for r in rows), rows
