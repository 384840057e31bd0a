"""Small hand-made cases: one for each choice that the definitions make."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.functions import evaluation
from pitchlake.operators import models, possession, press, runs, search, value, video, windows
from pitchlake.operators.kinematics import kinematics
from pitchlake.params import DEFAULT
from pitchlake.plans.tracking_plan import TrackingPlan
from pitchlake.sources import tracking as src
from pitchlake.sources.fixture import from_events
from pitchlake.sources.schema import MATCHES, ROSTER, SHOTS, TRACKING
from pitchlake.streaming import tracking_stream

SF = "/root/testdata/sf0.001"


class Tables:
    """Canonical tables from a list of (frame, player_id, team, x, y); players 0 and 11 keep goal."""

    def __init__(self, spark, rows, fps=10, has_shots=True, shots=(), roles=None):
        full = [(1, 1, f, fps, f * 1000 // fps, p, t, float(x), float(y)) for f, p, t, x, y in rows]
        self.tracking = spark.createDataFrame(full, TRACKING)
        players = sorted({(p, t) for _, p, t, *_ in rows if t != "ball"})
        self.roster = spark.createDataFrame([(1, p, t, (roles or {}).get(p, "MF"), p in (0, 11)) for p, t in players], ROSTER)
        self.matches = spark.createDataFrame([(1, "test", fps, has_shots, 105.0, 68.0)], MATCHES)
        self.direction = spark.createDataFrame([(1, 1, "home", 1), (1, 1, "away", -1)], "match_id long, period int, team string, attack_sign int")
        self.shots = spark.createDataFrame([(1, 1, f, t) for f, t in shots], SHOTS)


def scene(n, fps=10, runner=lambda f: (50.0, 30.0), defender=lambda f: (60.0, 30.0), mirror=False):
    """Home player 1 has the ball, 2 runs; away 12 defends; keepers and a second defender stand."""
    rows = []
    for f in range(n):
        rows += [(f, 22, "ball", 40.5, 34.0), (f, 1, "home", 40.0, 34.0), (f, 2, "home", *runner(f)), (f, 12, "away", *defender(f)), (f, 13, "away", 70.0, 10.0), (f, 0, "home", 5.0, 34.0), (f, 11, "away", 100.0, 34.0)]
    return [(f, p, t, 105 - x, 68 - y) for f, p, t, x, y in rows] if mirror else rows


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_carrier_tie_edge_and_keeper(spark):
    t = Tables(spark, [(0, 22, "ball", 10, 10), (0, 5, "home", 12, 10), (0, 4, "away", 8, 10), (1, 22, "ball", 10, 10), (1, 5, "home", 13, 10), (2, 22, "ball", 10, 10), (2, 5, "home", 13.001, 10), (3, 22, "ball", 10, 10), (3, 0, "home", 10, 10)])
    assert rows(TrackingPlan(t).carrier, "frame", "player_id", "dist") == [(0, 4, 2.0), (1, 5, 3.0)]


def owners(spark, teams, fps=10):
    """A match in which home 1 or away 12 stands at the ball, or (None) nobody."""
    r = []
    for f, team in enumerate(teams):
        r += [(f, 22, "ball", 50, 30), (f, 1, "home", 50 if team == "home" else 20, 30), (f, 12, "away", 50 if team == "away" else 80, 30)]
    return TrackingPlan(Tables(spark, r, fps))


def test_vote_outvotes_a_touch_and_keeps_ties(spark):
    p = owners(spark, ["home"] * 10 + ["away"] + ["home"] * 10)
    assert {r.team for r in p.smoothed.collect()} == {"home"}
    assert rows(owners(spark, ["home", "away"]).smoothed, "frame", "team") == [(0, "home"), (1, "away")]


@pytest.mark.parametrize("fps", [10, 25])
def test_possession_edges_and_gaps(spark, fps):
    long, short = 3 * fps, 3 * fps - 1
    p = owners(spark, ["home"] * long + [None] * 2 + ["away"] * short + [None] * 2 + ["home"] * (long + 1), fps)
    assert [(r.team, r.n_frames) for r in p.possessions.orderBy("f_start").collect()] == [("home", long), ("home", long + 1)]


@pytest.mark.parametrize(("speed", "frames", "found"), [(5.5, 10, True), (5.5, 9, False), (4.0, 20, False), (4.1, 10, False), (4.1, 13, True)])
def test_run_edges(spark, speed, frames, found):
    """Faster than 4 m/s, for 1 s, over 5 m."""
    t = Tables(spark, scene(40, runner=lambda f: (50 + speed / 10 * min(max(f - 5, 0), frames), 30.0)))
    r = TrackingPlan(t).runs.collect()
    assert [(x.player_id, x.n_frames) for x in r] == ([(2, frames)] if found else [])


def test_run_is_cut_by_a_gap(spark):
    move = [r for r in scene(40, runner=lambda f: (20 + 0.6 * f, 30.0)) if not (r[0] == 20 and r[1] == 2)]
    assert rows(TrackingPlan(Tables(spark, move)).runs, "f_start", "f_end") == [(1, 19), (22, 39)]


def test_geometry_and_mirror(spark):
    kw = dict(runner=lambda f: (60 + 0.6 * min(max(f - 5, 0), 20), 30.0), defender=lambda f: (66 + 0.25 * min(max(f - 5, 0), 20), 30.0))
    want = None
    for mirror in (False, True):
        t = Tables(spark, scene(40, mirror=mirror, **kw))
        if mirror:
            t.direction = t.direction.withColumn("attack_sign", -F.col("attack_sign"))
        g = TrackingPlan(t).geometry.collect()[0]
        got = [round(x, 6) for x in (g.x_start, g.x_end, g.space_before, g.space_after, g.def_displacement)] + [g.nearest_def, g.behind_line]
        assert want is None or got == want
        want = got
    assert want == [60.6, 72.0, 5.65, 1.0, 4.75, 12, True]  # at the end the second-last opponent stands at 71


def test_shot_label_horizon_and_mask(spark):
    kw = dict(runner=lambda f: (50 + 0.6 * min(max(f - 5, 0), 20), 30.0))
    label = lambda **k: TrackingPlan(Tables(spark, scene(100, **kw), **k)).labelled.collect()[0].shot_5s
    assert label(shots=[(75, "home")]) is True
    assert label(shots=[(76, "home"), (25, "home"), (60, "away")]) is False
    assert label(shots=[(30, "home")], has_shots=False) is None


@pytest.mark.parametrize("fps", [10, 25])
def test_windows_are_whole_and_start_with_the_possession(spark, fps):
    p = owners(spark, [None] * 7 + ["home"] * (5 * fps + 3), fps)
    assert rows(p.windows, "w_start", "w_end") == [(7 + i * fps, 7 + i * fps + 3 * fps - 1) for i in range(3)]


def test_still_runner_gains_nothing(spark):
    t = Tables(spark, scene(60))
    p = TrackingPlan(t)
    one = spark.createDataFrame([("r", 1, 1, 1, 2, "home", 10, 35, 45, 50.0, 30.0)], "run_id string, match_id long, period int, possession_id long, player_id long, team string, fps int, f_start long, f_end long, x_start double, y_start double")
    drift = value.drift_velocity(one, p.kin, t.direction)
    c = value.counterfactuals(one, p.frames, t.direction, drift).collect()[0]
    assert all(c[f"cf_gain_{v}_{b}"] == pytest.approx(0, abs=1e-12) for v in ("v1", "v2") for b in ("frozen", "drift")) and c.v1_actual is not None


def test_counterfactual_without_a_whole_window_is_null(spark):
    t = Tables(spark, scene(60, runner=lambda f: (50 + 0.6 * min(f, 15), 30.0)))
    c = TrackingPlan(t).scores.collect()
    assert len(c) == 1 and c[0].v1_actual is None and c[0].v_before is None


def test_value_is_as_of_and_never_later(spark):
    t = Tables(spark, scene(80, runner=lambda f: (50 + 0.6 * min(max(f - 45, 0), 20), 30.0)))
    p = TrackingPlan(t)
    v = {r.w_end: r.v1 for r in p.window_values.collect()}
    g = p.gained.collect()[0]
    assert (g.v_before, g.v_after) == (v[39], v[59])  # run from 46 to 65


def test_press(spark):
    t = Tables(spark, scene(60, defender=lambda f: (48.0 - 0.3 * min(max(f - 30, 0), 20), 34.0)))
    p = TrackingPlan(t)
    assert rows(p.pressers, "player_id", "f_start", "f_end") == [(12, 31, 50)]
    assert rows(p.presses, "reaction_ms", "n_pressers", "forced_turnover") == [(3100, 1, False)]


def test_search_and_slice(spark):
    kw = dict(runner=lambda f: (38 + 0.6 * min(max(f - 5, 0), 20), 10.0), defender=lambda f: (45 + 0.4 * min(max(f - 5, 0), 20), 12.0))
    p = TrackingPlan(Tables(spark, scene(40, **kw), roles={12: "CB"}))
    assert search.search(p.searchable, search.DRAGGED_CENTRE_BACK).count() == 1
    assert search.search(p.searchable, search.Criteria(overlap=True)).count() == 1
    assert search.search(p.searchable, search.OVERLAP_FREE_MAN).count() == 0
    hit = search.search(p.searchable, search.DRAGGED_CENTRE_BACK, p.scores.select("run_id", "value_gained"), limit=1).collect()[0]
    assert hit.explanation.startswith("player 2 ran 12.0 m in 2.0 s; defender 12")
    s = search.run_slice(p.geometry, p.t.tracking)
    assert s.count() == 20 * 7 and {r.part for r in s.select("part").distinct().collect()} == {"runner", "defender", "ball", "other"}


def test_two_rates_find_the_same_runs(spark):
    found = []
    for fps in (10, 25):
        t = Tables(spark, scene(5 * fps, fps, runner=lambda f, fps=fps: (50 + 6 / fps * min(max(f - fps, 0), 2 * fps), 30.0)), fps)
        r = TrackingPlan(t).runs.collect()
        found.append([(x.player_id, x.duration_ms, round(x.distance, 6)) for x in r])
    assert found[0] == found[1] == [(2, 2000, 12.0)]


def test_sparse_frames_have_no_node_matrix(spark):
    full = [(f, p, "home" if p < 11 else "away" if p < 22 else "ball", 40 if p in (1, 22) else 3 * p, 30 if p in (1, 22) else 2 * p) for f in range(40) for p in range(23)]
    p = TrackingPlan(Tables(spark, [r for r in full if not (r[0] == 7 and r[1] == 15)]))
    n = windows.node_matrix(p.framed, p.t.direction, p.kin)
    assert {r.frame for r in n.filter("nodes is null").collect()} == {7} and {len(r.nodes) for r in n.filter("nodes is not null").collect()} == {184}
    assert rows(windows.sparse_frames(p.t.tracking), "frame", "n_away") == [(7, 10)]


def test_auc_matches_mllib_and_masks(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(1)
    data = [(float(rng.integers(0, 30)), bool(rng.random() < 0.4)) for _ in range(500)] + [(3.0, None)]
    df = spark.createDataFrame(data, "s double, y boolean")
    got = evaluation.auc(df, "s", "y").collect()[0]
    ml = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="l").evaluate(df.filter("y is not null").withColumn("l", F.col("y").cast("double")))
    assert got.auc == pytest.approx(ml, abs=1e-6) and got.n_pos + got.n_neg == 500


def test_evaluation_helpers(spark):
    df = spark.createDataFrame([(0.1, 0.2), (-0.1, None), (0.05, 0.1), (None, 0.3)], "a double, b double")
    assert tuple(evaluation.gain_summary(df, "a").collect()[0]) == (3, 0.016667, 0.666667, 0.1)
    assert tuple(evaluation.coverage(df, "a", "b").collect()[0]) == (4, 0.75, 0.75)
    assert tuple(evaluation.correlation(df, "a", "b").collect()[0]) == (2, 1.0)
    assert evaluation.diff(df, df).count() == 0 and evaluation.diff(df, df.limit(3)).count() == 1


def test_models(spark, tmp_path):
    w = models.seeded_lstm(11)
    models.save_weights(w, str(tmp_path / "w.npz"))
    back = models.load_weights(str(tmp_path / "w.npz"))
    x = np.random.default_rng(0).normal(size=(4, 30, 11))
    assert np.array_equal(models.lstm(w, x), models.lstm(back, x)) and ((0 < models.lstm(w, x)) & (models.lstm(w, x) < 1)).all()
    a = models.seeded_attention(8)
    nodes = np.random.default_rng(0).normal(size=(5, 23, 8))
    assert np.allclose(models.attention(a, nodes), models.attention(a, nodes[:, ::-1]))  # no order among nodes
    df = spark.createDataFrame([(1, nodes[0].reshape(-1).tolist()), (2, None)], "k long, nodes array<double>")
    got = {r.k: r for r in models.score_nodes(df, a).collect()}
    assert got[1].p_box == pytest.approx(models.attention(a, nodes[:1])[0, 1]) and got[2].p_shot is None


def test_trainable_stand_in(spark):
    p = TrackingPlan(from_events(spark, SF))
    data = p.window_values.join(p.window_labels.select(*windows.WINDOW, "line_break", "shot"), list(windows.WINDOW))
    model = models.fit_logistic(data, list(windows.FEATURES), "line_break")
    assert model.transform(data).select("probability").count() == data.count()
    assert data.filter("shot is not null").count() == 0  # the only match here has no shot events


def test_homography(spark):
    h = [0.1, 0.01, 3.0, -0.02, 0.12, 5.0, 0.0001, 0.0002, 1.0]
    f = lambda u, v: ((h[0] * u + h[1] * v + h[2]) / (h[6] * u + h[7] * v + 1), (h[3] * u + h[4] * v + h[5]) / (h[6] * u + h[7] * v + 1))
    pts = [(1, 1, 1, float(u), float(v), *f(u, v)) for u, v in [(0, 0), (900, 10), (40, 700), (800, 600), (300, 350)]] + [(1, 1, 2, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "match_id long, period int, frame long, u double, v double, px double, py double")
    solved = video.solve_homography(df, ["match_id", "period", "frame"])
    by = {r.frame: r for r in solved.collect()}
    assert by[2].h is None and np.allclose(by[1].h, h, atol=1e-6)
    out = video.apply_homography(df.select("match_id", "period", "frame", "u", "v"), solved).filter("frame = 1").collect()
    assert all(np.allclose((r.px, r.py), f(r.u, r.v)) for r in out)
    e = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, None), (4, 5.0)], "frame long, error double")
    assert tuple(video.calibration_report(e).collect()[0]) == (4, 0.5, 0.2)


def test_tracks_and_teams(spark):
    det = [("c", f, float(x + 2 * f), 0.0, float(x + 10 + 2 * f), 20.0, 0.9 if f != 3 else 0.4, *rgb) for f in range(8) for x, rgb in ((0, (200.0, 0.0, 0.0)), (100, (0.0, 0.0, 220.0)))]
    tracks = video.associate(spark.createDataFrame(det, "clip string, frame long, x1 double, y1 double, x2 double, y2 double, conf double, r double, g double, b double"))
    assert sorted((r.track_id, r["count"]) for r in tracks.groupBy("track_id").count().collect()) == [(0, 8), (1, 8)]
    teams = {r.track_id: r.team for r in video.assign_teams(tracks).collect()}
    assert set(teams.values()) == {"home", "away"}
    placed = tracks.join(video.assign_teams(tracks), ["clip", "track_id"]).select(F.lit(1).alias("period"), "frame", "track_id", "team", F.col("x1").alias("px"), F.col("y1").alias("py"))
    assert video.to_tracking(placed, 5, 25).dtypes == spark.createDataFrame([], TRACKING).dtypes


def test_adapters(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"period": 1, "frame": f, "data": [{"player_id": 1, "team": "home", "x": 0.0, "y": 0.0}, {"player_id": 22, "team": "ball", "x": 1.5, "y": -2.0}]}) for f in range(3)))
    (tmp_path / "b.xml").write_text("<Positions>" + "".join(f'<FrameSet Period="1" Team="{t}" PersonId="{i}"><Frame N="10" X="0.0" Y="0.0"/><Frame N="11" X="1.0" Y="0.5"/></FrameSet>' for i, t in ((1, "home"), (22, "ball"))) + "</Positions>")
    (tmp_path / "c.csv").write_text("period,frame,p1_x,p1_y,ball_x,ball_y\n1,0,0.5,0.5,0.1,0.2\n1,1,,,0.1,0.2\n")
    a, b = src.read_json_frames(spark, str(tmp_path / "a.json"), 1), src.read_xml_positions(spark, str(tmp_path / "b.xml"), 2)
    c = src.read_wide_csv(spark, str(tmp_path / "c.csv"), 3, {"p1": (1, "home"), "ball": (22, "ball")})
    assert rows(a, "frame", "t_ms", "player_id", "x", "y")[:2] == [(0, 0, 1, 52.5, 34.0), (0, 0, 22, 54.0, 32.0)]
    assert rows(b.filter("player_id = 1"), "frame", "t_ms", "x", "y") == [(10, 400, 52.5, 34.0), (11, 440, 53.5, 34.5)]
    assert rows(c, "frame", "player_id", "x") == [(0, 1, 52.5), (0, 22, 10.5), (1, 22, 10.5)]
    every = src.combine(a, b, c)
    src.write_tracking(every, str(tmp_path / "t"))
    back = src.load_tracking(spark, str(tmp_path / "t"))
    assert evaluation.diff(every, back).count() == 0
    assert "PartitionFilters: [isnotnull(match_id" in back.filter("match_id = 2")._jdf.queryExecution().toString()
    src.write_report(a.limit(2), str(tmp_path / "r"), "csv")
    assert src.read_video_files(spark, str(tmp_path / "*.xml")).count() == 1
    with pytest.raises(ValueError):
        src.combine(a.drop("x"))


def test_steps_between_jobs(spark, tmp_path):
    t = from_events(spark, SF)
    a = TrackingPlan(t).report("distance", 5).collect()
    assert TrackingPlan(t).persist_steps(str(tmp_path / "steps")).report("distance", 5).collect() == a


def test_streams_agree_with_batch(spark, tmp_path):
    t = from_events(spark, SF).tracking.filter("frame < 120")
    for i in range(3):
        t.filter((F.col("frame") >= 40 * i) & (F.col("frame") < 40 * i + 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = tracking_stream.stream_kinematics(tracking_stream.read_stream(spark, str(tmp_path / "in"), 1), idle_ms=None)
    q = stream.writeStream.format("memory").queryName("motion").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = rows(spark.table("motion").select("player_id", "frame", F.round("speed", 6).alias("s")).filter("s is not null and not isnan(s)"), "player_id", "frame", "s")
    want = rows(kinematics(t).select("player_id", "frame", F.round("speed", 6).alias("s")).filter("s is not null"), "player_id", "frame", "s")
    assert got == want
    q = tracking_stream.hopping_windows(tracking_stream.read_stream(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("hops").option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = {(r.w_start_ms, r.team): r.n for r in tracking_stream.hopping_windows(t).collect()}
    seen = {(r.w_start_ms, r.team): r.n for r in spark.table("hops").collect()}
    assert seen and all(batch[k] == n for k, n in seen.items())


def test_attention_lstm_against_loops(spark):
    """The second model, step by step and node by node, against the batched one; frame vectors through Spark."""
    w = models.seeded_attention_lstm(8, width=4, hidden=3)
    rng = np.random.default_rng(5)
    frames = rng.normal(0, 10, (6, 23, 8))

    def sig(x):
        return 1 / (1 + math.exp(-x))

    def vector(nodes):
        e = [[math.tanh(sum(n[i] * w["scale"][i] * w["in"][i][j] for i in range(8))) for j in range(4)] for n in nodes]
        q, k, v = ([[sum(x[i] * w[m][i][j] for i in range(4)) for j in range(4)] for x in e] for m in "qkv")
        total = [0.0] * 4
        for a in range(23):
            s = [math.exp(sum(q[a][i] * k[b][i] for i in range(4)) / 2) for b in range(23)]
            for j in range(4):
                total[j] += (e[a][j] + sum(s[b] * v[b][j] for b in range(23)) / sum(s)) / 23
        return total

    def probabilities(seq):
        for layer in (0, 1):
            h, c, out = [0.0] * 3, [0.0] * 3, []
            for x in seq:
                z = [sum(x[i] * w[f"x{layer}"][i][j] for i in range(len(x))) + sum(h[i] * w[f"h{layer}"][i][j] for i in range(3)) + w[f"b{layer}"][j] for j in range(12)]
                c = [sig(z[3 + j]) * c[j] + sig(z[j]) * math.tanh(z[9 + j]) for j in range(3)]
                h = [sig(z[6 + j]) * math.tanh(c[j]) for j in range(3)]
                out.append(h)
            seq = out
        return [sig(sum(seq[-1][i] * w["out"][i][j] for i in range(3))) for j in range(3)]

    rows = [(i, [float(x) for x in f.reshape(-1)]) for i, f in enumerate(frames)] + [(6, None)]
    got = {r.id: r.v for r in models.embedded(spark.createDataFrame(rows, "id long, nodes array<double>"), w).collect()}
    want = [[float(x) for x in vector(f.tolist())] for f in frames]
    assert all(np.allclose(got[i], want[i]) for i in range(6)) and got[6] == [0.0] * 4
    seqs = spark.createDataFrame([(0, want), (1, want[:4]), (2, want[2:])], "id long, seq array<array<double>>")
    for r in models.score_frame_vectors(seqs, w).collect():
        assert np.allclose([r.p_shot, r.p_box, r.p_line], probabilities([want, want[:4], want[2:]][r.id]))


def test_tracks_of_a_clip_with_a_long_gap(spark):
    """Parts apart by more than the gap are tracked on their own, with ids of their own."""
    boxes = [("c", f, 0.0 + f, 0.0, 10.0 + f, 10.0, 0.9) for f in (0, 1, 2, 7, 20, 21)]
    got = rows(video.associate(spark.createDataFrame(boxes, "clip string, frame long, x1 double, y1 double, x2 double, y2 double, conf double"), max_gap=5), "frame", "track_id")
    ids = [t for _, t in sorted(got)]
    assert len(ids) == 6 and len(set(ids[:3])) == 1 and ids[4] == ids[5] and ids[4] not in ids[:4]
