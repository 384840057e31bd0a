"""What queries do at size, and that they do their whole job."""

import numpy as np

from pitchlake.functions import evaluation
from pitchlake.operators import association, calibration, networks, training, video
from pitchlake.queries import QUERIES, plan

SF = "/root/testdata/sf0.001"


def test_tracking_is_not_broadcast_to_count_its_rows(spark):
    """The tracking table, which a small event log grows to, went through the driver wherever that log's file was small."""
    made = QUERIES["rows_by_source"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = made[made.index("Join") :]
    assert below.index("Aggregate [match_id") < below.index("Generate")


def test_every_row_of_both_versions_is_compared(spark):
    """A version of no rows, or of other runs, passed for the same as long as its twin had the same fault."""
    found = QUERIES["artifact_diff"](spark, SF).collect()
    assert len(found) == QUERIES["runs_detected"](spark, SF).count() > 0 and all((r.n_a, r.n_b, r.only_in) == (1, 1, None) for r in found)
    a, b = (spark.createDataFrame(rows, "k int, v double") for rows in ([(1, 0.5), (1, 0.5), (2, None), (3, 1.0)], [(1, 0.5), (2, None), (3, 2.0)]))
    assert {tuple(r) for r in evaluation.compared(a, b).collect()} == {(1, 0.5, 2, 1, "a"), (2, None, 1, 1, None), (3, 1.0, 1, 0, "a"), (3, 2.0, 0, 1, "b")}


def test_node_sums_make_no_arrays(spark):
    """Each frame's entities went through arrays and lambdas before they were added up again."""
    made = QUERIES["node_matrices"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in made and "lambda" not in made
    rows = plan(spark, SF).node_rows.filter("frame = 100 and match_id = 0").orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(23)) and [r.group for r in rows] == [0] * 11 + [1] * 11 + [2] and all(r.whole for r in rows)
    nodes = plan(spark, SF).nodes.filter("frame = 100 and match_id = 0").first().nodes
    assert nodes == [r[c] for r in rows for c in ("x", "y", "vx", "vy", "speed", "attack", "is_ball", "to_ball")]


def test_frames_are_calibrated_many_at_once(spark, monkeypatch):
    """Each frame drew and decomposed its samples alone; those of equally many points go together, and find what a frame alone does."""
    rng = np.random.default_rng(4)
    true = np.array([[0.05, 0.004, 10.0, -0.003, 0.08, 4.0, 0.00002, 0.0004, 1.0]])
    for n, bad, noise in ((23, 9, 0.0), (20, 8, 0.03), (6, 1, 0.01), (4, 0, 0.0)):
        m = np.full((30, n, 9), np.nan)
        m[:, :, 0], m[:, :, 1] = rng.uniform(0, 1920, (30, n)), rng.uniform(100, 1080, (30, n))
        for i in range(30):
            x, y, _ = calibration.mapped(true, m[i, :, 0], m[i, :, 1])
            m[i, :, 4], m[i, :, 5] = x[0] + rng.normal(size=n) * noise, y[0] + rng.normal(size=n) * noise
            m[i, :bad, 4] += rng.uniform(3, 30, bad)
        together, which = calibration.point_consensus(m, np.arange(30))
        for i in range(30):
            alone, own = calibration.consensus(m[i], seed=i)
            assert np.allclose(together[i], alone, rtol=1e-6, atol=1e-9) and (which[i] == own).all()
    on_a_line = np.full((1, 8, 9), np.nan)
    on_a_line[0, :, 0] = on_a_line[0, :, 1] = on_a_line[0, :, 4] = on_a_line[0, :, 5] = np.arange(8)
    assert np.isnan(calibration.point_consensus(on_a_line, np.arange(1))[0]).all()


def test_tracks_are_moved_together_and_matched_as_one_by_one():
    """A frame's tracks and boxes were compared pair by pair; the sums are the same, and pairs are the optimal assignment where cheapest columns clash."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        cost = rng.random(rng.integers(1, 7, 2))
        cost[rng.random(cost.shape) < 0.4] = np.inf
        rows, columns = association.pairs_of(cost)
        assert list(zip(rows.tolist(), columns.tolist(), strict=True)) == association.assignment(cost)
    a, b = (np.concatenate([p, p + rng.uniform(1, 4, (9, 2))], axis=1) for p in rng.uniform(0, 8, (2, 9, 2)))
    found = association.costs(a, a[:, 3] - a[:, 1], b, 0.2)
    for i in range(9):
        for j in range(9):
            over, away = video.iou(a[i], b[j]), np.linalg.norm((a[i, :2] + a[i, 2:] - b[j, :2] - b[j, 2:]) / 2) / (a[i, 3] - a[i, 1])
            assert np.isclose(found[i, j], 1 - over if over >= 0.2 else 1 + away if away <= 1 else np.inf)


def test_windows_share_their_frames_in_training(spark):
    """Each frame's entities stood in three windows, and every head went its own way back; one way back over shared frames has the same gradients."""
    rng = np.random.default_rng(7)
    w = {**networks.new_attention_lstm(8, 5, 4, 3), "shift": rng.normal(size=8), "scale": rng.uniform(0.5, 2, 8)}
    x, at = rng.normal(size=(9, 6, 8)), np.arange(4)[:, None] + np.arange(5)
    y, weight = np.array([[0, 1, -1], [1, -1, 0], [1, 0, 1], [0, 0, -1]], dtype=float), np.array([1.5, 1.0, 2.0])
    loss, n, grads = networks.loss_and_gradients(w, x[at], y)
    loss_too, one = networks.weighted_gradients(w, x, y, weight, at)
    assert np.allclose(loss, loss_too) and all(np.allclose(one[k], sum(c * g[k] for c, g in zip(weight, grads, strict=True))) for k in one)
    p = plan(spark, SF)
    labels = p.window_labels.select("match_id", "period", "possession_id", "w_start", "w_end", "box_entry", "line_break")
    plain = p.v2_sequences.join(labels.drop("w_end"), ["match_id", "period", "possession_id", "w_start"])
    apart, together = training.packs(plain, ["box_entry", "line_break"]), training.shared_packs(labels, p.nodes, ["box_entry", "line_break"])
    start = networks.new_attention_lstm(8, 4, 4, heads=2)
    one, other = (training.fit(packed, start, (23, 8), steps=2) for packed in (apart, together))
    assert np.allclose(one.losses, other.losses, atol=1e-8) and all(np.allclose(one.weights[k], other.weights[k], atol=1e-5) for k in one.weights)
    assert together.selectExpr("sum(size(x))").first()[0] < 0.5 * apart.selectExpr("sum(size(x))").first()[0]
