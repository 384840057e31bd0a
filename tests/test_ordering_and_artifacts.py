"""Global order without one task; identity of artifacts; as-of values by counted rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.functions import evaluation, ordering
from pitchlake.operators import value, windows
from pitchlake.operators.networks import new_attention_lstm
from pitchlake.plans.tracking_plan import TrackingPlan
from pitchlake.sources import artifacts
from pitchlake.sources.fixture import from_events


def test_ranks_equal_a_sort_and_no_task_has_all(spark):
    rng = random.Random(2)
    rows = [(f"r{i:04}", float(rng.randint(0, 40))) for i in range(900)]
    df = spark.createDataFrame(rows, "run_id string, v double")
    got = ordering.ranked(df, [F.desc("v"), F.asc("run_id")])
    want = [(i + 1, r[0]) for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))]
    assert sorted((r["rank"], r.run_id) for r in got.collect()) == want
    parts = ordering.in_ranges(df, [F.desc("v"), F.asc("run_id")], "part", "place", 4).groupBy("part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 500
    assert ordering.ranked(df.filter("false"), [F.asc("run_id")]).count() == 0


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return round(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)), 6) if pos and neg else None


def test_auc_by_ranges_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i % 3, rng.randint(0, 60) / 7, rng.random() < 0.3) for i in range(700)] + [(7, 1.0, True)] * 4
    df = spark.createDataFrame([*rows, (0, None, True), (0, 1.0, None)], "g int, s double, y boolean")
    out = evaluation.auc(df, "s", "y")
    # what comes into one partition is a row a range: their sums, for the running total, and the partial results in the end
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 2 and plan.count("Exchange SinglePartition") == sum("HashAggregate" in plan.split("Exchange SinglePartition")[i + 1].split("\n")[1] for i in range(2))
    assert out.first().auc == brute_auc([(s, y) for _, s, y in rows])
    by = {r.g: r.auc for r in evaluation.auc(df, "s", "y", ["g"]).collect()}
    assert by == {g: brute_auc([(s, y) for h, s, y in rows if h == g]) for g in (0, 1, 2, 7)}


def table(spark, rows):
    return spark.createDataFrame(rows, "match_id long, run_id string, v double, note string")


ROWS = [(m, f"{m}-{i}", i / 7, None if i % 3 else "x") for m in (1, 2, 3) for i in range(40)]


def test_digests_name_the_match_that_changed(spark, tmp_path):
    kept = artifacts.Artifacts(spark, str(tmp_path))
    kept.save(table(spark, ROWS), "runs", "v1", ["match_id"])
    shuffled = ROWS[::-1]
    kept.save(table(spark, shuffled).repartition(7).select("note", "v", "match_id", "run_id"), "runs", "v2", ["match_id"])
    assert {(r.match_id, r.n_a, r.n_b, r.same) for r in kept.compare("runs", "v1", "v2", ["match_id"]).collect()} == {(m, 40, 40, True) for m in (1, 2, 3)}
    changed = [(2, "2-5", 0.5, "x") if r[1] == "2-5" else r for r in ROWS]
    moved_null = [(*r[:2], None, r[3]) if r[1] == "3-6" else (*r[:3], None) if r[1] == "3-9" else r for r in ROWS]
    repeated = [*ROWS, ROWS[0]]
    gone = [r for r in ROWS if r[0] != 3] + [(4, "n", 1.0, None)]
    for version, rows, want in (("c", changed, {2}), ("n", moved_null, {3}), ("r", repeated, {1}), ("g", gone, {3, 4})):
        kept.save(table(spark, rows), "runs", version, ["match_id"])
        assert {r.match_id for r in kept.compare("runs", "v1", version, ["match_id"]).collect() if not r.same} == want
    assert sorted((r.run_id, r.v, r.only_in) for r in kept.rows_that_differ("runs", "v1", "c", ["match_id"]).collect()) == [("2-5", 0.5, "b"), ("2-5", 5 / 7, "a")]
    assert [(r.run_id, r.only_in) for r in kept.rows_that_differ("runs", "v1", "r", ["match_id"]).collect()] == [(ROWS[0][1], "b")]
    with pytest.raises(Exception, match="(?i)exist"):
        kept.save(table(spark, ROWS), "runs", "v1", ["match_id"])


def test_zero_has_one_digest(spark):
    a, b = (spark.createDataFrame([(1, z)], "m int, v double") for z in (0.0, -0.0))
    assert artifacts.digest(a, ["m"]).collect() == artifacts.digest(b, ["m"]).collect()


def test_weights_come_back(spark, tmp_path):
    kept, w = artifacts.Artifacts(spark, str(tmp_path)), new_attention_lstm(8)
    kept.save_weights(w, "v2", "first")
    back = kept.load_weights("v2", "first")
    assert back.keys() == w.keys() and all(np.array_equal(back[k], w[k]) and back[k].shape == w[k].shape for k in w)


@pytest.fixture(scope="module")
def plan(spark):
    return TrackingPlan(from_events(spark, "/root/testdata/sf0.01"), store=True)


def test_as_of_values_in_one_pass(spark, plan):
    from pitchlake.storage import stored

    runs, values = stored(plan.runs), stored(plan.window_values)
    got = value.value_gained(runs, values)
    rows = {r.run_id: r for r in got.collect()}
    for r in runs.limit(30).collect():
        of = [(v.w_end, v.v1) for v in values.filter(f"match_id = {r.match_id} and period = {r.period} and possession_id = {r.possession_id}").collect()]
        last = lambda f, of=of: max(((w, v) for w, v in of if w <= f), default=(None, None))[1]
        assert (rows[r.run_id].v_before, rows[r.run_id].v_after) == (last(r.f_start), last(r.f_end))
    # runs never meet windows in a join: both are sorted together, once; the one join brings runs without a window back
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join ") == 1 and text.count("Window [") == 1 and text.count("Union") == 1


def test_window_means_and_labels_explode_no_frames(spark, plan):
    for df in (windows.trailing_means(plan.features), plan.window_labels, value.probability_trace(plan.runs, plan.features)):
        text = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "sequence(w_start" not in text and "sequence(cast((w_end" not in text and "sequence((w_end" not in text
