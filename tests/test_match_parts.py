"""Matches are dealt to partitions once: what follows within them shuffles nothing, and is right after tables were cleared."""

import pytest
from pyspark.sql import functions as F

from pitchlake import storage
from pitchlake.operators import kinematics, possession, search, value, windows
from pitchlake.queries import QUERIES, plan, stored_plan

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("step", ["kin", "frames", "framed", "runs", "features", "geometry", "counterfactual", "nodes", "v1_sequences"])
def test_steps_shuffle_the_event_log_alone(spark, step):
    df = getattr(plan(spark, SF), step)
    shuffles = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and all("REPARTITION_BY_NUM" in line for line in shuffles)


def test_stored_steps_keep_how_they_were_dealt(spark):
    p = stored_plan(spark, SF)
    again = p.frames.groupBy("match_id", "period").count()
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    assert p.frames.count() == 15600


def test_tables_outlive_a_clear(spark):
    before = QUERIES["tracking_profile"](spark, SF).count()
    storage.clear(spark)
    assert QUERIES["tracking_profile"](spark, SF).count() == before == 10


def test_no_stored_table_is_broadcast_by_its_file_size(spark):
    p = stored_plan(spark, SF)
    assert "BroadcastHashJoin" not in p.features._jdf.queryExecution().executedPlan().toString()


def test_what_runs_grow_to_is_not_broadcast_by_their_file_size(spark):
    """A row for each frame of every run, and the frames of possessions, went through the driver wherever the stored file was small."""
    p = stored_plan(spark, SF)
    overlap = search.overlaps(p.geometry, p.frames, p.framed, p.t.direction)
    for df in (value.probability_trace(p.runs, p.features), overlap):
        plan_of = df._jdf.queryExecution().executedPlan().toString()
        lines = [line for line in plan_of.splitlines() if "BroadcastHashJoin" in line and "frame" in line]
        assert not lines, lines


def test_slices_have_every_entity_of_every_frame(spark):
    p = stored_plan(spark, "/root/testdata/sf0.001")
    frames = p.geometry.selectExpr("sum(f_end - f_start + 1) AS n").first().n
    assert QUERIES["run_slices"](spark, "/root/testdata/sf0.001").count() == 23 * frames


@pytest.mark.parametrize("step", ["carrier", "runs", "geometry", "features", "marks", "window_values", "counterfactual", "presses"])
def test_frames_are_not_assembled_for_runs(spark, step):
    """Every entity of every frame was collected into arrays, which lambdas went through: most of the time of what needs runs alone."""
    made = getattr(plan(spark, SF), step)._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("collect_list") == (1 if step in ("geometry", "counterfactual") else 0)
    assert step in ("geometry", "counterfactual") or "lambda" not in made


def test_carrier_of_rows_is_that_of_frames(spark):
    p = plan(spark, SF)
    a, b = p.carrier, possession.carrier(p.frames)
    assert a.columns == b.columns and a.exceptAll(b).count() == b.exceptAll(a).count() == 0 < a.count()


def test_features_of_rows_are_those_of_assembled_frames(spark):
    p = plan(spark, "/root/testdata/sf0.001")
    marks = windows.marks(possession.players(p.frames, None), kinematics.balls(p.frames))
    again = windows.frame_features(possession.players(p.frames, None), windows.lines(marks, p.t.direction), p.framed)
    near = lambda df: df.select("match_id", "frame", "team", *[F.round(c, 9).alias(c) for c in windows.FEATURES])
    assert near(p.features).exceptAll(near(again)).count() == 0 < again.count() == p.features.count()


def test_ball_behind_the_second_last_player_is_not_past(spark):
    """Level with it is not past either; with one opponent alone there is no line."""
    rows = [(1, 1, f, j, t, 0 == j, x) for f, xs in ((0, (9.0, 5.0)), (1, (9.0, 4.9)), (2, (5.1, 4.0)), (3, (4.0,))) for j, (t, x) in enumerate([("away", x) for x in xs])]
    players = spark.createDataFrame(rows, "match_id long, period int, frame long, player_id int, q_team string, is_gk boolean, x double")
    balls = spark.createDataFrame([(1, 1, f, 5.0, 34.0, 1.0) for f in range(5)], "match_id long, period int, frame long, ball_x double, ball_y double, ball_speed double")
    got = {r.frame: r for r in windows.marks(players, balls).collect()}
    assert [got[f].past_home for f in range(5)] == [False, True, True, False, None] and got[0].last_home == 5.0
