"""Runs of attackers without the ball, and their geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions.geometry import attack_x, attack_y, length
from pitchlake.params import DEFAULT, FRAME, Params


def detect_runs(kin: DataFrame, roster: DataFrame, framed: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(run_id, match_id, period, possession_id, player_id, team, fps, f_start, f_end, n_frames, duration_ms, distance).

    An attacking outfield player, not the carrier, faster than the speed in every
    frame, for the least time and path; the possession's edges and gaps cut it.
    """
    held = framed.select(*FRAME, "possession_id", F.col("team").alias("attack"), F.col("player_id").alias("carrier_id"))
    keeper = roster.filter("is_gk").select("match_id", "player_id")
    fast = kin.filter((F.col("team") != "ball") & (F.col("speed") > p.run_speed)).select(*FRAME, "fps", "player_id", "team", "step")
    fast = fast.join(keeper.hint("shuffle_hash"), ["match_id", "player_id"], "left_anti")
    fast = fast.join(held.hint("shuffle_hash"), list(FRAME)).filter("team = attack and player_id != carrier_id")
    who = ["match_id", "period", "possession_id", "player_id"]
    island = F.col("frame") - F.row_number().over(Window.partitionBy(*who).orderBy("frame"))
    g = fast.withColumn("island", island).groupBy(*who, "island").agg(F.first("team").alias("team"), F.first("fps").alias("fps"), F.min("frame").alias("f_start"), F.max("frame").alias("f_end"), F.count(F.lit(1)).alias("n_frames"), F.sum("step").alias("distance"))
    g = g.filter((F.col("n_frames") * 1000 >= p.min_run_ms * F.col("fps")) & (F.col("distance") >= p.min_run_distance))
    run_id = F.concat_ws("-", "match_id", "period", "player_id", "f_start")
    return g.select(run_id.alias("run_id"), *who, "team", "fps", "f_start", "f_end", "n_frames", F.expr("n_frames * 1000 div fps").alias("duration_ms"), "distance")


def normalised(players: Column, sign: Column, p: Params = DEFAULT) -> Column:
    """The array of players with the attack towards +x."""
    return F.transform(players, lambda q: F.struct(q["player_id"].alias("player_id"), q["team"].alias("team"), q["is_gk"].alias("is_gk"), attack_x(q["x"], sign, p).alias("x"), attack_y(q["y"], sign, p).alias("y")))


def offside_line(opponents: Column, ball_x: Column, p: Params = DEFAULT) -> Column:
    """x of the second-last opponent, keeper included, but not behind the ball or the halfway line; normalised."""
    xs = F.sort_array(F.transform(opponents, lambda q: q["x"]), asc=False)
    return F.greatest(F.get(xs, 1), ball_x, F.lit(p.pitch_length / 2))


def run_geometry(runs: DataFrame, frames: DataFrame, direction: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """runs with start and end places (normalised), nearest_def, space_before, space_after, def_displacement and behind_line.

    Only the two frames of each run are looked up; a frame's other players come in the same row.
    """
    ends = runs.select("run_id", "match_id", "period", "player_id", "team", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.col("f_start").alias("frame")), F.struct(F.lit(1).alias("at"), F.col("f_end").alias("frame")))).alias("e")).select("*", "e.*").drop("e")
    seen = frames.select(*FRAME, "ball", "players").join(ends.hint("shuffle_hash"), list(FRAME)).join(direction.hint("shuffle_hash"), ["match_id", "period", "team"])
    seen = seen.withColumn("players", normalised(F.col("players"), F.col("attack_sign"), p)).withColumn("ball_x", attack_x(F.col("ball.x"), F.col("attack_sign"), p))
    me = F.get(F.filter("players", lambda q: q["player_id"] == F.col("player_id")), 0)
    seen = seen.withColumn("me", me).withColumn("opponents", F.filter("players", lambda q: q["team"] != F.col("team")))
    near = F.array_min(F.transform(F.filter("opponents", lambda q: ~q["is_gk"]), lambda q: F.struct(length(q["x"] - F.col("me.x"), q["y"] - F.col("me.y")).alias("d"), q["player_id"].alias("player_id"), q["x"].alias("x"), q["y"].alias("y"))))
    # who is nearest at the start is settled there; only the end's opponents travel, for that one to be looked up
    seen = seen.select("match_id", "run_id", "at", "me", F.when(F.col("at") == 1, F.col("opponents")).alias("opponents"), near.alias("near"), (F.col("me.x") > offside_line(F.col("opponents"), F.col("ball_x"), p)).alias("past"))
    pick = lambda c, at: F.max(F.when(F.col("at") == at, F.col(c)))
    both = seen.groupBy("match_id", "run_id").agg(*[pick(c, at).alias(f"{c}{at}") for c in ("me", "near", "past") for at in (0, 1)], F.first("opponents", ignorenulls=True).alias("opponents"))
    both = both.withColumn("d0", F.col("near0")).withColumn("d1", F.get(F.filter("opponents", lambda q: q["player_id"] == F.col("near0.player_id")), 0))
    both = both.select(
        "match_id", "run_id", F.col("me0.x").alias("x_start"), F.col("me0.y").alias("y_start"), F.col("me1.x").alias("x_end"), F.col("me1.y").alias("y_end"),
        F.col("near0.player_id").alias("nearest_def"), F.col("near0.d").alias("space_before"), F.col("near1.d").alias("space_after"),
        length(F.col("d1.x") - F.col("d0.x"), F.col("d1.y") - F.col("d0.y")).alias("def_displacement"), (F.col("past1") & ~F.col("past0")).alias("behind_line"),
    )
    return runs.join(both, ["match_id", "run_id"], "left").select(*runs.columns, *both.columns[2:])


def shots_after(runs: DataFrame, shots: DataFrame, matches: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, run_id, shot_ms): every shot of the team after a run's end and within the horizon.

    Time is cut into buckets as long as the horizon: a shot is in one, and a run asks in the two that its horizon reaches, so that
    a run meets the shots of ten seconds and not of a period.
    """
    bucket = lambda c: F.expr(f"{c} div {p.horizon_ms}")
    s = shots.join(matches.select("match_id", "fps"), "match_id").select("match_id", "period", "team", F.expr("frame * 1000 div fps").alias("shot_ms")).distinct().withColumn("bucket", bucket("shot_ms"))
    r = runs.select("run_id", "match_id", "period", "team", F.expr("f_end * 1000 div fps").alias("end_ms"))
    asked = r.withColumn("bucket", F.explode(F.array(bucket("end_ms"), bucket("end_ms") + 1)))
    near = asked.join(s, ["match_id", "period", "team", "bucket"])
    return near.filter((F.col("shot_ms") > F.col("end_ms")) & (F.col("shot_ms") <= F.col("end_ms") + p.horizon_ms)).select("match_id", "run_id", "shot_ms")


def label_shots(runs: DataFrame, shots: DataFrame, matches: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """runs with shot_5s: the team shoots after the run's end and within the horizon; null where the match has no shot events."""
    hit = shots_after(runs, shots, matches, p).select("match_id", "run_id").distinct().withColumn("hit", F.lit(True))
    df = runs.join(hit, ["match_id", "run_id"], "left").join(matches.select("match_id", "has_shots"), "match_id", "left")
    return df.withColumn("shot_5s", F.when(F.col("has_shots"), F.coalesce("hit", F.lit(False)))).drop("hit", "has_shots")
