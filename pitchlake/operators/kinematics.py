"""Velocity and speed of each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions.geometry import length
from pitchlake.params import ENTITY


def kinematics(tracking: DataFrame) -> DataFrame:
    """tracking with vx, vy, speed and step (metres since the frame before); null after a gap and at the start."""
    w = Window.partitionBy(*ENTITY).orderBy("frame")
    step = F.col("frame") - F.lag("frame").over(w) == 1
    dx, dy = F.when(step, F.col("x") - F.lag("x").over(w)), F.when(step, F.col("y") - F.lag("y").over(w))
    df = tracking.withColumns({"dx": dx, "dy": dy})
    d = length(F.col("dx"), F.col("dy"))
    return df.select(*tracking.columns, (F.col("dx") * F.col("fps")).alias("vx"), (F.col("dy") * F.col("fps")).alias("vy"), (d * F.col("fps")).alias("speed"), d.alias("step"))


def ball_state(kin: DataFrame) -> DataFrame:
    """(match_id, period, frame, ball_x, ball_y, ball_speed)."""
    return kin.filter("team = 'ball'").select("match_id", "period", "frame", F.col("x").alias("ball_x"), F.col("y").alias("ball_y"), F.col("speed").alias("ball_speed"))


def balls(tracking: DataFrame) -> DataFrame:
    """ball_state() of the ball's rows, a row a frame; only these are put in order. frames() with the ball's speed have it already."""
    if "ball" in tracking.columns:
        return tracking.filter("ball is not null").select("match_id", "period", "frame", F.col("ball.x").alias("ball_x"), F.col("ball.y").alias("ball_y"), F.col("ball.speed").alias("ball_speed"))
    place = F.max(F.struct("x", "y")).alias("at")  # a second ball in a frame does not double its rows
    one = tracking.filter("team = 'ball'").groupBy("match_id", "period", "frame", "fps", "player_id", "team").agg(place)
    return ball_state(kinematics(one.select("match_id", "period", "frame", "fps", "player_id", "team", "at.x", "at.y")))


def with_ball_speed(frames: DataFrame) -> DataFrame:
    """frames with the ball's speed as kinematics() has it: from a frame's ball and that of the frame before, without the other entities' order."""
    w = Window.partitionBy("match_id", "period").orderBy("frame")
    before = F.when(F.col("frame") - F.lag("frame").over(w) == 1, F.lag("ball").over(w))
    df = frames.withColumn("_before", before)
    speed = length(F.col("ball.x") - F.col("_before.x"), F.col("ball.y") - F.col("_before.y")) * F.col("fps")
    return df.withColumn("ball", F.when(F.col("ball").isNotNull(), F.struct(F.col("ball.x").alias("x"), F.col("ball.y").alias("y"), speed.alias("speed")))).drop("_before")
