"""Who has the ball, and possessions as intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions.geometry import length
from pitchlake.params import DEFAULT, FRAME, Params


def frames(tracking: DataFrame, roster: DataFrame) -> DataFrame:
    """A row a frame: match_id, period, frame, fps, t_ms, ball (x, y, speed if known) and players, an array of (player_id, team, is_gk, x, y).

    One shuffle brings a frame's entities together; what compares entities of a
    frame then works inside the row.
    """
    keeper = roster.filter("is_gk").select("match_id", "player_id", F.lit(True).alias("is_gk"))
    speed = F.col("speed") if "speed" in tracking.columns else F.lit(None).cast("double")
    t = tracking.join(keeper.hint("shuffle_hash"), ["match_id", "player_id"], "left")
    ball = F.struct("x", "y", speed.alias("speed"))
    player = F.struct("player_id", "team", F.coalesce("is_gk", F.lit(False)).alias("is_gk"), "x", "y")
    return t.groupBy(*FRAME).agg(
        F.max("fps").alias("fps"), F.max("t_ms").alias("t_ms"), F.max(F.when(F.col("team") == "ball", ball)).alias("ball"),
        F.sort_array(F.collect_list(F.when(F.col("team") != "ball", player))).alias("players"),  # by player: sums of doubles over it do not depend on the shuffle
    )


def frames_at(tracking: DataFrame, roster: DataFrame, asked: DataFrame) -> DataFrame:
    """frames() of the frames in asked alone: other rows go before a frame's entities are brought together."""
    return frames(tracking.join(asked.select(*FRAME).distinct().hint("shuffle_hash"), list(FRAME), "left_semi"), roster)


def players(tracking: DataFrame, roster: DataFrame) -> DataFrame:
    """(match_id, period, frame, fps, t_ms, player_id, q_team, is_gk, x, y): a row a player and frame; of frames() too, whose arrays are taken apart."""
    if "players" in tracking.columns:
        return tracking.select(*FRAME, "fps", "t_ms", F.inline("players")).withColumnRenamed("team", "q_team")
    keeper = roster.filter("is_gk").select("match_id", "player_id", F.lit(True).alias("is_gk"))
    t = tracking.filter("team <> 'ball'").join(keeper.hint("shuffle_hash"), ["match_id", "player_id"], "left")
    return t.select(*FRAME, "fps", "t_ms", "player_id", F.col("team").alias("q_team"), F.coalesce("is_gk", F.lit(False)).alias("is_gk"), "x", "y")


def nearest(players: DataFrame, balls: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """carrier() of players() and balls (a row a frame): only players within the radius are brought together by frame."""
    b = balls.select(*FRAME, "ball_x", "ball_y")
    near = players.filter("not is_gk").join(b.hint("shuffle_hash"), list(FRAME)).withColumn("dist", length(F.col("x") - F.col("ball_x"), F.col("y") - F.col("ball_y"))).filter(F.col("dist") <= p.carrier_radius)
    best = near.groupBy(*FRAME, "fps", "t_ms").agg(F.min(F.struct("dist", "player_id", F.col("q_team").alias("team_raw"))).alias("c"))
    return best.select(*FRAME, "fps", "t_ms", "c.player_id", "c.team_raw", "c.dist")


def carrier(frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, period, frame, fps, t_ms, player_id, team_raw, dist): the outfield player nearest to the ball, ties to the lower id, if within the radius."""
    near = F.transform(F.filter("players", lambda q: ~q["is_gk"]), lambda q: F.struct(length(q["x"] - F.col("ball.x"), q["y"] - F.col("ball.y")).alias("dist"), q["player_id"].alias("player_id"), q["team"].alias("team_raw")))
    best = frames.filter("ball is not null").select(*FRAME, "fps", "t_ms", F.array_min(near).alias("c"))
    return best.filter(F.col("c.dist") <= p.carrier_radius).select(*FRAME, "fps", "t_ms", "c.player_id", "c.team_raw", "c.dist")


def smooth_team(carrier: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """carrier with team: the majority over the vote window around the frame; a tie keeps the raw team."""
    half = p.vote_ms // 2
    w = Window.partitionBy("match_id", "period").orderBy("t_ms").rangeBetween(-half, half)
    vote = F.sum(F.when(F.col("team_raw") == "home", 1).otherwise(-1)).over(w)
    return carrier.withColumn("vote", vote).withColumn("team", F.when(F.col("vote") > 0, "home").when(F.col("vote") < 0, "away").otherwise(F.col("team_raw"))).drop("vote")


def possession_frames(smoothed: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Carrier frames with possession_id (counted within the period), f_start, f_end and n_frames; only possessions of the least duration.

    A possession ends where the team changes or a frame has no carrier.
    """
    w = Window.partitionBy("match_id", "period").orderBy("frame")
    new = (F.lag("frame").over(w).isNull()) | (F.col("frame") - F.lag("frame").over(w) != 1) | (F.col("team") != F.lag("team").over(w))
    df = smoothed.withColumn("new", new.cast("long")).withColumn("possession_id", F.sum("new").over(w)).drop("new")
    one = Window.partitionBy("match_id", "period", "possession_id")
    df = df.withColumns({"f_start": F.min("frame").over(one), "f_end": F.max("frame").over(one), "n_frames": F.count(F.lit(1)).over(one)})
    return df.filter(F.col("n_frames") * 1000 >= p.min_possession_ms * F.col("fps"))


def possessions(framed: DataFrame) -> DataFrame:
    """(match_id, period, possession_id, team, fps, f_start, f_end, n_frames, duration_ms) of possession_frames()."""
    g = framed.groupBy("match_id", "period", "possession_id").agg(*[F.first(c).alias(c) for c in ("team", "fps", "f_start", "f_end", "n_frames")])
    return g.withColumn("duration_ms", F.expr("n_frames * 1000 div fps"))
