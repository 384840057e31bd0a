"""Pressing: who closes on the carrier, when it starts, and whether it forces a turnover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions.geometry import length
from pitchlake.params import DEFAULT, FRAME, Params


def pressers(players: DataFrame, framed: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, period, possession_id, player_id, fps, f_start, f_end): outfield opponents who close on the carrier, within the radius and faster than the press speed, for the least time."""
    held = framed.select(*FRAME, "possession_id", "team", "player_id")
    held = players.select(*FRAME, "player_id", F.col("x").alias("me_x"), F.col("y").alias("me_y")).join(held.hint("shuffle_hash"), [*FRAME, "player_id"]).withColumnRenamed("player_id", "carrier_id")
    df = players.filter("not is_gk").join(held.hint("shuffle_hash"), list(FRAME)).filter("q_team <> team")
    df = df.select(*FRAME, "fps", "possession_id", "carrier_id", "player_id", length(F.col("x") - F.col("me_x"), F.col("y") - F.col("me_y")).alias("d"))
    who = ["match_id", "period", "possession_id", "player_id"]
    w = Window.partitionBy(*who, "carrier_id").orderBy("frame")
    closing = F.when(F.col("frame") - F.lag("frame").over(w) == 1, (F.lag("d").over(w) - F.col("d")) * F.col("fps"))
    df = df.withColumn("closing", closing).filter((F.col("d") <= p.press_radius) & (F.col("closing") > p.press_speed))
    island = F.col("frame") - F.row_number().over(Window.partitionBy(*who).orderBy("frame"))
    g = df.withColumn("island", island).groupBy(*who, "island").agg(F.first("fps").alias("fps"), F.min("frame").alias("f_start"), F.max("frame").alias("f_end"), F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") * 1000 >= p.min_press_ms * F.col("fps")).drop("island", "n")


def presses(pressers: DataFrame, possessions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(press_id, match_id, period, possession_id, f_start, f_end, reaction_ms, n_pressers, forced_turnover).

    Closing defenders whose times overlap or touch make one press. Reaction: from
    the possession's start. Forced: the other team's possession is next and
    starts within the horizon after the press.
    """
    key = ["match_id", "period", "possession_id"]
    w = Window.partitionBy(*key).orderBy("f_start", "f_end", "player_id")
    new = F.col("f_start") > F.coalesce(F.max("f_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    g = pressers.withColumn("new", new.cast("int")).withColumn("n", F.sum("new").over(w)).groupBy(*key, "n").agg(F.first("fps").alias("fps"), F.min("f_start").alias("f_start"), F.max("f_end").alias("f_end"), F.count_distinct("player_id").alias("n_pressers"))
    order = Window.partitionBy("match_id", "period").orderBy("f_start")
    next_one = possessions.select(*key, "team", F.col("f_start").alias("p_start"), F.lead("team").over(order).alias("next_team"), F.lead("f_start").over(order).alias("next_start"))
    ms = lambda c: f"({c} * 1000 div fps)"
    df = g.join(next_one, key)
    forced = F.coalesce((F.col("next_team") != F.col("team")) & F.expr(f"{ms('next_start')} - {ms('f_end')} <= {p.horizon_ms}"), F.lit(False))
    return df.select(F.concat_ws("-", "match_id", "period", "f_start").alias("press_id"), *key, "f_start", "f_end", F.expr(f"{ms('f_start')} - {ms('p_start')}").alias("reaction_ms"), "n_pressers", forced.alias("forced_turnover"))
