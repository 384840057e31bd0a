"""A deterministic tracking table derived from an event log, for tests and benchmarks.

Positions are whole millimetres until the last step, so any engine gets the
same numbers. 943 events make a match of 23 entities with 41 waypoints each,
three seconds apart; entities 0 and 11 keep goal, 0-10 are home, 11-21 away and
22 is the ball, which goes with a player for three waypoints at a time. A match
in four is at 25 frames a second and has shots.

The event log is dealt by match before it grows: all rows of a match are in one of `parts`
partitions, so that joins, groups and windows within matches need no further shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.sources.schema import MATCHES, ROSTER, SHOTS, TRACKING, conform

EACH, ENTITIES = 943, 23
BIG = 10**12
#: Matches of a partition, about: a million rows of tracking.
MATCHES_A_PART = 24


def _waypoints(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("long").alias("v"), F.col("user_id").alias("u"), "event_type")
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.expr(f"max(event_id) div {EACH}").alias("last"))
    e = e.select("*", F.expr(f"id div {EACH}").alias("m"), F.expr(f"cast(id % {ENTITIES} as int)").alias("j"), F.expr(f"cast((id % {EACH}) div {ENTITIES} as int)").alias("k"))
    e = e.join(F.broadcast(last), F.col("m") < F.col("last")).drop("last")  # one row; the last match is not whole
    e = e.repartition(parts, "m")
    anchor = F.expr("case when j <= 10 then 22000 + ((j - 1) % 5) * 12000 else 83000 - ((j - 12) % 5) * 12000 end")
    x = F.expr("(31 * v + 17 * u + 13 * id) % 24001 - 12000")
    y = F.expr("34000 + ((7 * j) % 11 - 5) * 5000 + (29 * v + 11 * u + 19 * id) % 16001 - 8000")
    return e.select(
        "m", "j", "k", "v", "event_type",
        F.when(F.col("j") == 0, 6000).when(F.col("j") == 11, 99000).otherwise(anchor + x).cast("long").alias("x0"),
        F.when(F.col("j").isin(0, 11), 34000).otherwise(y).cast("long").alias("y0"),
        F.when(F.col("m") % 4 == 3, 25).otherwise(10).cast("int").alias("fps"),
    )


@dataclass
class Fixture:
    """The canonical tables of one data folder."""

    spark: SparkSession
    sf_dir: str
    #: Further partitions, which deal matches out in another way.
    more_parts: int = 0

    @cached_property
    def parts(self) -> int:
        """How many partitions matches are dealt to: as many as their number asks for, by the file's row count."""
        n = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").count() // EACH
        return max(1, ceil(n / MATCHES_A_PART), min(n, 2 * self.spark.sparkContext.defaultParallelism)) + self.more_parts

    @cached_property
    def _waypoints(self) -> DataFrame:
        return _waypoints(self.spark, self.sf_dir, self.parts)

    @cached_property
    def _carriers(self) -> DataFrame:
        ball = self._waypoints.filter("j = 22")
        c = ball.groupBy("m", F.expr("k div 3").alias("block")).agg((F.min("v") % 20).alias("c"))
        return c.select("m", "block", F.expr("case when c < 10 then c + 1 else c + 2 end").cast("int").alias("j"))

    @cached_property
    def tracking(self) -> DataFrame:
        w = Window.partitionBy("m", "j").orderBy("k")
        p = self._waypoints.filter("j < 22")
        p = p.select("m", "j", "k", "fps", "x0", "y0", F.lead("x0").over(w).alias("x1"), F.lead("y0").over(w).alias("y1")).filter("k < 40")
        carriers = self._carriers.select("m", "block", F.col("j").alias("carrier")).hint("shuffle_hash")
        p = p.withColumn("block", F.expr("k div 3")).join(carriers, ["m", "block"], "left")
        # the ball goes with its carrier's waypoints, half a metre ahead
        own, ball = F.struct("j", F.lit(0).alias("bx"), F.lit(0).alias("by")), F.struct(F.lit(22).alias("j"), F.lit(500).alias("bx"), F.lit(300).alias("by"))
        p = p.withColumn("of", F.explode(F.when(F.col("j") == F.col("carrier"), F.array(own, ball)).otherwise(F.array(own)))).select("m", "of.*", "k", "fps", "x0", "y0", "x1", "y1")
        p = p.withColumn("n", F.col("fps") * 3).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        at = lambda c: f"({c}0 * n + ({c}1 - {c}0) * i + {BIG}) div n - {BIG} div n + b{c}"
        both = p.select("m", "j", "fps", F.expr("cast(k * n + i as long)").alias("frame"), F.expr(at("x")).alias("mx"), F.expr(at("y")).alias("my"))
        team = F.when(F.col("j") == 22, "ball").when(F.col("j") <= 10, "home").otherwise("away")
        return conform(both.select(F.col("m").alias("match_id"), F.lit(1).alias("period"), "frame", "fps", F.expr("frame * 1000 div fps").alias("t_ms"), F.col("j").alias("player_id"), team.alias("team"), (F.col("mx") / 1000.0).alias("x"), (F.col("my") / 1000.0).alias("y")), TRACKING)

    @cached_property
    def matches(self) -> DataFrame:
        m = self._waypoints.select("m", "fps").distinct()
        return conform(m.select(F.col("m").alias("match_id"), F.when(F.col("fps") == 25, "optical").otherwise("broadcast").alias("source"), "fps", (F.col("fps") == 25).alias("has_shots"), F.lit(105.0).alias("pitch_length"), F.lit(68.0).alias("pitch_width")), MATCHES)

    @cached_property
    def roster(self) -> DataFrame:
        j = F.explode(F.sequence(F.lit(0), F.lit(21)))
        r = self.matches.select("match_id", j.alias("player_id"))
        role = F.expr("case when player_id in (0, 11) then 'GK' when (case when player_id <= 10 then (player_id - 1) % 5 else (player_id - 12) % 5 end) = 0 then 'CB' when (case when player_id <= 10 then (player_id - 1) % 5 else (player_id - 12) % 5 end) <= 2 then 'MF' else 'FW' end")
        return conform(r.select("match_id", "player_id", F.when(F.col("player_id") <= 10, "home").otherwise("away").alias("team"), role.alias("role"), F.col("player_id").isin(0, 11).alias("is_gk")), ROSTER)

    @cached_property
    def direction(self) -> DataFrame:
        """Home attacks towards +x in odd periods."""
        return self.matches.select("match_id", F.lit(1).cast("int").alias("period"), F.explode(F.array(F.struct(F.lit("home").alias("team"), F.lit(1).alias("attack_sign")), F.struct(F.lit("away").alias("team"), F.lit(-1).alias("attack_sign")))).alias("d")).select("match_id", "period", "d.*")

    @cached_property
    def shots(self) -> DataFrame:
        s = self._waypoints.filter("j = 22 and event_type = 'error' and m % 4 = 3 and k < 40").withColumn("block", F.expr("k div 3"))
        s = s.select("m", "block", "k", "fps").join(self._carriers, ["m", "block"])
        return conform(s.select(F.col("m").alias("match_id"), F.lit(1).alias("period"), (F.col("k") * 3 * F.col("fps")).alias("frame"), F.when(F.col("j") <= 10, "home").otherwise("away").alias("team")), SHOTS)


def from_events(spark: SparkSession, sf_dir: str, more_parts: int = 0) -> Fixture:
    return Fixture(spark, sf_dir, more_parts)
