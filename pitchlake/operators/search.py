"""Tactical search over runs, ranked reports, and what is shown of a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions.ordering import ranked
from pitchlake.operators.runs import normalised
from pitchlake.params import DEFAULT, FRAME, Params


@dataclass(frozen=True)
class Criteria:
    """What a run must show; None leaves a point open. All points become one predicate over run columns."""

    dragged_role: str | None = None
    min_drag: float = DEFAULT.drag_distance
    before_shot: bool = False
    overlap: bool = False
    min_space_after: float | None = None
    behind_line: bool | None = None
    min_distance: float | None = None

    def predicate(self) -> Column:
        ok = F.lit(True)
        if self.dragged_role is not None:
            ok &= (F.col("def_role") == self.dragged_role) & (F.col("def_displacement") >= self.min_drag)
        if self.before_shot:
            ok &= F.col("shot_5s")
        if self.overlap:
            ok &= F.col("overlap")
        if self.min_space_after is not None:
            ok &= F.col("space_after") >= self.min_space_after
        if self.behind_line is not None:
            ok &= F.col("behind_line") == self.behind_line
        if self.min_distance is not None:
            ok &= F.col("distance") >= self.min_distance
        return ok


DRAGGED_CENTRE_BACK = Criteria(dragged_role="CB")
BEFORE_SHOT = Criteria(before_shot=True)
OVERLAP_FREE_MAN = Criteria(overlap=True, min_space_after=DEFAULT.free_space)


def defender_role(runs: DataFrame, roster: DataFrame) -> DataFrame:
    """runs with def_role, the nearest defender's."""
    return runs.join(roster.select("match_id", F.col("player_id").alias("nearest_def"), F.col("role").alias("def_role")), ["match_id", "nearest_def"], "left")


def overlaps(runs: DataFrame, frames: DataFrame, framed: DataFrame, direction: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """runs with overlap: behind the carrier at the start, ahead and wider at the end; false if there is no carrier then."""
    held = framed.select(*FRAME, F.col("player_id").alias("carrier_id"))
    at = runs.select("run_id", "match_id", "period", "team", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.col("f_start").alias("frame")), F.struct(F.lit(1).alias("at"), F.col("f_end").alias("frame")))).alias("e")).select("*", "e.*").drop("e")
    at = held.join(at.hint("shuffle_hash"), list(FRAME))
    c = frames.select(*FRAME, "players").join(at.hint("shuffle_hash"), list(FRAME)).join(direction.hint("shuffle_hash"), ["match_id", "period", "team"])
    c = c.withColumn("c", F.get(F.filter(normalised(F.col("players"), F.col("attack_sign"), p), lambda q: q["player_id"] == F.col("carrier_id")), 0))
    pick = lambda i, f: F.max(F.when(F.col("at") == i, F.col("c")[f]))
    c = c.groupBy("match_id", "run_id").agg(pick(0, "x").alias("cx0"), pick(1, "x").alias("cx1"), pick(1, "y").alias("cy1"))
    mid = p.pitch_width / 2
    yes = (F.col("x_start") < F.col("cx0")) & (F.col("x_end") > F.col("cx1")) & (F.abs(F.col("y_end") - mid) > F.abs(F.col("cy1") - mid))
    return runs.join(c, ["match_id", "run_id"], "left").withColumn("overlap", F.coalesce(yes, F.lit(False))).drop("cx0", "cx1", "cy1")


def explain() -> Column:
    """A run in words."""
    m = lambda c: F.round(c, 1).cast("string")
    return F.concat(
        F.lit("player "), "player_id", F.lit(" ran "), m("distance"), F.lit(" m in "), m(F.col("duration_ms") / 1000.0), F.lit(" s; defender "), "nearest_def",
        F.lit(" moved "), m("def_displacement"), F.lit(" m; space "), m("space_before"), F.lit(" to "), m("space_after"), F.lit(" m"),
    )


def search(runs: DataFrame, criteria: Criteria, scores: DataFrame | None = None, key: str = "distance", limit: int | None = None) -> DataFrame:
    """Runs that meet the criteria, with scores and an explanation, best first."""
    hits = runs.filter(criteria.predicate())
    if scores is not None:
        hits = hits.join(scores, "run_id", "left")
    hits = hits.withColumn("explanation", explain()).orderBy(F.col(key).desc_nulls_last(), "run_id")
    return hits if limit is None else hits.limit(limit)


def ranked_report(runs: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k best runs by key, ties by run_id: a top-k, without a full sort."""
    return runs.filter(F.col(key).isNotNull()).orderBy(F.col(key).desc(), "run_id").limit(k)


def best_per(runs: DataFrame, by: list[str], key: str, k: int = 1) -> DataFrame:
    """The k best runs of each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.col(key).desc(), "run_id")
    return runs.filter(F.col(key).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rank_all(runs: DataFrame, key: str) -> DataFrame:
    """Every run that has the key, with its rank over the whole table, ties by run_id; no task orders them all."""
    return ranked(runs.filter(F.col(key).isNotNull()), [F.desc(key), F.asc("run_id")])


def slice_digests(slices: DataFrame) -> DataFrame:
    """(run_id, part, n_rows, sum_x, sum_y, digest) of run_slice(): digest is of the part's rows in order, places in millimetres."""
    mm = lambda c: F.round(F.col(c) * 1000).cast("long").alias(c)
    row = F.array_sort(F.collect_list(F.struct("frame", "player_id", mm("x"), mm("y"))))  # as long as the run
    g = slices.groupBy("run_id", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("x"), 6).alias("sum_x"), F.round(F.sum("y"), 6).alias("sum_y"), row.alias("rows"))
    text = F.concat_ws(",", F.transform("rows", lambda r: F.concat_ws(":", r["frame"], r["player_id"], r["x"], r["y"])))
    return g.select("run_id", "part", "n_rows", "sum_x", "sum_y", F.md5(text).alias("digest"))


def run_slice(runs: DataFrame, tracking: DataFrame) -> DataFrame:
    """Every entity's place in every frame of the runs: what an animation of them shows."""
    r = runs.select("run_id", "match_id", "period", F.col("player_id").alias("runner_id"), "nearest_def", F.explode(F.sequence("f_start", "f_end")).alias("frame"))
    df = tracking.join(r.hint("shuffle_hash"), list(FRAME))
    part = F.when(F.col("player_id") == F.col("runner_id"), "runner").when(F.col("player_id") == F.col("nearest_def"), "defender").when(F.col("team") == "ball", "ball").otherwise("other")
    return df.select("run_id", *FRAME, "player_id", "team", part.alias("part"), "x", "y")
