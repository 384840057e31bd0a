"""Value of a state, what a run gained, and what it would have been without the run.

The two values are fixed logistic functions that stand in for trained models:
V1 sees pooled features, V2 single players. Their numbers mean danger only as
far as the weights do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions.geometry import goal_distance, in_box, ms_to_frames, sigmoid
from pitchlake.operators.kinematics import balls, kinematics
from pitchlake.operators.possession import players
from pitchlake.operators.windows import ENTITY_FEATURES, FEATURES, features_of, lines, marks, of_players, trailing_means
from pitchlake.params import DEFAULT, FRAME, Params

V1 = {"": -2.0, "ball_x": 0.02, "ball_speed": 0.005, "goal_dist": -0.05, "att_x": 0.02, "def_x": -0.01, "compactness": 0.02, "pressure": -0.2, "att_in_box": 0.3}
V2 = {"": -2.0, "deepest_x": 0.03, "nearest_goal": -0.04, "beyond": 0.4, "goal_dist": -0.02}


def logistic(weights: dict[str, float], column: Callable[[str], str] = str) -> Column:
    """Of the features by name; column gives the column that has a feature."""
    z = F.lit(weights[""])
    for name, w in weights.items():
        if name:
            z = z + w * F.coalesce(F.col(column(name)), F.lit(0.0))
    return sigmoid(z)


def window_values(features: DataFrame) -> DataFrame:
    """window_features() with v1 and v2."""
    return features.withColumns({"v1": logistic(V1), "v2": logistic(V2)})


def value_gained(runs: DataFrame, values: DataFrame, score: str = "v1") -> DataFrame:
    """(match_id, run_id, v_before, v_after, value_gained): the latest windows of the possession that end by the run's start and by its end; null without one.

    One pass in time order over the possession's windows and its runs' ends: each takes the last window before it.
    """
    key = ["match_id", "period", "possession_id"]
    v = values.select(*key, F.col("w_end").alias("frame"), F.struct(F.col(score).alias("v")).alias("value"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("run_id"))
    ends = runs.select("run_id", *key, F.posexplode(F.array("f_start", "f_end")).alias("end", "frame"))
    ends = ends.select(*key, "frame", F.lit(None).cast(v.schema["value"].dataType).alias("value"), (F.col("end") + 1).alias("place"), "run_id")
    before = Window.partitionBy(*key).orderBy("frame", F.col("place") > 0).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = v.unionByName(ends).withColumn("value", F.last("value", ignorenulls=True).over(before)).filter("place > 0")
    got = seen.groupBy("match_id", "run_id").agg(*[F.max(F.when(F.col("place") == i, F.col("value.v"))).alias(name) for i, name in ((1, "v_before"), (2, "v_after"))])
    return runs.select("match_id", "run_id").join(got, ["match_id", "run_id"], "left").withColumn("value_gained", F.col("v_after") - F.col("v_before"))


def motion_before(tracking: DataFrame, runs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """kinematics() of the runners' rows that drift_velocity() asks for, found from these and the one before them alone."""
    first = F.greatest(F.col("f_start") - ms_to_frames(p.drift_ms, F.col("fps")), F.lit(0)) - 1
    asked = runs.select("match_id", "period", "player_id", F.explode(F.sequence(first, F.col("f_start"))).alias("frame")).distinct()
    return kinematics(tracking.join(asked.hint("shuffle_hash"), [*FRAME, "player_id"], "left_semi"))


def drift_velocity(runs: DataFrame, kin: DataFrame, direction: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, run_id, drift_x, drift_y): the runner's mean velocity shortly before the start, normalised; 0 if unknown."""
    r = runs.select("run_id", "match_id", "period", "player_id", "team", F.explode(F.sequence(F.greatest(F.col("f_start") - ms_to_frames(p.drift_ms, F.col("fps")), F.lit(0)), F.col("f_start"))).alias("frame"))
    asked = [*FRAME, "player_id"]
    near = kin.select(*asked, "vx", "vy").join(r.select(*asked).distinct().hint("shuffle_hash"), asked, "left_semi")  # the few rows that runs ask for
    v = r.join(near, asked, "left").join(direction.hint("shuffle_hash"), ["match_id", "period", "team"])
    return v.groupBy("match_id", "run_id").agg(F.coalesce(F.avg(F.col("vx") * F.col("attack_sign")), F.lit(0.0)).alias("drift_x"), F.coalesce(F.avg(F.col("vy") * F.col("attack_sign")), F.lit(0.0)).alias("drift_y"))


#: What a run's window is scored as.
VARIANTS = ("actual", "frozen", "drift")


def variant_frames(runs: DataFrame, frames: DataFrame, direction: DataFrame, drift: DataFrame, p: Params = DEFAULT, roster: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """The frames of the window that ends with each run: features of all but the runner, and those that the runner is part of by variant (`att_x_frozen`).

    runs has x_start and y_start (run_geometry()). Frozen: the runner stays at the
    start; drift: goes on with the velocity before, within the pitch. What the others add up to is worked out once a frame, and each
    variant adds its runner to it. `wide` is how many frames the window has. frames: of possession.frames(), or the tracking table with its roster;
    found: marks() of it, if at hand. Frames without a ball are left out, so their windows are not whole.
    """
    everyone = players(frames, roster)
    ahead = lines(marks(everyone, balls(frames), p) if found is None else found, direction, p)
    wide = ms_to_frames(p.window_ms, F.col("fps"))
    r = runs.select("run_id", "match_id", "period", F.col("player_id").alias("runner"), "team", F.col("fps").alias("rate"), "f_start", "x_start", "y_start", wide.alias("wide"), F.explode(F.sequence(F.col("f_end") - wide + 1, F.col("f_end"))).alias("frame"))
    heads = ahead.drop("past_line").join(r.select("run_id", *FRAME, "team", "runner").hint("shuffle_hash"), [*FRAME, "team"])
    mine = (F.col("player_id") == F.col("runner")) & (F.col("q_team") == F.col("team"))
    rows = of_players(everyone, heads, p)
    x, y, own_half = F.when(mine & ~F.col("is_gk"), F.col("x")), F.when(mine & ~F.col("is_gk"), F.col("y")), ~mine & (F.col("q_team") == F.col("team")) & ~F.col("is_gk")
    # a runner is in no team while the others are added up
    others = rows.withColumns({"me_x": x, "me_y": y, "is_gk": F.col("is_gk") | mine})
    df = features_of(others, ["run_id", *FRAME], {"_x": F.max("me_x"), "_y": F.max("me_y"), "_n": F.count_if(own_half), "_line": F.max("last_x")}, p)
    df = df.join(r.drop("period").withColumnRenamed("runner", "player_id").hint("shuffle_hash"), ["match_id", "run_id", "frame"]).join(drift.hint("shuffle_hash"), ["match_id", "run_id"])
    after = (F.col("frame") - F.col("f_start")) / F.col("rate")
    clamp = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), F.lit(most))
    edits = {
        "actual": (F.col("_x"), F.col("_y")),
        "frozen": (F.col("x_start"), F.col("y_start")),
        "drift": (clamp(F.col("x_start") + F.col("drift_x") * after, p.pitch_length), clamp(F.col("y_start") + F.col("drift_y") * after, p.pitch_width)),
    }
    there, n = F.col("_x").isNotNull(), F.col("_n")
    own: dict[str, dict[str, Column]] = {}
    for name in VARIANTS:
        x, y = (F.when(F.col("frame") >= F.col("f_start"), c).otherwise(F.col(f"_{axis}")) for axis, c in zip("xy", edits[name], strict=True))
        whole = lambda total, me: F.when(there, (F.coalesce(total * n, F.lit(0.0)) + me) / (n + 1)).otherwise(total)
        own[name] = {
            "att_x": whole(F.col("att_x"), x),
            "att_y": whole(F.col("att_y"), y),
            "att_in_box": F.col("att_in_box") + F.when(there & in_box(x, y, p), 1.0).otherwise(0.0),
            "deepest_x": F.greatest("deepest_x", F.when(there, x)),
            "beyond": F.col("beyond") + F.when(there & (x > F.col("_line")), 1.0).otherwise(0.0),
            "nearest_goal": F.least("nearest_goal", F.when(there, goal_distance(x, y, p))),
            "runner_x": x,
            "runner_y": y,
        }
    common = [c for c in (*FEATURES, *ENTITY_FEATURES) if c not in own["actual"]]
    return df.select("run_id", *FRAME, "wide", "player_id", "f_start", "drift_x", "drift_y", *common, *[c.alias(f"{c_name}_{name}") for name, cs in own.items() for c_name, c in cs.items()])


def counterfactuals(runs: DataFrame, frames: DataFrame, direction: DataFrame, drift: DataFrame, p: Params = DEFAULT, roster: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(match_id, run_id, v1_actual, v1_frozen, v1_drift, v2_..., cf_gain_v1_frozen, ...): value of the window that ends with the run, as it was and with the runner edited.

    Null where the window is not whole.
    """
    cells = variant_frames(runs, frames, direction, drift, p, roster, found)
    column = lambda c, name: f"{c}_{name}" if f"{c}_{name}" in cells.columns else c
    used = sorted({column(c, name) for name in VARIANTS for c in (*V1, *V2) if c})
    state = cells.groupBy("match_id", "run_id").agg(F.first("wide").alias("wide"), F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in used])
    values = {f"{v}_{name}": F.when(F.col("n") == F.col("wide"), logistic(weights, lambda c, name=name: column(c, name))) for v, weights in (("v1", V1), ("v2", V2)) for name in VARIANTS}
    wide_row = state.select("match_id", "run_id", *[c.alias(name) for name, c in values.items()])
    return runs.select("match_id", "run_id").join(wide_row.select("*", *gains()), ["match_id", "run_id"], "left")


def gains() -> list[Column]:
    """V(actual) - V(variant) of each model, as cf_gain_<model>_<variant>."""
    return [(F.col(f"{v}_actual") - F.col(f"{v}_{name}")).alias(f"cf_gain_{v}_{name}") for v in ("v1", "v2") for name in VARIANTS[1:]]


def probability_trace(runs: DataFrame, features: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(run_id, frame, v1): the value along each run, of the window that ends at each of its frames; whole windows inside the possession only."""
    r = runs.select("run_id", "match_id", "period", "possession_id", F.explode(F.sequence("f_start", "f_end")).alias("frame"))
    return trailing_means(features, p).join(r.hint("shuffle_hash"), [*FRAME, "possession_id"]).select("run_id", "frame", logistic(V1).alias("v1"))
