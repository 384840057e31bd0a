"""The whole way from a tracking table to scored runs, as one lazy plan.

Each step is a property; a query takes what it needs and Catalyst plans it as a
whole. Between jobs, persist_steps() writes the steps that several jobs share.
"""

from __future__ import annotations

from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.operators import kinematics, possession, press, runs, search, value, windows
from pitchlake.params import DEFAULT, Params
from pitchlake.storage import stored


class TrackingPlan:
    """Steps over the canonical tables: tracking, matches, roster, direction, shots."""

    SHARED = ("kin", "frames", "framed", "runs")
    #: Velocities cost more to store than to find again.
    STORED = ("frames", "framed", "runs", "end_frames", "geometry", "marks")

    def __init__(self, tables: Any, params: Params = DEFAULT, store: bool | tuple[str, ...] = False) -> None:
        """store: write the shared steps when they are first needed, as several later ones read them; names of steps: these only."""
        self.t, self.p = tables, params
        self.store = self.STORED if store is True else tuple(store or ())

    def _shared(self, name: str, df: DataFrame) -> DataFrame:
        """df, stored if it is to be. Tables whose matches are dealt to partitions are stored as dealt."""
        return stored(df, by="match_id", parts=getattr(self.t, "parts", None)) if name in self.store else df

    @cached_property
    def kin(self) -> DataFrame:
        return kinematics.kinematics(self.t.tracking)

    @cached_property
    def frames(self) -> DataFrame:
        return self._shared("frames", kinematics.with_ball_speed(possession.frames(self.t.tracking, self.t.roster)))

    @cached_property
    def players(self) -> DataFrame:
        return possession.players(self.t.tracking, self.t.roster)

    @cached_property
    def balls(self) -> DataFrame:
        return kinematics.balls(self.t.tracking)

    @cached_property
    def carrier(self) -> DataFrame:
        return possession.nearest(self.players, self.balls, self.p)

    @cached_property
    def smoothed(self) -> DataFrame:
        return possession.smooth_team(self.carrier, self.p)

    @cached_property
    def framed(self) -> DataFrame:
        return self._shared("framed", possession.possession_frames(self.smoothed, self.p))

    @cached_property
    def possessions(self) -> DataFrame:
        return possession.possessions(self.framed)

    @cached_property
    def runs(self) -> DataFrame:
        return self._shared("runs", runs.detect_runs(self.kin, self.t.roster, self.framed, self.p))

    @cached_property
    def geometry(self) -> DataFrame:
        return self._shared("geometry", runs.run_geometry(self.runs, self.end_frames, self.t.direction, self.p))

    @cached_property
    def end_frames(self) -> DataFrame:
        """frames of the starts and ends of runs alone."""
        asked = self.runs.select("match_id", "period", F.explode(F.array("f_start", "f_end")).alias("frame"))
        return self._shared("end_frames", possession.frames_at(self.t.tracking, self.t.roster, asked))

    @cached_property
    def labelled(self) -> DataFrame:
        return runs.label_shots(self.geometry, self.t.shots, self.t.matches, self.p)

    @cached_property
    def marks(self) -> DataFrame:
        return self._shared("marks", windows.marks(self.players, self.balls, self.p))

    @cached_property
    def lines(self) -> DataFrame:
        return windows.lines(self.marks, self.t.direction, self.p)

    @cached_property
    def windows(self) -> DataFrame:
        return windows.windows(self.possessions, self.p)

    @cached_property
    def features(self) -> DataFrame:
        return windows.frame_features(self.players, self.lines, self.framed, self.p)

    @cached_property
    def node_rows(self) -> DataFrame:
        return windows.node_rows(self.framed, self.t.direction, self.kin, self.p)

    @cached_property
    def nodes(self) -> DataFrame:
        return windows.node_matrix(self.framed, self.t.direction, self.kin, self.p)

    @cached_property
    def v1_sequences(self) -> DataFrame:
        """What V1 sees of each window: its pooled features, frame by frame."""
        return windows.window_sequences(self.windows, self.features)

    @cached_property
    def v2_sequences(self) -> DataFrame:
        """What V2 sees of each window: its entities, frame by frame."""
        return windows.node_sequences(self.windows, self.nodes)

    @cached_property
    def window_values(self) -> DataFrame:
        return value.window_values(windows.window_features(self.windows, self.features, self.p))

    @cached_property
    def window_labels(self) -> DataFrame:
        return windows.window_labels(self.windows, self.lines, self.t.shots, self.t.matches, self.p)

    @cached_property
    def gained(self) -> DataFrame:
        return value.value_gained(self.runs, self.window_values)

    @cached_property
    def drift(self) -> DataFrame:
        return value.drift_velocity(self.runs, value.motion_before(self.t.tracking, self.runs, self.p), self.t.direction, self.p)

    @cached_property
    def counterfactual(self) -> DataFrame:
        return value.counterfactuals(self.geometry, self.t.tracking, self.t.direction, self.drift, self.p, self.t.roster, self.marks)

    @cached_property
    def scores(self) -> DataFrame:
        """Runs left-joined to what models said of them; unscored runs stay."""
        return self.runs.join(self.gained, ["match_id", "run_id"], "left").join(self.counterfactual, ["match_id", "run_id"], "left")

    @cached_property
    def searchable(self) -> DataFrame:
        return search.overlaps(search.defender_role(self.labelled, self.t.roster), self.end_frames, self.framed, self.t.direction, self.p)

    @cached_property
    def pressers(self) -> DataFrame:
        return press.pressers(self.players, self.framed, self.p)

    @cached_property
    def presses(self) -> DataFrame:
        return press.presses(self.pressers, self.possessions, self.p)

    def report(self, key: str = "cf_gain_v2_frozen", k: int = 10) -> DataFrame:
        cols = ["run_id", "match_id", "player_id", "team", "duration_ms", "distance", key]
        return search.ranked_report(self.scores, key, k).select(*[F.col(c) for c in cols])

    def persist_steps(self, path: str) -> TrackingPlan:
        """Write the steps that later jobs share, by match, and go on from those tables."""
        for name in self.SHARED:
            df: DataFrame = getattr(self, name)
            df.write.mode("overwrite").partitionBy("match_id").parquet(f"{path}/{name}")
            self.__dict__[name] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
        return self
