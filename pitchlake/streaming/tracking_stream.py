"""Tracking as a stream: windows by event time, and motion with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitchlake.params import ENTITY
from pitchlake.sources.schema import TRACKING


def read_stream(spark: SparkSession, path: str, max_files: int = 10) -> DataFrame:
    """New Parquet files of the canonical table as they arrive."""
    return spark.readStream.schema(TRACKING).option("maxFilesPerTrigger", max_files).parquet(path)


def with_event_time(tracking: DataFrame) -> DataFrame:
    """tracking with ts: t_ms after the epoch."""
    return tracking.withColumn("ts", F.timestamp_millis("t_ms"))


def hopping_windows(tracking: DataFrame, size: str = "3 seconds", stride: str = "1 second", late: str = "2 seconds") -> DataFrame:
    """(match_id, period, w_start_ms, team, n, mean_x, mean_y) of each window, once the watermark has passed it.

    Windows are aligned to the clock, not to possessions, and those at the ends
    of a match are partial.
    """
    t = with_event_time(tracking).withWatermark("ts", late)
    g = t.groupBy("match_id", "period", F.window("ts", size, stride), "team").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    return g.select("match_id", "period", F.unix_millis(F.col("window.start")).alias("w_start_ms"), "team", "n", "mean_x", "mean_y")


MOTION = "match_id long, period int, player_id long, frame long, vx double, vy double, speed double"


def stream_kinematics(tracking: DataFrame, idle_ms: int | None = 600_000) -> DataFrame:
    """Velocity and speed against the frame before, which is kept as state by entity; null after a gap.

    Frames come in order, as recorders write them; a frame that arrives after a
    later one of its entity was processed gets no motion and leaves the state.
    State is three numbers an entity, dropped after idle_ms without rows. None keeps
    it, as an availableNow run must: Spark goes on with empty batches for as long
    as a processing-time timeout is asked for, so such a run would never end.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("frame", kind="stable")
        last = state.get if state.exists else (None, 0.0, 0.0)
        frame = rows["frame"].to_numpy()
        late = frame <= last[0] if last[0] is not None else np.zeros(len(rows), dtype=bool)
        ok = rows[~late]
        f = np.concatenate(([np.nan if last[0] is None else last[0]], ok["frame"].to_numpy(float)))
        x, y = np.concatenate(([last[1]], ok["x"])), np.concatenate(([last[2]], ok["y"]))
        step = np.diff(f) == 1
        fps = ok["fps"].to_numpy(float)
        dx, dy = np.where(step, np.diff(x), np.nan), np.where(step, np.diff(y), np.nan)
        out = pd.DataFrame({"frame": ok["frame"], "vx": dx * fps, "vy": dy * fps, "speed": np.sqrt(dx * dx + dy * dy) * fps})
        out = pd.concat([out, pd.DataFrame({"frame": rows["frame"][late]})]).assign(match_id=key[0], period=key[1], player_id=key[2])
        if len(ok):
            state.update((int(f[-1]), float(x[-1]), float(y[-1])))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out[["match_id", "period", "player_id", "frame", "vx", "vy", "speed"]]

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return tracking.select(*ENTITY, "frame", "fps", "x", "y").groupBy(*ENTITY).applyInPandasWithState(run, MOTION, "frame long, x double, y double", "append", timeout)
