"""Possessions and runs on a stream, as soon as they are over.

One stateful operator for each match and period. Rows wait in its state until the
watermark has passed their frame, so that rows may come late and in any order within the
watermark; then frames go by in order, and what is open stays in the state: the last
second of ball carriers (a vote needs half a second before and after), each entity's last
place, the open possession with its runs. A timer behind the last row works off what
waits, a second one at the end of the period closes what is open. The rows are
those of possession.possessions() and runs.detect_runs(), whatever batches the input comes in.

State grows with the watermark's delay and the longest possession, not with the match. Rows of a
frame and entity are taken to be unique; rows later than the watermark are dropped by Spark. A stream
needs the RocksDB state store (state_store()).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pitchlake.params import DEFAULT, Params

INTERVALS = "kind string, match_id long, period int, possession_id long, player_id long, team string, fps int, f_start long, f_end long, n_frames long, duration_ms long, distance double"
COLUMNS = [c.split()[0] for c in INTERVALS.split(", ")]
ROW = ["frame", "t_ms", "fps", "player_id", "team", "is_gk", "x", "y"]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Use the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Period:
    """One period's open intervals; everything in it is JSON."""

    def __init__(self, p: Params, saved: str | None = None) -> None:
        self.p = p
        self.s: dict[str, Any] = json.loads(saved) if saved else {
            "waiting": [],  # rows of frames that the watermark has not passed
            "last": {},  # entity: frame, x, y
            "votes": [],  # carriers whose vote is open or counts in one: frame, t_ms, fps, player, team, [[runner, team, step], ...], voted
            "count": 0,  # possessions so far, short ones too
            "open": None,  # id, team, fps, f_start, f_end, n, runs {player: [f_start, f_end, distance]}, done [[player, f_start, f_end, distance], ...]
        }

    def saved(self) -> str:
        return json.dumps(self.s)

    @property
    def waits_until(self) -> int | None:
        """The latest time of a row that waits."""
        return max((r[1] for r in self.s["waiting"]), default=None)

    def feed(self, rows: list[list], until: int) -> list[tuple]:
        """Take rows (ROW) and go on to the time until, before which no further rows come; what ended on the way."""
        waiting = self.s["waiting"] + rows
        self.s["waiting"] = [r for r in waiting if r[1] >= until]
        ready = sorted(r for r in waiting if r[1] < until)
        out: list[tuple] = []
        start = 0
        for i in range(1, len(ready) + 1):
            if i == len(ready) or ready[i][0] != ready[start][0]:
                self.frame(ready[start:i])
                out += self.vote(ready[start][1] - self.p.vote_ms // 2)
                start = i
        return out + self.vote(until - self.p.vote_ms // 2)

    def frame(self, rows: list[list]) -> None:
        """The next frame's carrier, and who runs."""
        frame, t_ms, fps = rows[0][:3]
        ball, near, fast = next((r for r in rows if r[4] == "ball"), None), None, []
        for _, _, _, player, team, keeper, x, y in rows:
            if team == "ball":
                continue
            before = self.s["last"].get(str(player))
            if before and before[0] == frame - 1:
                step = float(np.sqrt((x - before[1]) * (x - before[1]) + (y - before[2]) * (y - before[2])))
                if step * fps > self.p.run_speed and not keeper:
                    fast.append([player, team, step])
            self.s["last"][str(player)] = [frame, x, y]
            if ball and not keeper:
                d = float(np.sqrt((x - ball[6]) * (x - ball[6]) + (y - ball[7]) * (y - ball[7])))
                near = min(near or (d, player, team), (d, player, team))
        if near and near[0] <= self.p.carrier_radius:
            self.s["votes"].append([frame, t_ms, fps, near[1], near[2], fast, False])

    def vote(self, before: int) -> list[tuple]:
        """Settle the team of carriers up to that time, whose votes are all in."""
        votes, half, out = self.s["votes"], self.p.vote_ms // 2, []
        for i, v in enumerate(votes):
            if v[1] >= before:
                break
            if not v[6]:
                v[6] = True
                total = sum(1 if o[4] == "home" else -1 for o in votes if abs(o[1] - v[1]) <= half)
                out += self.held(v, "home" if total > 0 else "away" if total < 0 else v[4])
        # a vote that still counts is at most half a second before one that is open
        first_open = next((v[1] for v in votes if not v[6]), before)
        self.s["votes"] = [v for v in votes if v[1] >= min(first_open, before) - half]
        return out

    def held(self, v: list, team: str) -> list[tuple]:
        """A frame in a team's hold: goes on with the open possession, or ends it and begins another."""
        frame, _, fps, carrier, _, fast, _ = v
        now, out = self.s["open"], []
        if not now or now["team"] != team or frame != now["f_end"] + 1:
            out = self.close()
            self.s["count"] += 1
            now = self.s["open"] = {"id": self.s["count"], "team": team, "fps": fps, "f_start": frame, "f_end": frame, "n": 0, "runs": {}, "done": []}
        now["f_end"], now["n"] = frame, now["n"] + 1
        for player, own, step in fast:
            if own == team and player != carrier:
                run = now["runs"].get(str(player))
                if run and run[1] == frame - 1:
                    run[1], run[2] = frame, run[2] + step
                else:
                    self.ended(player)
                    now["runs"][str(player)] = [frame, frame, step]
        return out

    def ended(self, player: int | str) -> None:
        """A run that is over, if it was one, waits for its possession's end."""
        now = self.s["open"]
        run = now["runs"].pop(str(player), None)
        if run and (run[1] - run[0] + 1) * 1000 >= self.p.min_run_ms * now["fps"] and run[2] >= self.p.min_run_distance:
            now["done"].append([int(player), *run])

    def close(self) -> list[tuple]:
        """The open possession and its runs, if it lasted."""
        now, self.s["open"] = self.s["open"], self.s["open"]
        if not now:
            return []
        for player in list(now["runs"]):
            self.ended(player)
        self.s["open"] = None
        if now["n"] * 1000 < self.p.min_possession_ms * now["fps"]:
            return []
        ms = lambda n: n * 1000 // now["fps"]
        out = [("possession", now["id"], None, now["team"], now["fps"], now["f_start"], now["f_end"], now["n"], ms(now["n"]), None)]
        return out + [("run", now["id"], player, now["team"], now["fps"], a, b, b - a + 1, ms(b - a + 1), d) for player, a, b, d in now["done"]]

    def finish(self) -> list[tuple]:
        """What the end of the period closes."""
        out = self.feed([], 1 << 62) + self.vote(1 << 62) + self.close()
        self.s["votes"] = []
        return out


class Islands(StatefulProcessor):
    """Period as Spark's stateful processor; times are those of the rows, kickoff_ms behind the event time."""

    def __init__(self, p: Params, end_ms: int) -> None:
        self.p, self.end_ms = p, end_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("period", "saved string, kickoff_ms long, last_ms long")

    def load(self) -> tuple[Period, int, int]:
        saved, kickoff, last = self.state.get() if self.state.exists() else (None, 0, 0)
        return Period(self.p, saved), kickoff, last

    def leave(self, period: Period, kickoff: int, last: int) -> None:
        """Save, and come back when what waits is complete, or the period has ended."""
        self.state.update((period.saved(), kickoff, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        waits = period.waits_until
        if waits is not None or period.s["open"] or period.s["votes"]:
            self.handle.registerTimer(kickoff + (last + self.end_ms if waits is None else waits + 1))

    @staticmethod
    def table(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(kind, key[0], key[1], *rest) for kind, *rest in rows], columns=COLUMNS).astype({"player_id": "Int64", "distance": "float64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        period, kickoff, last = self.load()
        new: list[list] = []
        for part in rows:
            kickoff = int(part["kickoff_ms"].iloc[0]) if len(part) else kickoff
            new += part[ROW].to_numpy(dtype=object).tolist()
        new = [[int(f), int(t), int(fps), int(player), team, bool(gk), float(x), float(y)] for f, t, fps, player, team, gk, x, y in new]
        last = max([last, *(r[1] for r in new)])
        out = period.feed(new, timerValues.getCurrentWatermarkInMs() - kickoff)
        self.leave(period, kickoff, last)
        yield self.table(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        period, kickoff, last = self.load()
        now = timerValues.getCurrentWatermarkInMs() - kickoff
        out = period.feed([], now)
        if period.waits_until is None and now > last + self.end_ms:
            out += period.finish()
        self.leave(period, kickoff, last)
        yield self.table(key, out)

    def close(self) -> None:
        pass


def stream_intervals(tracking: DataFrame, roster: DataFrame, kickoffs: DataFrame | None = None, late: str = "2 seconds", end_ms: int = 60_000, p: Params = DEFAULT) -> DataFrame:
    """(kind, match_id, period, possession_id, player_id, team, fps, f_start, f_end, n_frames, duration_ms, distance) of possessions and runs that are over.

    tracking is a stream of the canonical table, roster a table. kickoffs (match_id, period, kickoff_ms) gives each
    period its place in time, which a stream of several matches needs; without it all begin a second after the epoch (at the epoch itself, Spark takes rows for late). What is open end_ms after
    the last row of a period is closed. Write it in append mode.
    """
    keepers = roster.filter("is_gk").select("match_id", "player_id", F.lit(True).alias("is_gk"))
    t = tracking.join(keepers, ["match_id", "player_id"], "left")
    t = t.join(kickoffs, ["match_id", "period"]) if kickoffs is not None else t.withColumn("kickoff_ms", F.lit(1000).cast("long"))
    t = t.select("match_id", "period", "frame", "t_ms", "fps", "player_id", "team", F.coalesce("is_gk", F.lit(False)).alias("is_gk"), "x", "y", "kickoff_ms", F.timestamp_millis(F.col("kickoff_ms") + F.col("t_ms")).alias("ts"))
    return t.withWatermark("ts", late).groupBy("match_id", "period").transformWithStateInPandas(Islands(p, end_ms), INTERVALS, "append", "eventtime")
