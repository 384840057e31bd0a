"""Possessions and runs on a stream are those of the batch, however the rows come."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pitchlake.operators import possession
from pitchlake.params import DEFAULT
from pitchlake.plans.tracking_plan import TrackingPlan
from pitchlake.sources.fixture import from_events
from pitchlake.sources.schema import TRACKING
from pitchlake.streaming import islands
from pitchlake.streaming.tracking_stream import read_stream

SF = "/root/testdata/sf0.01"


class Part:
    """Two matches, at 10 and 25 frames a second, with a gap and a second period."""

    def __init__(self, spark):
        t = from_events(spark, SF)
        some = t.tracking.filter("match_id in (2, 3) and t_ms < 45000").filter("not (match_id = 2 and frame between 200 and 203)")
        second = some.filter("match_id = 3").withColumn("period", F.lit(2)).filter("t_ms < 15000")
        self.tracking = spark.createDataFrame(some.unionByName(second).orderBy("match_id", "period", "frame", "player_id").collect(), TRACKING).cache()
        self.roster, self.direction, self.spark = t.roster, t.direction, spark


@pytest.fixture(scope="module")
def part(spark):
    return Part(spark)


@pytest.fixture(scope="module")
def batch(part):
    p = TrackingPlan(part)
    runs = p.runs.select(F.lit("run").alias("kind"), "match_id", "period", "possession_id", "player_id", "team", "fps", "f_start", "f_end", "n_frames", "duration_ms", F.round("distance", 6).alias("distance"))
    held = possession.possessions(p.framed).select(F.lit("possession").alias("kind"), "match_id", "period", "possession_id", F.lit(None).cast("long").alias("player_id"), "team", "fps", "f_start", "f_end", "n_frames", "duration_ms", F.lit(None).cast("double").alias("distance"))
    rows = {tuple(r) for r in runs.unionByName(held).collect()}
    assert len(rows) > 20 and {r[0] for r in rows} == {"run", "possession"}
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_any_split_gives_the_batch(part, batch, seed):
    rng = random.Random(seed)
    keepers = {(r.match_id, r.player_id) for r in part.roster.filter("is_gk").collect()}
    by = {}
    for r in part.tracking.collect():
        by.setdefault((r.match_id, r.period), []).append([r.frame, r.t_ms, r.fps, r.player_id, r.team, (r.match_id, r.player_id) in keepers, r.x, r.y])
    got = []
    for key, rows in by.items():
        delay = rng.choice([0, 300, 5000])
        rows = sorted(rows, key=lambda r: r[1] + rng.randint(0, delay))
        period, at, seen = islands.Period(DEFAULT), 0, 0
        while at < len(rows):
            n = rng.choice([1, 7, 500, 9000])
            part_rows, at = rows[at : at + n], at + n
            seen = max([seen, *(r[1] for r in part_rows)])
            period = islands.Period(DEFAULT, period.saved())  # as state goes from batch to batch
            got += [(kind, *key, *rest) for kind, *rest in period.feed(part_rows, seen - delay)]
        got += [(kind, *key, *rest) for kind, *rest in period.finish()]
        assert period.saved() and not period.s["waiting"] and not period.s["open"]
    assert {(*r[:-1], None if r[-1] is None else round(r[-1], 6)) for r in got} == batch and len(got) == len(batch)


def run_stream(spark, path, checkpoint, out, part, kickoffs):
    stream = islands.stream_intervals(read_stream(spark, path, 1), part.roster, kickoffs, late="4 seconds", end_ms=20_000)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert q.exception() is None


def test_stream_with_restart_gives_the_batch(spark, part, batch, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    islands.state_store(spark)
    try:
        rng = random.Random(1)
        kickoffs = spark.createDataFrame([(2, 1, 500), (3, 1, 1000), (3, 2, 120_000), (999, 1, 600_000)], "match_id long, period int, kickoff_ms long")
        start = {(2, 1): 500, (3, 1): 1000, (3, 2): 120_000}
        files = {}
        for r in part.tracking.collect():
            due = start[r.match_id, r.period] + r.t_ms + rng.randint(0, 2500)
            files.setdefault(due // 9000, []).append(r)
        path = str(tmp_path / "in")
        os.makedirs(path)

        def put(numbers):
            for n in numbers:
                rows = files[n]
                rng.shuffle(rows)
                spark.createDataFrame(rows, TRACKING).coalesce(1).write.mode("append").parquet(path)
                for f in os.listdir(path):
                    full = os.path.join(path, f)
                    if f.endswith(".parquet") and full not in placed:
                        placed.add(full)
                        os.utime(full, (1_000_000 + 10 * n, 1_000_000 + 10 * n))

        placed, order = set(), sorted(files)
        put(order[:3])
        run_stream(spark, path, str(tmp_path / "cp"), str(tmp_path / "out"), part, kickoffs)
        files[10**6] = [part.tracking.filter("match_id = 2").first().asDict() | {"match_id": 999}]
        put([*order[3:], 10**6])
        run_stream(spark, path, str(tmp_path / "cp"), str(tmp_path / "out"), part, kickoffs)
        got = spark.read.parquet(str(tmp_path / "out")).withColumn("distance", F.round("distance", 6)).collect()
        assert {tuple(r) for r in got} == batch and len(got) == len(batch)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
