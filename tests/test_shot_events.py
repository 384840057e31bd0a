"""Shot events from a provider's clock, and the interval join that labels runs."""

import json
import random

from pyspark.sql import functions as F

from pitchlake.operators import runs
from pitchlake.sources import events
from pitchlake.sources.schema import MATCHES


def ball_of(rng, match, period, fps, shots, frames=3000):
    """A slow ball that is struck at the shots, and now and then otherwise."""
    hits = {round(t * fps / 1000) for t in shots} | {rng.randrange(frames) for _ in range(25)}
    return [(match, period, f, f * 1000 // fps, 20.0 if f in hits or f - 1 in hits else rng.random() * 8) for f in range(frames)]


def test_planted_offsets_are_found(spark, tmp_path):
    rng = random.Random(5)
    planted = {(1, 1): 7300, (1, 2): -41_250, (2, 1): 0, (3, 1): None}
    ball, lines = [], []
    truth = {}
    for (match, period), offset in planted.items():
        fps = 25 if match == 1 else 10
        times = sorted(rng.sample(range(60_000, 3000 * 1000 // fps - 1000, 700), 9))
        times = [round(t * fps / 1000) * 1000 // fps for t in times]
        ball += ball_of(rng, match, period, fps, times if offset is not None else [])
        for t in times:
            clock = t - (offset or 0)
            lines.append({"match_id": match, "period": period, "clock": f"{clock // 60000}:{clock % 60000 / 1000:06.3f}", "type": "Shot", "team": "home"})
            if offset is not None:
                truth.setdefault(match, set()).add((period, round(t * fps / 1000)))
    lines += [{"match_id": 1, "period": 1, "clock": "nonsense", "type": "shot", "team": "home"}, {"match_id": 2, "period": 1, "clock": "1:00.000", "type": "foul", "team": "away"}]
    path = str(tmp_path / "events.json")
    with open(path, "w") as f:
        f.write("\n".join(map(json.dumps, lines)))
    e = events.read_events(spark, path)
    b = spark.createDataFrame(ball, "match_id long, period int, frame long, t_ms long, speed double")
    matches = spark.createDataFrame([(m, "x", 25 if m == 1 else 10, False, 105.0, 68.0) for m in (1, 2, 3, 4)], MATCHES)
    found = {(r.match_id, r.period): r.offset_ms for r in events.offsets(e.filter("type = 'shot'"), events.struck(b)).collect()}
    for key, offset in planted.items():
        assert found[key] is None if offset is None else abs(found[key] - offset) <= 100, (key, found[key])
    shots, known = events.aligned_shots(e, b, matches)
    assert {r.match_id: r.has_shots for r in known.collect()} == {1: True, 2: True, 3: False, 4: False} and known.columns == matches.columns
    got = {}
    for r in shots.collect():
        got.setdefault(r.match_id, set()).add((r.period, r.frame))
    assert got.keys() == {1, 2}
    for m, want in truth.items():
        assert len(got[m]) == len(want) and all(any(p == q and abs(f - g) <= 3 for q, g in want) for p, f in got[m])
    assert events.aligned_shots(e.filter("false"), b, matches)[0].count() == 0


def test_labels_by_buckets_equal_all_pairs(spark):
    rng = random.Random(6)
    rows = [(f"r{i}", rng.randint(1, 2), 1, rng.choice(["home", "away"]), 25, rng.randint(0, 9000)) for i in range(300)]
    hits = [(rng.randint(1, 3), 1, rng.randint(0, 9000), rng.choice(["home", "away"])) for _ in range(120)]
    r = spark.createDataFrame(rows, "run_id string, match_id long, period int, team string, fps int, f_end long")
    s = spark.createDataFrame(hits * 2, "match_id long, period int, frame long, team string")
    m = spark.createDataFrame([(k, "x", 25, k != 2, 105.0, 68.0) for k in (1, 2, 3)], MATCHES)
    pairs = {(a[0], f * 40) for a in rows for q, _, f, team in hits if q == a[1] and team == a[3] and a[5] * 40 < f * 40 <= a[5] * 40 + 5000}
    got = runs.shots_after(r, s, m)
    assert sorted(map(tuple, got.collect())) == sorted(pairs)
    labels = {x.run_id: x.shot_5s for x in runs.label_shots(r, s, m).collect()}
    assert labels == {a[0]: None if a[1] == 2 else any(p == a[0] for p, _ in pairs) for a in rows}
    # what meets before the times are compared is bounded: a run asks in two buckets
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan
    most = s.distinct().withColumn("b", F.expr("frame * 40 div 5000")).groupBy("match_id", "team", "b").count().agg(F.max("count")).first()[0]
    near = r.withColumn("b", F.explode(F.array(F.expr("f_end * 40 div 5000"), F.expr("f_end * 40 div 5000 + 1")))).join(s.distinct().withColumn("b", F.expr("frame * 40 div 5000")), ["match_id", "team", "b"]).count()
    assert near <= 2 * len(rows) * most
