"""Shot events of a provider, brought onto the clock of the tracking.

Event files have clocks of their own, which begin earlier or later than the tracking's. A shot is a
moment at which the ball becomes fast; so the differences between event times and those moments gather at the
offset, whatever else the ball does. Each match and period gets its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.sources.schema import SHOTS, conform

EVENTS = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("period", T.IntegerType()), T.StructField("clock", T.StringType()), T.StructField("type", T.StringType()), T.StructField("team", T.StringType())])
#: Speed, in metres a second, that the ball passes when it is struck; how far clocks may differ; width of the bins of differences; share of the shots that have to agree.
STRUCK, MOST_MS, BIN_MS, AGREE = 12.0, 120_000, 200, 0.5


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, period, type, team, clock_ms) of JSON lines with a clock as minutes:seconds.thousandths; events without a readable clock are left out."""
    e = spark.read.schema(EVENTS).json(path)
    part = lambda i, kind: F.regexp_extract("clock", r"^\s*(\d{1,3}):(\d{1,2}(?:\.\d+)?)\s*$", i).try_cast(kind)
    ms = (part(1, "long") * 60_000 + F.round(part(2, "double") * 1000)).cast("long")
    return e.select("match_id", "period", F.lower("type").alias("type"), "team", ms.alias("clock_ms")).filter("clock_ms is not null")


def struck(ball: DataFrame, speed: float = STRUCK) -> DataFrame:
    """(match_id, period, t_ms) of the frames in which the ball passes that speed; ball(match_id, period, frame, t_ms, speed)."""
    w = Window.partitionBy("match_id", "period").orderBy("frame")
    now, before = F.coalesce("speed", F.lit(0.0)), F.coalesce(F.lag("speed").over(w), F.lit(0.0))
    return ball.withColumn("_hit", (now > speed) & (before <= speed)).filter("_hit").select("match_id", "period", "t_ms")


def offsets(events: DataFrame, moments: DataFrame, most_ms: int = MOST_MS, bin_ms: int = BIN_MS, agree: float = AGREE) -> DataFrame:
    """(match_id, period, offset_ms, n_events, n_agree): what to add to event times; null unless that share of the events agrees.

    Differences are counted in bins that overlap by half; of bins with as many events, the one nearest to no offset counts, and
    the offset is the median within it. An event counts once in a bin. Events meet only moments within most_ms, by buckets of time.
    """
    # an event's bucket and both beside it hold every moment that is near enough
    e = events.select("match_id", "period", "clock_ms", F.monotonically_increasing_id().alias("event"), F.explode(F.sequence(F.expr(f"clock_ms div {most_ms} - 1"), F.expr(f"clock_ms div {most_ms} + 1"))).alias("bucket"))
    m = moments.select("match_id", "period", "t_ms", F.expr(f"t_ms div {most_ms}").alias("bucket"))
    d = e.join(m, ["match_id", "period", "bucket"]).select("match_id", "period", "event", (F.col("t_ms") - F.col("clock_ms")).alias("d")).filter(F.abs("d") <= most_ms)
    half = bin_ms // 2
    d = d.withColumn("bin", F.explode(F.array(F.floor(F.col("d") / half), F.floor(F.col("d") / half) - 1)))
    bins = d.groupBy("match_id", "period", "bin").agg(F.count_distinct("event").alias("n_agree"), F.median("d").cast("long").alias("offset_ms"))
    best = bins.groupBy("match_id", "period").agg(F.max(F.struct("n_agree", (-F.abs("offset_ms")).alias("near"), "offset_ms")).alias("b"))
    n = events.groupBy("match_id", "period").agg(F.count(F.lit(1)).alias("n_events"))
    sure = F.coalesce(F.col("b.n_agree") >= agree * F.col("n_events"), F.lit(False))
    return n.join(best, ["match_id", "period"], "left").select("match_id", "period", F.when(sure, F.col("b.offset_ms")).alias("offset_ms"), "n_events", F.coalesce("b.n_agree", F.lit(0).cast("long")).alias("n_agree"))


def aligned_shots(events: DataFrame, ball: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shots, matches): shot events as the canonical table, on the tracking's frames, and matches with has_shots where every period with shots has an offset.

    A match without shot events, or with a period whose clock cannot be found, keeps has_shots false: its labels stay masked.
    """
    shots = events.filter("type = 'shot'")
    found = offsets(shots, struck(ball))
    placed = shots.join(found.filter("offset_ms is not null"), ["match_id", "period"]).join(matches.select("match_id", "fps"), "match_id")
    frame = F.round((F.col("clock_ms") + F.col("offset_ms")) * F.col("fps") / 1000).cast("long")
    whole = found.groupBy("match_id").agg(F.bool_and(F.col("offset_ms").isNotNull()).alias("has_shots"))
    known = matches.drop("has_shots").join(whole, "match_id", "left").withColumn("has_shots", F.coalesce("has_shots", F.lit(False))).select(matches.columns)
    usable = placed.join(whole.filter("has_shots").select("match_id"), "match_id", "left_semi")
    return conform(usable.select("match_id", "period", frame.alias("frame"), "team").filter("frame >= 0"), SHOTS), known
