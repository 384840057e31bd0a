"""Sources and sinks of the tracking table.

Provider files differ; each adapter reads one layout, stated in its docstring,
and hands on the canonical long table: a row for each frame and entity, the ball
among them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.sources.schema import TRACKING, conform


def load_tracking(spark: SparkSession, path: str) -> DataFrame:
    """The canonical Parquet table; filters on match_id prune its folders."""
    return spark.read.schema(TRACKING).parquet(path)


def write_tracking(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the canonical table, a folder a match: rows of a match meet in a few tasks, not in one file a task and match."""
    conform(df, TRACKING).repartition("match_id", "period").write.mode(mode).partitionBy("match_id").parquet(path)


def combine(*tables: DataFrame) -> DataFrame:
    """Matches of several providers as one table."""
    return reduce(lambda a, b: a.unionByName(b), [conform(t, TRACKING) for t in tables])


def with_time(df: DataFrame) -> DataFrame:
    return df.withColumn("t_ms", F.expr("frame * 1000 div fps"))


def read_json_frames(spark: SparkSession, path: str, match_id: int, fps: int = 10, pitch: tuple[float, float] = (105.0, 68.0)) -> DataFrame:
    """Broadcast tracking: a JSON object a line, {period, frame, data: [{player_id, team, x, y}]}; metres from the centre spot; the ball has team `ball`."""
    entity = T.StructType([T.StructField("player_id", T.LongType()), T.StructField("team", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    schema = T.StructType([T.StructField("period", T.IntegerType()), T.StructField("frame", T.LongType()), T.StructField("data", T.ArrayType(entity))])
    df = spark.read.schema(schema).json(path).select("period", "frame", F.explode("data").alias("e"))
    df = df.select(F.lit(match_id).alias("match_id"), "period", "frame", F.lit(fps).alias("fps"), "e.player_id", "e.team", (F.col("e.x") + pitch[0] / 2).alias("x"), (F.col("e.y") + pitch[1] / 2).alias("y"))
    return conform(with_time(df), TRACKING)


def read_xml_positions(spark: SparkSession, path: str, match_id: int, fps: int = 25, pitch: tuple[float, float] = (105.0, 68.0)) -> DataFrame:
    """Optical tracking: XML with <FrameSet Period Team PersonId><Frame N X Y/></FrameSet>; metres from the centre spot; numeric ids; the ball has team `ball`."""
    frame = T.StructType([T.StructField("_N", T.LongType()), T.StructField("_X", T.DoubleType()), T.StructField("_Y", T.DoubleType())])
    schema = T.StructType([T.StructField("_Period", T.IntegerType()), T.StructField("_Team", T.StringType()), T.StructField("_PersonId", T.LongType()), T.StructField("Frame", T.ArrayType(frame))])
    df = spark.read.schema(schema).option("rowTag", "FrameSet").xml(path).select("_Period", "_Team", "_PersonId", F.explode("Frame").alias("f"))
    df = df.select(
        F.lit(match_id).alias("match_id"), F.col("_Period").alias("period"), F.col("f._N").alias("frame"), F.lit(fps).alias("fps"), F.col("_PersonId").alias("player_id"), F.col("_Team").alias("team"),
        (F.col("f._X") + pitch[0] / 2).alias("x"), (F.col("f._Y") + pitch[1] / 2).alias("y"),
    )
    return conform(with_time(df), TRACKING)


def read_wide_csv(spark: SparkSession, path: str, match_id: int, entities: dict[str, tuple[int, str]], fps: int = 25, pitch: tuple[float, float] = (105.0, 68.0)) -> DataFrame:
    """Sample games: CSV with a row a frame, columns period, frame and <name>_x, <name>_y for each entity, in fractions of the pitch. entities: name -> (player_id, team)."""
    fields = [T.StructField("period", T.IntegerType()), T.StructField("frame", T.LongType())]
    fields += [T.StructField(f"{name}_{axis}", T.DoubleType()) for name in entities for axis in "xy"]
    df = spark.read.schema(T.StructType(fields)).option("header", True).csv(path)
    each = [F.struct(F.lit(i).cast("long").alias("player_id"), F.lit(team).alias("team"), (F.col(f"{name}_x") * pitch[0]).alias("x"), (F.col(f"{name}_y") * pitch[1]).alias("y")) for name, (i, team) in entities.items()]
    df = df.select(F.lit(match_id).alias("match_id"), "period", "frame", F.lit(fps).alias("fps"), F.explode(F.array(*each)).alias("e")).select("match_id", "period", "frame", "fps", "e.*")
    return conform(with_time(df.filter("x is not null and y is not null")), TRACKING)


def read_video_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Video or image files as (path, length, content), for an external detector."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A ranked report as json, csv or parquet; it is small, so it becomes one file."""
    df.coalesce(1).write.mode("overwrite").format(fmt).option("header", True).save(path)
