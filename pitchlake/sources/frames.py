"""Frames of video, each a row, read in parallel.

Uncompressed video without a header is a file of frames of one length: Spark's input splits cut it
by bytes at frames' ends, in any store that Spark reads, and a task that runs again reads its split only. A
sequence of images is a file a frame. Compressed video needs a decoder, which is outside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "clip string, frame long, t_ms long, image binary"
#: Bytes of a frame to a pixel, in quarters, by name of the layout.
QUARTERS = {"gray8": 4, "yuv420p": 6, "yuv422p": 8, "yuv444p": 12, "rgb24": 12, "bgr24": 12, "rgba": 16}


def raw_video(spark: SparkSession, path: str, clip: str, width: int, height: int, fps: int, layout: str = "rgb24") -> DataFrame:
    """(clip, frame, t_ms, image) of a file of uncompressed frames one after another; a file that ends within a frame is an error.

    Frames are numbered by their place in the file: splits are in order, and a first pass counts each split's frames.
    """
    length = width * height * QUARTERS[layout] // 4
    if length <= 0 or (layout == "yuv420p" and (width % 2 or height % 2)):
        raise ValueError(f"no frame of {width} x {height} in {layout}")
    rows = spark.sparkContext.binaryRecords(path, length).zipWithIndex().map(lambda x: (clip, x[1], x[1] * 1000 // fps, bytearray(x[0])))
    return spark.createDataFrame(rows, FRAMES)


def image_sequence(spark: SparkSession, path: str, fps: int, pattern: str = "*") -> DataFrame:
    """(clip, frame, t_ms, image) of folders of images, a folder a clip; the frame is the last number in a file's name. Files without one are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d{1,18})\D*$", 1)
    named = files.select(F.element_at(F.split("path", "/"), -2).alias("clip"), number.try_cast("long").alias("frame"), F.col("content").alias("image")).filter("frame is not null")
    return named.select("clip", "frame", F.expr(f"frame * 1000 div {int(fps)}").alias("t_ms"), "image")
