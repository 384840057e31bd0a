"""Frames of uncompressed video and of image sequences."""

import numpy as np
import pytest

from pitchlake.sources import frames


def test_raw_video_is_read_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(0)
    video = rng.integers(0, 256, (40, 12, 16, 3), dtype=np.uint8)
    path = str(tmp_path / "clip.rgb")
    video.tofile(path)
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.input.fileinputformat.split.maxsize", str(5 * 12 * 16 * 3 + 7))  # not at a frame's end
    try:
        df = frames.raw_video(spark, path, "a", 16, 12, 25)
        assert df.rdd.getNumPartitions() > 5
        rows = df.collect()
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("mapreduce.input.fileinputformat.split.maxsize")
    assert [(r.clip, r.frame, r.t_ms) for r in rows] == [("a", i, i * 40) for i in range(40)]
    assert all(bytes(r.image) == video[r.frame].tobytes() for r in rows)


def test_raw_video_that_is_cut_off_is_an_error(spark, tmp_path):
    path = tmp_path / "cut.rgb"
    path.write_bytes(b"x" * (16 * 12 * 3 * 2 + 5))
    with pytest.raises(Exception, match="(?i)partial|record|multiple|EOF|end of"):
        frames.raw_video(spark, str(path), "a", 16, 12, 25).collect()
    with pytest.raises(ValueError, match="no frame"):
        frames.raw_video(spark, str(path), "a", 15, 12, 25, "yuv420p")


def test_image_sequences(spark, tmp_path):
    for clip, n in (("one", 4), ("two", 3)):
        (tmp_path / clip).mkdir()
        for i in range(n):
            (tmp_path / clip / f"cam1_{i:05}.ppm").write_bytes(bytes([i]) * 9)
    (tmp_path / "one" / "readme.ppm").write_bytes(b"no number")
    (tmp_path / "one" / "cam1_00009.txt").write_bytes(b"no image")
    got = sorted((r.clip, r.frame, r.t_ms, bytes(r.image)) for r in frames.image_sequence(spark, str(tmp_path), 10, "*.ppm").collect())
    assert got == sorted([("one", i, i * 100, bytes([i]) * 9) for i in range(4)] + [("two", i, i * 100, bytes([i]) * 9) for i in range(3)])
