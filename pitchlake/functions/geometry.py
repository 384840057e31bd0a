"""Column functions of pitch geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchlake.params import DEFAULT, Params


def length(dx: Column, dy: Column) -> Column:
    """sqrt of squares, which every engine rounds alike."""
    return F.sqrt(dx * dx + dy * dy)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return length(ax - bx, ay - by)


def attack_x(x: Column, sign: Column, p: Params = DEFAULT) -> Column:
    """x as if the attack went towards +x."""
    return F.when(sign < 0, p.pitch_length - x).otherwise(x)


def attack_y(y: Column, sign: Column, p: Params = DEFAULT) -> Column:
    return F.when(sign < 0, p.pitch_width - y).otherwise(y)


def goal_distance(x: Column, y: Column, p: Params = DEFAULT) -> Column:
    """To the centre of the goal attacked; x and y normalised."""
    return length(p.pitch_length - x, p.pitch_width / 2 - y)


def in_box(x: Column, y: Column, p: Params = DEFAULT) -> Column:
    return (x >= p.pitch_length - p.box_depth) & (F.abs(y - p.pitch_width / 2) <= p.box_half_width)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def ms_to_frames(ms: int, fps: Column) -> Column:
    """Whole frames of a time, at each match's own rate."""
    return (F.lit(ms) * fps / 1000).cast("long")
