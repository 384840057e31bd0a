"""Parameters of every stage: published thresholds, and defaults where none is published."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Lengths in metres, times in milliseconds, speeds in metres a second."""

    # published
    carrier_radius: float = 3.0
    vote_ms: int = 1000
    min_possession_ms: int = 3000
    run_speed: float = 4.0
    min_run_ms: int = 1000
    min_run_distance: float = 5.0
    horizon_ms: int = 5000
    window_ms: int = 3000
    stride_ms: int = 1000
    # ours
    pitch_length: float = 105.0
    pitch_width: float = 68.0
    box_depth: float = 16.5
    box_half_width: float = 20.16
    pressure_radius: float = 5.0
    drift_ms: int = 500
    press_speed: float = 2.0
    press_radius: float = 8.0
    min_press_ms: int = 500
    free_space: float = 5.0
    drag_distance: float = 5.0
    gain_share: float = 0.05
    team_size: int = 11


DEFAULT = Params()
#: One entity's key, one frame's key.
ENTITY = ("match_id", "period", "player_id")
FRAME = ("match_id", "period", "frame")
