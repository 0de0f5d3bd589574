"""Per-object motion labels: linear motion, stopped, tipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinelake.functions import vec

# Label thresholds and label names.
ACCELERATION_EPS = 0.01
SPEED_CHANGE_EPS = 1e-6
STOP_SPEED = 0.05
TIP_DEGREES = 45.0
CONSTANT, FASTER, SLOWER = "Constant Velocity", "Accelerating", "Decelerating"
STOPPED, TIPPED = "Stopped", "Tipped"


def motion_label(acc_norm: Column, speed_change: Column) -> Column:
    """Label of one frame; NULL where speed does not change although velocity does."""
    change = F.when(F.abs(speed_change) < SPEED_CHANGE_EPS, F.lit(0.0)).otherwise(speed_change)
    return (
        F.when(vec.round_even(acc_norm, 3) < ACCELERATION_EPS, CONSTANT)
        .when(change > 0, FASTER)
        .when(change < 0, SLOWER)
    )


def linear_motion(now: list[Column], before: list[Column], dt: Column) -> Column:
    """Motion label from velocity components now and before, `dt` > 0 apart."""
    acc = [(a - b) / dt for a, b in zip(now, before, strict=True)]
    square, change = acc[0] * acc[0], now[0] * acc[0]
    for a, v in zip(acc[1:], now[1:], strict=True):
        square, change = square + a * a, change + v * a
    return motion_label(F.sqrt(square), change)


def is_stopped(lin_speed: Column, ang_speed: Column, limit: float = STOP_SPEED) -> Column:
    """Both speeds strictly under the limit (unrounded)."""
    return (lin_speed < limit) & (ang_speed < limit)


def is_tipped(tilt_deg: Column, limit: float = TIP_DEGREES) -> Column:
    return tilt_deg > limit


def active_labels(stopped: Column, tipped: Column) -> Column:
    """Array of active labels, Stopped before Tipped."""
    return F.array_compact(F.array(F.when(stopped, STOPPED), F.when(tipped, TIPPED)))
