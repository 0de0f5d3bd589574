"""Body states from simulator samples, and whole frames labelled.

A sample holds the state of all bodies as two arrays: six velocities a body, and seven
positions (three coordinates, four of a quaternion). `compat` chooses how the arrays are
addressed: "fixed" reads each body's own numbers; "exact" repeats a known fault, reading
positions at the velocity's address, and a contact's later velocity from the body after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions import vec
from kinelake.operators import kinematics

VELOCITIES, POSITIONS = 6, 7
COMPAT = ("fixed", "exact")


def _checked(compat: str) -> str:
    if compat not in COMPAT:
        raise ValueError(f"compat is one of {COMPAT}")
    return compat


def position_address(i: Column, compat: str = "fixed") -> Column:
    """Place of body i's first position."""
    return i * (POSITIONS if _checked(compat) == "fixed" else VELOCITIES)


def camera_address(i: Column, compat: str = "fixed") -> Column:
    """Place of body i's position as the camera reads it: "exact" takes the number of the body's joint for an address."""
    return i * POSITIONS if _checked(compat) == "fixed" else i


def later_body(geom_id: Column, bodies: Column, compat: str = "fixed") -> Column:
    """Index of the body whose velocity counts after a contact of geom_id (1 and up; 0 is the floor)."""
    return geom_id - 1 if _checked(compat) == "fixed" else F.least(geom_id, bodies - 1)


def states(samples: DataFrame, bodies: Column, compat: str = "fixed", qvel: str = "qvel", qpos: str = "qpos") -> DataFrame:
    """One row a body: obj_idx, id, geom_id, velocity, angular_velocity, position, quaternion.

    Places past the end of the arrays give shorter arrays.
    """
    rest = [c for c in samples.columns if c not in (qvel, qpos)]
    each = samples.select("*", F.explode(F.sequence(F.lit(0), bodies - 1)).alias("obj_idx"))
    i = F.col("obj_idx")
    v, p = i * VELOCITIES, position_address(i, compat)
    return each.select(
        *rest,
        "obj_idx",
        F.concat(F.lit("geom_obj"), i.cast("string")).alias("id"),
        (i + 1).alias("geom_id"),
        F.slice(qvel, v + 1, 3).alias("velocity"),
        F.slice(qvel, v + 4, 3).alias("angular_velocity"),
        F.slice(qpos, p + 1, 3).alias("position"),
        F.slice(qpos, p + 4, 4).alias("quaternion"),
    )


def annotated(df: DataFrame, stop: float = kinematics.STOP_SPEED, tip: float = kinematics.TIP_DEGREES) -> DataFrame:
    """states with active_labels, from unrounded speeds and the tilt."""
    stopped = kinematics.is_stopped(vec.norm3(F.col("velocity")), vec.norm3(F.col("angular_velocity")), stop)
    return df.withColumn("active_labels", kinematics.active_labels(stopped, kinematics.is_tipped(vec.tilt_degrees(F.col("quaternion")), tip)))


def motion_dt(step_dt: Column, frame_dt: Column, compat: str = "fixed") -> Column:
    """Time that a change of velocity is divided by: between frames, or ("exact") one simulator step."""
    return frame_dt if _checked(compat) == "fixed" else step_dt
