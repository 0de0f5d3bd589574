"""From simulator steps to video frames: step times, frame gate, seeded lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.vec import round_even
from kinelake.operators import scans

MIN_DT = 1e-6


def step_delta(df: DataFrame, keys: list[str], order: list[str], time: str, out: str = "dt", piece: Column | None = None) -> DataFrame:
    """Time since the previous step of the same key; the first step and ties give MIN_DT. piece: cut long runs (see `scans`)."""
    if piece is not None:
        lagged = scans.lagged(df, keys, order, time, "_before", piece, F.col(time))
        return lagged.withColumn(out, F.greatest(F.col(time) - F.col("_before"), F.lit(MIN_DT))).drop("_before")
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.lag(time).over(w), F.col(time))
    return df.withColumn(out, F.greatest(F.col(time) - before, F.lit(MIN_DT)))


def frame_gate(df: DataFrame, keys: list[str], order: list[str], position: Column, piece: Column | None = None) -> DataFrame:
    """Keep the steps at which a frame is due, adding frame_idx (from 0).

    `position` is time * fps, non-negative and non-decreasing in `order`. A step
    emits one frame while fewer frames than `position` have been emitted. Unrolled,
    the count after step k is k + least(0, running min(ceil(position_j) - j)). piece: cut long runs (see `scans`).
    """
    if piece is not None:
        return scans.gated(df, keys, order, position, piece)
    w = Window.partitionBy(*keys).orderBy(*order)
    k = F.row_number().over(w)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = df.withColumns({"_k": k, "_x": F.ceil(position).cast("long")})
    counted = stepped.withColumn("_n", F.col("_k") + F.least(F.lit(0), F.min(F.col("_x") - F.col("_k")).over(so_far)))
    emitted = counted.withColumn("_was", F.coalesce(F.lag("_n").over(w), F.lit(0)))
    return (
        emitted.where(F.col("_n") > F.col("_was"))
        .withColumn("frame_idx", (F.col("_n") - 1).cast("long"))
        .drop("_k", "_x", "_n", "_was")
    )


def bucket_first(df: DataFrame, keys: list[str], order: list[str], position: Column) -> DataFrame:
    """First step of each frame interval (k, k+1]; equals frame_gate for dense regular steps."""
    w = Window.partitionBy(*keys, "frame_idx").orderBy(*order)
    return (
        df.withColumn("frame_idx", (F.ceil(position) - 1).cast("long"))
        .withColumn("_r", F.row_number().over(w))
        .where("_r = 1")
        .drop("_r")
    )


def lag_seeded(df: DataFrame, keys: list[str], order: list[str], value: str, seed: Column, out: str, piece: Column | None = None) -> DataFrame:
    """Previous frame's value, and `seed` for the first frame. piece: cut long runs (see `scans`)."""
    if piece is not None:
        return scans.lagged(df, keys, order, value, out, piece, seed)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.coalesce(F.lag(value).over(w), seed))


def previous_velocity(df: DataFrame, keys: list[str], order: list[str], velocity: str, initial: Column, name: str = "vel_prev") -> DataFrame:
    """df with the velocity rounded to two decimals, and that of the row before (of `initial` in the first row)."""
    rounded = lambda v: F.transform(v, lambda x: round_even(x, 2))
    return lag_seeded(df.withColumn(velocity, rounded(F.col(velocity))), keys, order, velocity, rounded(initial), name)
