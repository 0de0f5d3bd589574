"""Camera tracking: centroid, spread, smoothing, rotation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.vec import clamp
from kinelake.operators import scans

# Smoothing, rotation a frame, limits and defaults of the camera.
ALPHA, TURN_DEGREES, START_AZIMUTH, ELEVATION = 0.1, 0.05, -90.0, -15.0
LEAST_HEIGHT, NEAR, FAR, MARGIN = 0.5, 3.0, 6.0, 2.0
DEFAULT_LOOKAT, DEFAULT_DISTANCE = (0.0, 0.0, 2.0), 3.0

@dataclass(frozen=True)
class Settings:
    """A run's camera: whether it follows the bodies (mode 1), and where it starts."""

    mode: int = 0
    azimuth: float = START_AZIMUTH
    distance: float = 2.23606797749979

    def track(self, frames: DataFrame, keys: list[str], order: str) -> DataFrame:
        return track(frames, keys, order, self.azimuth, self.distance, follow=self.mode == 1)


def centroid(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean position (x, y, z) of each group, its height at least LEAST_HEIGHT."""
    return df.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.greatest(F.avg("z"), F.lit(LEAST_HEIGHT)).alias("cz"))


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """centroid with `spread`, the largest distance from it, and the camera `distance`."""
    w = Window.partitionBy(*keys)
    at = df.withColumns({"cx": F.avg("x").over(w), "cy": F.avg("y").over(w), "cz": F.greatest(F.avg("z").over(w), F.lit(LEAST_HEIGHT))})
    dx, dy, dz = (F.col(a) - F.col(f"c{a}") for a in "xyz")
    far = F.max(F.sqrt(dx * dx + dy * dy + dz * dz))
    out = at.groupBy(*keys, "cx", "cy", "cz").agg(far.alias("spread"))
    return out.withColumn("distance", clamp(F.col("spread") * MARGIN, NEAR, FAR))


def with_empty(found: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """spread of every one of `frames`: those without objects get the default place and distance."""
    default = dict(zip(("cx", "cy", "cz", "distance"), (*DEFAULT_LOOKAT, DEFAULT_DISTANCE), strict=True))
    return frames.join(found, keys, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in default.items()})


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, seed: Column | None = None, alpha: float = ALPHA, piece: Column | None = None) -> DataFrame:
    """(keys, n, ema): the smoothed value after the last row of each group, y = alpha x + (1 - alpha) y.

    Starts at `seed` (the group's first value if None). All rows count, whatever alpha is. A group is summed by
    pieces (`scans.pieces`), in one piece if none are given.
    """
    return scans.ema(df, keys, order, value, alpha, F.lit(0) if piece is None else piece, seed)


def azimuth(df: DataFrame, keys: list[str], order: list[str], start: float = START_AZIMUTH) -> DataFrame:
    """df with azimuth, turned by TURN_DEGREES every row."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("azimuth", F.lit(start) + F.lit(TURN_DEGREES) * k)


def track(
    frames: DataFrame, keys: list[str], order: str, azimuth_start: float = START_AZIMUTH, first_distance: float = 2.23606797749979, follow: bool = True, alpha: float = ALPHA, piece: Column | None = None
) -> DataFrame:
    """Camera of each frame: lookat x, y, z and distance smoothed over the frames before, azimuth, elevation.

    frames has cx, cy, cz and distance of each frame. The first lookat is taken as it is,
    the distance is smoothed from its initial setting. With follow=False the camera stays
    where it was set and no rows are given. Runs are smoothed by pieces (`scans.pieces`), in one piece if none are given.
    """
    names = ("lookat_x", "lookat_y", "lookat_z", "distance")
    if not follow:
        return frames.limit(0).select(*keys, order, *(F.lit(0.0).alias(c) for c in (*names, "azimuth", "elevation")))
    values = {c: (name, first_distance if c == "distance" else None) for c, name in zip(("cx", "cy", "cz", "distance"), names, strict=True)}
    each = scans.smoothed(frames, keys, [order], values, alpha, F.lit(0) if piece is None else piece, "_k")
    return each.select(*keys, order, *names, (F.lit(azimuth_start) + F.lit(TURN_DEGREES) * F.col("_k")).alias("azimuth"), F.lit(ELEVATION).alias("elevation"))


def tracks(frames: DataFrame, runs: DataFrame, keys: list[str], order: str, alpha: float = ALPHA, piece: Column | None = None) -> DataFrame:
    """Camera of each frame of all runs, each with its own settings; columns as of `track`.

    runs has a row a run: keys, mode, lookat (an array), distance, azimuth, elevation. With mode 1 the camera follows the bodies:
    its distance is smoothed and its azimuth turned from where they are set; with another mode it stays as set in every frame.
    """
    each = frames.join(runs.select(*keys, "mode", F.col("lookat").alias("_lookat"), F.col("distance").alias("_distance"), F.col("azimuth").alias("_azimuth"), F.col("elevation").alias("_elevation")), keys)
    moving, still = each.where("mode = 1"), each.where("mode <> 1 OR mode IS NULL")
    names = ("lookat_x", "lookat_y", "lookat_z", "distance")
    values = {c: (name, "_distance" if c == "distance" else None) for c, name in zip(("cx", "cy", "cz", "distance"), names, strict=True)}
    smooth = scans.smoothed(moving, keys, [order], values, alpha, F.lit(0) if piece is None else piece, "_k").join(runs.select(*keys, F.col("azimuth").alias("_azimuth")), keys)
    turned = smooth.select(*keys, order, *names, (F.col("_azimuth") + F.lit(TURN_DEGREES) * F.col("_k")).alias("azimuth"), F.lit(ELEVATION).alias("elevation"))
    stays = [F.get("_lookat", F.lit(i)).alias(c) for i, c in enumerate(names[:3])]
    return turned.unionByName(still.select(*keys, order, *stays, F.col("_distance").alias("distance"), F.col("_azimuth").alias("azimuth"), F.col("_elevation").alias("elevation")))
