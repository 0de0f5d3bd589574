"""Frame gate previous-frame value, camera and colours on a stream: one state a body or run.

Rows of a key must arrive in time order between micro-batches, as a stepping simulation
gives them; within one they are sorted here. The emitted frames are those of
operators.frames.frame_gate followed by lag_seeded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinelake.operators import camera
from kinelake.operators.vision import remembered_color

STATE = "emitted long, previous double"


def _timed(stream: DataFrame, key: str, step, output: str, kept: str, expire_ms: int | None) -> DataFrame:
    """step over each key's new rows, with a state that is forgotten expire_ms after its last row (None: never)."""
    import pandas as pd

    names = [c.split()[0] for c in output.split(", ")]

    def run(of, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({c: [] for c in names})
            return
        found, now = step(of[0], pd.concat(list(batches)), state.get if state.exists else None)
        state.update(now)
        if expire_ms is not None:
            state.setTimeoutDuration(expire_ms)
        yield found[names]

    timeout = GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(key).applyInPandasWithState(run, output, kept, "append", timeout)


def gated(stream: DataFrame, frame_us: float, seed: float = 0.0, key: str = "user_id", expire_ms: int | None = None) -> DataFrame:
    """Frames of a stream (key, event_id, us, value): key, event_id, frame_idx, value, value_prev, in append mode."""

    def step(of, rows, before):
        import numpy as np

        emitted, previous = before or (0, seed)
        rows = rows.sort_values(["us", "event_id"])
        due, k = np.ceil(rows["us"].to_numpy() / frame_us).astype(np.int64), np.arange(1, len(rows) + 1)
        count = k + np.minimum(np.minimum.accumulate(due - k), emitted)  # the gate in closed form
        count = np.maximum(count, emitted)
        out = rows[np.diff(count, prepend=emitted) > 0].copy()
        out["frame_idx"] = emitted + np.arange(len(out))
        out["value_prev"] = np.concatenate([[previous], out["value"].to_numpy()[:-1]])[: len(out)]
        out[key] = of
        return out, (emitted + len(out), float(out["value"].iloc[-1]) if len(out) else previous)

    return _timed(stream, key, step, f"{key} long, event_id long, frame_idx long, value double, value_prev double", STATE, expire_ms)


def tracked(stream: DataFrame, key: str = "run_id", settings: camera.Settings | None = None, expire_ms: int | None = None) -> DataFrame:
    """Camera of each frame of a stream (key, frame_idx, cx, cy, cz, distance): that of operators.camera.track."""
    settings = settings or camera.Settings(mode=1)
    alpha, turn, elevation = camera.ALPHA, camera.TURN_DEGREES, camera.ELEVATION

    def step(of, rows, before):
        rows = rows.sort_values("frame_idx").reset_index(drop=True)
        x, y, z, far, n = before or (0.0, 0.0, 0.0, settings.distance, 0)
        out = []
        for r in rows.itertuples():  # each frame depends on the one before
            x, y, z = (r.cx, r.cy, r.cz) if n == 0 else (alpha * r.cx + (1 - alpha) * x, alpha * r.cy + (1 - alpha) * y, alpha * r.cz + (1 - alpha) * z)
            far, n = alpha * r.distance + (1 - alpha) * far, n + 1
            out.append((x, y, z, far, settings.azimuth + turn * n))
        rows[["lookat_x", "lookat_y", "lookat_z", "distance", "azimuth"]] = out
        rows["elevation"], rows[key] = elevation, of
        return rows, (x, y, z, far, n)

    output = f"{key} long, frame_idx long, lookat_x double, lookat_y double, lookat_z double, distance double, azimuth double, elevation double"
    return _timed(stream, key, step, output, "x double, y double, z double, far double, n long", expire_ms)


def colored(stream: DataFrame, known: DataFrame) -> DataFrame:
    """A stream with geom_id and the colour each id has: of the table known (geom_id, color) or else its own."""
    held = known.select("geom_id", F.col("color").alias("_known"))
    return stream.join(held, "geom_id", "left").withColumn("color", remembered_color(F.col("_known"), F.col("geom_id"))).drop("_known")


def distinct_pairs(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Each unordered pair of (frame_idx, g1, g2) once, forgetting frames older than the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["frame_idx", "g1", "g2"])
