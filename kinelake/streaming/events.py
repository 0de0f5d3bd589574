"""Frames of streams whose rows come out of order: state by event time.

Each key holds its rows until the watermark has passed them, then handles them in the order of
time, so that micro-batches in any order give what the batch operators give. A key
that has been silent for `idle_ms` of event time is forgotten. Rows later than the watermark's delay
are dropped by Spark. Needs a state store with column families (RocksDB): see `STORE`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

#: What a session must set for these streams.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Ordered(StatefulProcessor):
    """Holds a key's rows (at, id, value) until the watermark, then gives the frames due among them."""

    def __init__(self, frame_us: float, seed: list[float], idle_ms: int | None):
        self.frame_us, self.seed, self.idle_ms = frame_us, seed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, id long, value array<double>")
        self.last = handle.getValueState("last", "emitted long, steps long, low long, at long, value array<double>")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(a), int(i), [float(x) for x in v]) for part in rows for a, i, v in zip(part["at"], part["id"], part["value"], strict=True)]
        held = list(self.held.get()) if self.held.exists() else []
        yield self._passed(key, held + new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, now = list(self.held.get()) if self.held.exists() else [], timerValues.getCurrentWatermarkInMs()
        if not held and self.idle_ms is not None and self.last.exists() and self.last.get()[3] // 1000 + self.idle_ms <= now:
            self.last.clear()
            yield self._frames(key, [])
        else:
            yield self._passed(key, held, now)

    def _passed(self, key, rows, watermark):
        """Handle the rows that the watermark has passed, keep the others, and be woken for the next of them."""
        rows = sorted(((int(a), int(i), list(v)) for a, i, v in rows), key=lambda r: r[:2])
        n = next((k for k, r in enumerate(rows) if r[0] // 1000 >= watermark), len(rows))
        due, kept = rows[:n], rows[n:]
        emitted, steps, low, at, value = self.last.get() if self.last.exists() else (0, 0, 0, 0, self.seed)
        out = []
        for now, i, v in due:
            if self.idle_ms is not None and steps and now - at >= 1000 * self.idle_ms:  # silent for so long, whether or not a timer has come between
                emitted, steps, low, value = 0, 0, 0, self.seed
            at, steps = now, steps + 1
            low = min(low, -(-at // self.frame_us) - steps)  # the gate: steps so far + the least slack
            if steps + low > emitted:
                out.append((i, int(emitted), v, list(value)))
                emitted, value = emitted + 1, v
        if due:
            self.last.update((int(emitted), int(steps), int(low), int(at), [float(x) for x in value]))
        if kept:
            self.held.put(kept)
            self.handle.registerTimer(kept[0][0] // 1000 + 1)
        else:
            self.held.clear()
            if self.idle_ms is not None and self.last.exists():
                if at // 1000 + self.idle_ms < watermark:
                    self.last.clear()
                else:
                    self.handle.registerTimer(at // 1000 + self.idle_ms)
        return self._frames(key, out)

    def _frames(self, key, out):
        import pandas as pd

        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = {"id": "int64", "frame_idx": "int64", "value": object, "value_prev": object}  # an empty list would become a column of numbers
        return pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype=object)} | {c: pd.Series(list(x), dtype=t) for (c, t), x in zip(kinds.items(), columns, strict=True)})


def gated(stream: DataFrame, frame_us: float, delay: str, seed: list[float], key: str = "user_id", time: str = "ts", row_id: str = "event_id", value: str = "value", idle_ms: int | None = None) -> DataFrame:
    """(key, row_id, frame_idx, value, value_prev) of a stream with a timestamp: the frames of operators.frames.frame_gate in the order of time.

    value is an array of numbers (a velocity); value_prev is that of the frame before, `seed` for a key's first frame. A frame is due
    each frame_us microseconds since the epoch began (1970). Rows come up to `delay` out of order, in any micro-batch; a frame is given
    when the watermark has passed its row. idle_ms: forget a key this long (of event time) after its last row; None keeps all.
    """
    kinds = dict(stream.dtypes)
    rows = stream.withWatermark(time, delay).select(F.col(key).alias("key"), F.unix_micros(F.col(time)).alias("at"), F.col(row_id).cast("long").alias("id"), F.col(value).cast("array<double>").alias("value"), time)
    output = _parse_datatype_string(f"key {kinds[key]}, id long, frame_idx long, value array<double>, value_prev array<double>")
    found = rows.groupBy("key").transformWithStateInPandas(Ordered(frame_us, list(seed), idle_ms), output, "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.col("id").alias(row_id), "frame_idx", "value", "value_prev")
