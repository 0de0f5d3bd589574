"""Frame rows of videos. Decoding is left to others: a video is a row (keys, fps, n_frames), given or read from its header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frames(videos: DataFrame, keys: list[str]) -> DataFrame:
    """One row a frame: keys, frame_idx from 0, and its time by the whole-numbered frame rate.

    A video without frames, or with a rate under one, gives none.
    """
    whole = videos.withColumn("_fps", F.col("fps").cast("int")).where((F.col("_fps") > 0) & (F.col("n_frames") > 0))
    each = whole.select(*keys, "_fps", F.explode(F.sequence(F.lit(0), F.col("n_frames").cast("int") - 1)).alias("frame_idx"))
    return each.select(*keys, F.col("frame_idx").cast("long").alias("frame_idx"), (F.col("frame_idx") / F.col("_fps")).alias("time"))


HEADERS = "path string, fps double, n_frames long, problem string"
#: Bytes of a video's index (its `moov` box) that are read at most; longer ones are reported.
LONGEST_INDEX = 1 << 28


def _boxes(data: bytes, start: int, stop: int):
    """(kind, first, end) of the boxes that lie side by side in data[start:stop]."""
    import struct

    while start + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, start)
        first = start + 8
        if size == 1:
            if first + 8 > stop:
                raise ValueError("truncated")
            (size,) = struct.unpack_from(">Q", data, first)
            first += 8
        end = stop if size == 0 else start + size
        if end < first or end > stop:
            raise ValueError("truncated")
        yield kind, first, end
        start = end


def _inner(data: bytes, start: int, stop: int, *kinds: bytes):
    """(first, end) of every box reached through these kinds."""
    for kind, first, end in _boxes(data, start, stop):
        if kind == kinds[0]:
            if len(kinds) == 1:
                yield first, end
            else:
                yield from _inner(data, first, end, *kinds[1:])


def _track(data: bytes, start: int, stop: int) -> tuple[float, int] | None:
    """(fps, n_frames) of a track's index, None if it is no video's."""
    import struct

    handler = next(_inner(data, start, stop, b"mdia", b"hdlr"), None)
    if handler is None or data[handler[0] + 8 : handler[0] + 12] != b"vide":
        return None
    (head, _), (times, end) = (next(_inner(data, start, stop, *way), (None, 0)) for way in ((b"mdia", b"mdhd"), (b"mdia", b"minf", b"stbl", b"stts")))
    if head is None or times is None:
        raise ValueError("no times")
    scale, _ = struct.unpack_from(">IQ", data, head + 20) if data[head] else struct.unpack_from(">II", data, head + 12)
    (entries,) = struct.unpack_from(">I", data, times + 4)
    if times + 8 + 8 * entries > end:
        raise ValueError("truncated")
    n, ticks = 0, 0
    for k in range(entries):
        count, each = struct.unpack_from(">II", data, times + 8 + 8 * k)
        n, ticks = n + count, ticks + count * each
    return (scale * n / ticks if ticks else 0.0), n


def header(file, size: int) -> tuple[float, int]:
    """(fps, n_frames) of the first video track of an open file: only box heads and the index are read, wherever it stands."""
    import struct

    at = 0
    while at + 8 <= size:
        file.seek(at)
        head = file.read(16)
        length, kind = struct.unpack_from(">I4s", head)
        first = 16 if length == 1 else 8
        if length == 1:
            if len(head) < 16:
                break
            (length,) = struct.unpack_from(">Q", head, 8)
        end = size if length == 0 else at + length
        if end < at + first or end > size:
            raise ValueError("truncated")
        if kind == b"moov":
            if end - at > LONGEST_INDEX:
                raise ValueError("index too long")
            file.seek(at + first)
            data = file.read(end - at - first)
            for start, stop in _inner(data, 0, len(data), b"trak"):
                if found := _track(data, start, stop):
                    return found
            raise ValueError("no video track")
        at = end
    raise ValueError("no index" if at == size else "truncated")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, fps, n_frames, problem) of the videos under path (ISO base media files), from their headers.

    Files are listed by Spark, without their contents; each task opens its own and reads their indices. fps is frames by the
    time they take. A file without a readable index has NULLs and says why; Spark lists no empty files. Paths are read through pyarrow's file systems.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def run(batches):
        import struct
        from urllib.parse import quote

        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            rows = []
            for name, size in zip(batch["path"], batch["length"], strict=True):
                try:
                    local = name.startswith("file:")
                    store, at = (fs.LocalFileSystem(), "/" + name.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(quote(name, safe="/:@?=&+%"))
                    with store.open_input_file(at) as file:
                        rows.append((name, *header(file, size), None))
                except (ValueError, struct.error, IndexError) as e:
                    rows.append((name, None, None, "truncated" if not isinstance(e, ValueError) else str(e)))
            yield pd.DataFrame(rows, columns=["path", "fps", "n_frames", "problem"]).astype({"fps": "float64", "n_frames": "Int64"})

    return files.repartition("path").mapInPandas(run, HEADERS)
