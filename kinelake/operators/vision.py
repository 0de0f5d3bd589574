"""Segmentation rasters: ids, contours, boxes, mask colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Contours up to this area are noise; the background and floor id.
LEAST_AREA = 50.0
FLOOR = 0
CONTOUR_SCHEMA = "frame_idx long, geom_id int, contour_idx int, x0 int, y0 int, x1 int, y1 int, area double, hole boolean, points array<array<int>>"


def distinct_ids(pixels: DataFrame, frame: str = "frame_idx") -> DataFrame:
    return pixels.select(frame, "geom_id").distinct()


def boxes(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Integer box of each group of points: x0, y0 inclusive, x1, y1 exclusive."""
    return points.groupBy(*keys).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), (F.max(x) + 1).alias("x1"), (F.max(y) + 1).alias("y1"))


def largest_box(found: DataFrame, keys: list[str], index: str, area: Column, least: float = LEAST_AREA) -> DataFrame:
    """Of each group's boxes over the least area, the largest; the lowest index wins ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_area"), F.asc(index))
    ranked = found.withColumn("_area", area).where(F.col("_area") > least).withColumn("_r", F.row_number().over(w))
    return ranked.where("_r = 1").drop("_r", "_area")


def mask_color(geom_id: Column) -> Column:
    """Deterministic (r, g, b) of an id, each 0-254; black for the floor."""
    h = F.md5(geom_id.cast("string").cast("binary"))
    part = lambda k: (F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") % 255).cast("int")
    return F.when(geom_id == FLOOR, F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(F.array(part(0), part(1), part(2)))


def remembered_color(known: Column, geom_id: Column) -> Column:
    """The colour an id already has, else its own."""
    return F.coalesce(known, mask_color(geom_id))


_STEPS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # clockwise from the right, as (dy, dx)


def _outline(cells: set[tuple[int, int]], start: tuple[int, int]) -> list[tuple[int, int]]:
    """Outer border of an 8-connected set, walked once around from its topmost, then leftmost cell."""
    path, at, heading = [start], start, 0
    first = None
    while True:
        for k in range(8):
            turn = (heading + 6 + k) % 8  # begins two steps back from where it came
            step = (at[0] + _STEPS[turn][0], at[1] + _STEPS[turn][1])
            if step in cells:
                break
        else:
            return path
        if at == start and first == turn:
            return path[:-1]
        first = turn if first is None else first
        at, heading = step, turn
        path.append(at)


def _simple(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The corners of a border: points between two equal steps are left out."""
    if len(path) < 3:
        return path
    step = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(path, path[1:] + path[:1], strict=True)]
    return [p for p, before, after in zip(path, step[-1:] + step[:-1], step, strict=True) if before != after]


def traced(cells: set[tuple[int, int]]):
    """First cell, corner points (x, y) and polygon area of the outer border of a connected set."""
    start = min(cells)
    path = _outline(cells, start)
    area = abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(path, path[1:] + path[:1], strict=True))) / 2
    return start, [[c[1], c[0]] for c in _simple(path)], area


def _runs(y, x):
    """Row, first and last column of each horizontal run of pixels sorted by (y, x)."""
    import numpy as np

    first = np.flatnonzero(np.concatenate([[True], (np.diff(y) != 0) | (np.diff(x) > 1)]))
    last = np.append(first[1:], len(y)) - 1
    return y[first], x[first], x[last]


def touching(row, left, right, reach: int):
    """For each run (sorted by row, then left) the first of the runs that it is connected to: reach 1 counts diagonal neighbours, 0 does not."""
    import numpy as np

    parent = np.arange(len(row))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    start = np.searchsorted(row, row - 1, side="left")
    end = np.searchsorted(row, row - 1, side="right")
    width = int(max(right.max(initial=0), 0)) + 4
    # Within the row above, the runs that reach from left - reach to right + reach.
    key_right, key_left = row * width + right, row * width + left
    low = np.clip(np.searchsorted(key_right, (row - 1) * width + left - reach, side="left"), start, end)
    high = np.clip(np.searchsorted(key_left, (row - 1) * width + right + reach, side="right"), start, end)
    for i in np.flatnonzero(high > low).tolist():
        for j in range(low[i], high[i]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(row))], np.int64)


def _parts(cells, reach: int):
    """Connected sets of the pixels (arrays y, x), each as arrays, by their topmost, then leftmost pixel."""
    import numpy as np

    y, x = cells
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    row, left, right = _runs(y, x)
    label = np.repeat(touching(row, left, right, reach), right - left + 1)
    by = np.argsort(label, kind="stable")
    edges = np.flatnonzero(np.diff(label[by])) + 1
    for own in np.split(by, edges) if len(by) else ():
        yield y[own], x[own]


def _enclosed(y, x):
    """Holes of a connected set: background within its box that no side reaches, in 4-connected sets."""
    import numpy as np

    top, side = y.min(), x.min()
    grid = np.ones((y.max() - top + 3, x.max() - side + 3), bool)
    grid[y - top + 1, x - side + 1] = False
    gy, gx = np.nonzero(grid)
    for hy, hx in _parts((gy, gx), 0):
        if hy.min() > 0:  # the part outside holds the frame of the box
            yield hy + top - 1, hx + side - 1


def contours(pixels: DataFrame, least: float = LEAST_AREA, holes: bool = False) -> DataFrame:
    """Contours of each id in each frame: boxes, polygon areas through pixel centres, corner points (x, y).

    pixels has (frame_idx, geom_id, y, x). The floor is skipped and contours up to the
    least area are dropped. holes: also the borders of holes, through the pixels around them
    (they lie inside their outer box, so the largest box does not change). One task holds
    the pixels of one body in one frame; Python steps along borders only. Pixels are dealt as
    words of 64 columns of a row, one bit each, not as rows; those without x or y are left out.
    """

    def trace(pdf):
        import numpy as np
        import pandas as pd

        frame, geom = int(pdf["frame_idx"].iloc[0]), int(pdf["geom_id"].iloc[0])
        bits = pdf["bits"].to_numpy("<i8").view(np.uint8).reshape(-1, 8)
        word, bit = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
        ys, xs = pdf["y"].to_numpy(np.int64)[word], pdf["word"].to_numpy(np.int64)[word] * 64 + bit
        rows = []

        def add(y, x, hole):
            _, points, area = traced(set(zip(y.tolist(), x.tolist(), strict=True)))
            if area > least:
                rows.append((frame, geom, len(rows), int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1, area, hole, points))

        for y, x in _parts((ys, xs), 1):
            edge = border(y, x)
            add(y[edge], x[edge], False)
            for hy, hx in _enclosed(y, x) if holes else ():
                around = {(a + dy, b + dx) for a, b in zip(hy.tolist(), hx.tolist(), strict=True) for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))}
                cells = np.array(sorted(around))
                add(cells[:, 0], cells[:, 1], True)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CONTOUR_SCHEMA.split(", ")])

    placed = pixels.where((F.col("geom_id") != FLOOR) & F.col("x").isNotNull() & F.col("y").isNotNull())
    words = placed.groupBy("frame_idx", "geom_id", "y", F.shiftright("x", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(x, 64) AS int))")).alias("bits"))
    return words.groupBy("frame_idx", "geom_id").applyInPandas(trace, CONTOUR_SCHEMA)


def border(y, x):
    """Which pixels of a set have a neighbour (of four) outside it; a border is walked along these alone."""
    import numpy as np

    width = int(x.max() - x.min()) + 3
    key = (y - y.min() + 1) * width + (x - x.min() + 1)
    every = np.sort(key)
    inside = np.ones(len(key), bool)
    for step in (1, -1, width, -width):
        place = np.minimum(np.searchsorted(every, key + step), len(every) - 1)
        inside &= every[place] == key + step
    return ~inside
