"""Masks as runs: (frame_idx, geom_id, y, x0, x1), the columns x0 to x1 (both inclusive) of a row.

A run stands for all its pixels, so tables shrink by the mean length of runs. Runs of a mask are
maximal: no two of them overlap or touch in a row. Counts, boxes, union and intersection need the runs alone.

Contours are found tile by tile: a tile is a band of rows of one body in one frame. Parts
of a tile that meet over its edge are united as a graph; a body's border, not its
pixels, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.operators import vision
from kinelake.sources.scratch import cut

#: What tells masks apart, and rows of a tile.
KEYS = ("frame_idx", "geom_id")
BAND = 256


def _merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of spans (keys, y, x0, x1) that may overlap, touch or repeat."""
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reached = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("_new", F.when(reached >= F.col("x0") - 1, 0).otherwise(1))
    numbered = begins.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def runs(pixels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Runs of pixels (keys, y, x); a pixel given twice counts once. The keys and the row bound what a task sorts."""
    return _merged(pixels.select(*keys, "y", F.col("x").alias("x0"), F.col("x").alias("x1")), list(keys))


def pixels(masks: DataFrame) -> DataFrame:
    """The inverse of `runs`."""
    rest = [c for c in masks.columns if c not in ("x0", "x1")]
    return masks.select(*rest, F.explode(F.sequence("x0", "x1")).alias("x"))


def length() -> Column:
    return F.col("x1") - F.col("x0") + 1


def areas(masks: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, pixels, x0, y0, x1, y1): pixels and box of each mask, x1 and y1 exclusive."""
    box = F.min("x0").alias("x0"), F.min("y").alias("y0"), (F.max("x1") + 1).alias("x1"), (F.max("y") + 1).alias("y1")
    return masks.groupBy(*keys).agg(F.sum(length()).cast("long").alias("pixels"), *box)


def union(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Runs of the pixels that are in a or b."""
    columns = [*keys, "y", "x0", "x1"]
    return _merged(a.select(columns).unionAll(b.select(columns)), list(keys))


def _with(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables of runs (or of what grows with them), both shuffled: exploded pixels are estimated at their source's size, so one side would be sent through the driver."""
    return left.join(right.hint("merge"), on, how)


def intersection(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Runs of the pixels that are in both: runs of the same row that overlap, cut to what they share."""
    right = b.select(*keys, "y", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    met = _with(a, right, [*keys, "y"]).where("x0 <= _x1 AND x1 >= _x0")
    return met.select(*keys, "y", F.greatest("x0", "_x0").alias("x0"), F.least("x1", "_x1").alias("x1"))


def overlap(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, pixels_a, pixels_b, common, iou) of masks that a and b have: the share of common pixels in all of theirs.

    The runs of both meet in their row once, without a join: what a run adds to those before it is new, and common pixels are those counted twice.
    """
    zero = F.lit(0).cast("long")
    sides = [m.select(*keys, "y", "x0", "x1", *(F.when(F.lit(own), length()).otherwise(zero).alias(c) for c, own in (("pixels_a", one), ("pixels_b", not one)))) for m, one in ((a, True), (b, False))]
    both = sides[0].unionAll(sides[1]).where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(zero, F.col("x1") - F.greatest(F.col("x0") - 1, F.max("x1").over(w)))  # greatest skips the NULL of a row's first run
    sums = [F.sum(c).cast("long").alias(c) for c in ("pixels_a", "pixels_b")]
    sized = both.withColumn("_new", new).groupBy(*keys).agg(*sums, F.sum("_new").cast("long").alias("_all")).where("pixels_a > 0 AND pixels_b > 0")
    common = F.col("pixels_a") + F.col("pixels_b") - F.col("_all")
    return sized.select(*keys, "pixels_a", "pixels_b", common.alias("common"), (common / F.col("_all")).alias("iou"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of links (a, b), of any type that has an order: the least node reachable, for nodes that are not that themselves (actions).

    Every round links each node's larger neighbours to its least one, then the smaller ones; links are written after each.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, before = cut(ends), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = cut(_with(both.where("y > x"), low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())


def parts(masks: DataFrame, band: int = BAND) -> DataFrame:
    """(frame_idx, geom_id, y, x0, x1, part, edge): runs with the part of their tile, and their border columns.

    A part is a set of runs of a tile that touch (diagonally too), named by its first run's (y, x). A pixel is of the border if one
    of its four neighbours is not of the body; rows beside a tile's edge are given to it to look at.
    """
    import pandas as pd

    tile = F.floor(F.col("y") / band).cast("long")
    beside = F.when(F.pmod("y", F.lit(band)) == 0, tile - 1), F.when(F.pmod("y", F.lit(band)) == band - 1, tile + 1)
    own = masks.select(*KEYS, "y", "x0", "x1", F.explode(F.array_compact(F.array(tile, *beside))).alias("_tile"), tile.alias("_home"))

    def label(batches):
        import numpy as np

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                y, left, right, home = (np.asarray(x) for x in (r.ys, r.lefts, r.rights, r.homes))
                size = right - left + 1
                ends = np.cumsum(size)
                at = np.repeat(np.arange(len(y)), size)
                x = np.arange(len(at)) - np.repeat(ends - size, size) + left[at]
                edge = vision.border(y[at].astype(np.int64), x.astype(np.int64))
                cells = [x[a:b][edge[a:b]].tolist() for a, b, h in zip(ends - size, ends, home, strict=True) if h]
                y, left, right = (v[home].astype(np.int64) for v in (y, left, right))
                first = vision.touching(y, left - left.min(initial=0), right - left.min(initial=0), 1)
                out += zip([r.frame_idx] * len(y), [r.geom_id] * len(y), y.tolist(), left.tolist(), right.tolist(), y[first].tolist(), left[first].tolist(), cells, strict=True)
            yield pd.DataFrame(out, columns=["frame_idx", "geom_id", "y", "x0", "x1", "part_y", "part_x", "edge"], dtype=object)

    listed = F.array_sort(F.collect_list(F.struct("y", "x0", "x1", (F.col("_home") == F.col("_tile")).alias("home"))))
    tiles = own.groupBy(*KEYS, "_tile").agg(listed.alias("_r")).select(*KEYS, *(F.col("_r")[c].alias(name) for c, name in (("y", "ys"), ("x0", "lefts"), ("x1", "rights"), ("home", "homes"))))
    found = tiles.mapInPandas(label, "frame_idx long, geom_id int, y int, x0 int, x1 int, part_y int, part_x int, edge array<int>")
    return found.select(*KEYS, "y", "x0", "x1", F.struct(*KEYS, F.col("part_y").alias("y"), F.col("part_x").alias("x")).alias("part"), "edge")


def bodies(masks: DataFrame, band: int = BAND) -> DataFrame:
    """(frame_idx, geom_id, y, x0, x1, body, edge): runs with the connected set they belong to, named by its first run (actions)."""
    tiled = cut(parts(masks, band))
    at = F.pmod("y", F.lit(band))
    above = tiled.where(at == band - 1).select(*KEYS, (F.col("y") + 1).alias("y"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("part").alias("a"))
    seams = _with(tiled.where(at == 0), above, [*KEYS, "y"]).where("x0 <= _x1 + 1 AND x1 >= _x0 - 1").select("a", F.col("part").alias("b"))
    joined = _with(tiled, connected(seams), F.col("part") == F.col("node"), "left")
    return joined.select(*KEYS, "y", "x0", "x1", F.coalesce("root", "part").alias("body"), "edge")


def contours(masks: DataFrame, least: float = vision.LEAST_AREA, band: int = BAND) -> DataFrame:
    """The outer contours that `vision.contours` gives for the pixels of runs, found by tiles of `band` rows (actions).

    One task holds the rows of one body in one band, then the border pixels of one connected set.
    """
    import pandas as pd

    schema = "frame_idx long, geom_id int, y int, x int, x0 int, y0 int, x1 int, y1 int, area double, points array<array<int>>"

    def trace(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                cells = {(int(y), x) for y, edge in zip(r.ys, r.edges, strict=True) for x in map(int, edge)}
                start, path, area = vision.traced(cells)
                y, x = [c[0] for c in cells], [c[1] for c in cells]
                out.append((r.frame_idx, r.geom_id, *start, min(x), min(y), max(x) + 1, max(y) + 1, area, path))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)

    found = bodies(masks.where(F.col("geom_id") != vision.FLOOR), band).where(F.size("edge") > 0)
    borders = found.groupBy("body").agg(F.collect_list(F.struct("y", "edge")).alias("_r")).select("body.frame_idx", "body.geom_id", F.col("_r")["y"].alias("ys"), F.col("_r")["edge"].alias("edges"))
    each = borders.mapInPandas(trace, schema).where(F.col("area") > least)
    order = F.row_number().over(Window.partitionBy(*KEYS).orderBy("y", "x")) - 1
    return each.select(*KEYS, order.alias("contour_idx"), "x0", "y0", "x1", "y1", "area", F.lit(False).alias("hole"), "points")
