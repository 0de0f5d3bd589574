"""Masks as runs against their pixels, and contours by tiles against whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from kinelake.operators import masks, vision

PIXEL = "frame_idx long, geom_id int, y int, x int"


def blobs(seed):
    """Pixel sets of three frames and ids: noise, lines, a ring, a spiral over many rows, a long diagonal; pixels given twice."""
    rng = random.Random(seed)
    cells = set()
    for frame in range(3):
        for _ in range(500):
            cells.add((frame, rng.randrange(3), rng.randrange(-9, 40), rng.randrange(30)))
        for k in range(60):
            cells |= {(frame, 3, k, k), (frame, 4, k, 2), (frame, 4, k, 9), (frame, 4, 59, 2 + k % 8)}
        for y in range(30):
            for x in range(30):
                d = (y - 15) ** 2 + (x - 15) ** 2
                if 60 <= d <= 200:
                    cells.add((frame, 5, y, x))
                if y % 4 == 0 or x == (29 if y % 8 < 4 else 0):
                    cells.add((frame, 6, y, x))
    return sorted(cells)


@pytest.fixture(scope="module")
def two(spark):
    a, b = blobs(1), blobs(2)
    return (set(a), spark.createDataFrame(a + a[::7], PIXEL).cache()), (set(b), spark.createDataFrame(b, PIXEL).cache())


def cells_of(df):
    rows = [tuple(r) for r in masks.pixels(df).select("frame_idx", "geom_id", "y", "x").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_runs_are_the_pixels(two):
    (cells, df), _ = two
    runs = masks.runs(df).cache()
    assert cells_of(runs) == cells
    ends = {(r["frame_idx"], r["geom_id"], r["y"], x) for r in runs.collect() for x in (r["x0"] - 1, r["x1"] + 1)}
    assert not ends & cells  # maximal
    assert runs.count() < len(cells) / 1.5


def test_counts_and_boxes(two):
    (cells, df), _ = two
    got = {(r["frame_idx"], r["geom_id"]): tuple(r)[2:] for r in masks.areas(masks.runs(df)).collect()}
    for key in {c[:2] for c in cells}:
        own = [c for c in cells if c[:2] == key]
        y, x = [c[2] for c in own], [c[3] for c in own]
        assert got[key] == (len(own), min(x), min(y), max(x) + 1, max(y) + 1)
    boxes = vision.boxes(df, ["frame_idx", "geom_id"])
    assert {tuple(r)[:2]: tuple(r)[2:] for r in boxes.collect()} == {k: v[1:] for k, v in got.items()}


def test_union_and_intersection(two):
    (a, da), (b, db) = two
    ra, rb = masks.runs(da), masks.runs(db)
    assert cells_of(masks.union(ra, rb)) == a | b
    assert cells_of(masks.intersection(ra, rb)) == a & b
    for r in masks.overlap(ra, rb).collect():
        own = [{c for c in s if c[:2] == (r["frame_idx"], r["geom_id"])} for s in (a, b)]
        assert (r["pixels_a"], r["pixels_b"], r["common"]) == (len(own[0]), len(own[1]), len(own[0] & own[1]))
        assert r["iou"] == len(own[0] & own[1]) / len(own[0] | own[1])


def test_masks_of_nothing(spark):
    none = masks.runs(spark.createDataFrame([], PIXEL))
    assert masks.areas(none).count() == masks.union(none, none).count() == masks.contours(none).count() == 0


@pytest.mark.parametrize("band", [1, 7, 1000])
def test_contours_by_tiles(two, band):
    """The same contours, in the same order, wherever tiles are cut: bodies over many tiles, two parts that meet far below."""
    (_, df), _ = two
    columns = ["frame_idx", "geom_id", "contour_idx", "x0", "y0", "x1", "y1", "area", "hole", "points"]
    for least in (0.0, 50.0):
        want = vision.contours(df, least).select(columns).collect()
        got = masks.contours(masks.runs(df), least, band).select(columns).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) >= 3


def test_connected_sets(spark):
    rng = random.Random(7)
    links = [(k, k + 1) for k in range(300, 400)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(5, 5), (0, 1), (1, 0)]
    parent = {x: x for e in links for x in e}
    for _ in range(400):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["root"] for r in masks.connected(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: r for x, r in parent.items() if x != r}
    assert masks.connected(spark.createDataFrame([], "a int, b int")).count() == 0


def test_many_specks(spark):
    """20,000 parts of one body take about as long as the sort of its pixels."""
    df = spark.range(20_000).select(F.lit(0).cast("long").alias("frame_idx"), F.lit(1).alias("geom_id"), (F.col("id") % 200 * 2).cast("int").alias("y"), (F.floor(F.col("id") / 200) * 2).cast("int").alias("x"))
    assert vision.contours(df, -1.0).count() == 20_000


def test_runs_do_not_pass_through_the_driver(spark):
    # Exploded pixels are estimated at their source's size: a join of runs would broadcast them.
    from kinelake.plans import masks as plans

    cells = spark.range(3).selectExpr("id AS frame_idx", "1 AS geom_id", "explode(sequence(0, 9)) AS y", "cast(id AS int) AS x")
    runs = masks.runs(cells)
    moved = masks.runs(cells.withColumn("x", F.col("x") + 1))
    for df in (plans.mask_overlap(spark, "/root/testdata/sf0.001"), masks.overlap(runs, moved), masks.intersection(runs, moved)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_contours_deal_words_of_pixels(spark):
    # Pixels as rows filled a task's memory; columns below 0 and over a word's edge, and pixels given twice, count as before.
    cells = [(0, 1, y, x) for y in range(3) for x in range(-70, 141)] + [(0, 1, 0, 5), (0, 1, 20, 63), (0, 1, 20, 64)]
    found = vision.contours(spark.createDataFrame(cells, PIXEL), least=-1.0)
    assert [(r["x0"], r["y0"], r["x1"], r["y1"], r["area"]) for r in found.orderBy("contour_idx").collect()] == [(-70, 0, 141, 3, 420.0), (63, 20, 65, 21, 0.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan[plan.index("FlatMapGroupsInPandas") :]


def test_overlap_counts_what_is_common(spark):
    a = spark.createDataFrame([(0, 1, 0, 0, 9), (0, 1, 0, 20, 29), (0, 1, 2, 0, 4), (0, 2, 0, 0, 0), (1, 1, 0, 0, 3)], "frame_idx long, geom_id int, y int, x0 int, x1 int")
    b = spark.createDataFrame([(0, 1, 0, 5, 24), (0, 1, 1, 0, 4), (0, 2, 0, 1, 1), (2, 1, 0, 0, 3)], "frame_idx long, geom_id int, y int, x0 int, x1 int")
    assert sorted(map(tuple, masks.overlap(a, b).collect())) == [(0, 1, 25, 25, 10, 0.25), (0, 2, 1, 1, 0, 0.0)]
