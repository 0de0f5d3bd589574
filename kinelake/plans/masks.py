"""Queries on masks as runs, over the raster of discs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions import vec
from kinelake.operators import masks
from kinelake.plans.views import ORACLE as VIEWS, RASTER_SQL, raster


def run_masks(spark, sf_dir):
    """Pixels and box of each id in each frame, from runs."""
    return masks.areas(masks.runs(raster(spark, sf_dir))).select("frame_idx", "geom_id", "pixels", "x0", "y0", "x1", "y1")


def run_counts(spark, sf_dir):
    """Runs and pixels of each frame."""
    return masks.runs(raster(spark, sf_dir)).groupBy("frame_idx").agg(F.count(F.lit(1)).alias("runs"), F.sum(masks.length()).cast("long").alias("pixels"))


def mask_overlap(spark, sf_dir):
    """How much of an id's mask stays in the next frame."""
    now = masks.runs(raster(spark, sf_dir))
    return masks.overlap(now, now.withColumn("frame_idx", F.col("frame_idx") - 1)).withColumn("iou", vec.steady(F.col("iou")))


def mask_union(spark, sf_dir):
    """Pixels and box of an id's mask in a frame and the next one."""
    now = masks.runs(raster(spark, sf_dir))
    return masks.areas(masks.union(now, now.withColumn("frame_idx", F.col("frame_idx") - 1))).select("frame_idx", "geom_id", "pixels", "x0", "y0", "x1", "y1")


def tiled_components(spark, sf_dir):
    """Contours over 50 in area, by tiles of 250 rows; every fourth edge goes through the middle of a disc."""
    return masks.contours(masks.runs(raster(spark, sf_dir)), band=250).select("frame_idx", "geom_id", "x0", "y0", "x1", "y1", "area")


QUERIES = {f.__name__: f for f in (run_masks, run_counts, mask_overlap, mask_union, tiled_components)}

_BOX = "count(*) AS pixels, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1"
ORACLE = {
    "run_masks": f"WITH {RASTER_SQL} SELECT frame_idx, geom_id, {_BOX} FROM x GROUP BY ALL",
    "run_counts": f"""WITH {RASTER_SQL}, l AS (SELECT *, lag(x) OVER (PARTITION BY frame_idx, geom_id, y ORDER BY x) AS before FROM x)
        SELECT frame_idx, count(*) FILTER (before IS NULL OR before < x - 1) AS runs, count(*) AS pixels FROM l GROUP BY frame_idx""",
    "mask_overlap": f"""WITH {RASTER_SQL}, n AS (SELECT frame_idx, geom_id, count(*) AS k FROM x GROUP BY ALL),
        c AS (SELECT a.frame_idx, a.geom_id, count(*) AS common FROM x a JOIN x b ON b.frame_idx = a.frame_idx + 1 AND a.geom_id = b.geom_id AND a.y = b.y AND a.x = b.x GROUP BY ALL),
        j AS (SELECT a.frame_idx, a.geom_id, a.k AS pixels_a, b.k AS pixels_b, coalesce(c.common, 0) AS common FROM n a JOIN n b ON b.frame_idx = a.frame_idx + 1 AND a.geom_id = b.geom_id
              LEFT JOIN c ON c.frame_idx = a.frame_idx AND c.geom_id = a.geom_id)
        SELECT *, floor(common::DOUBLE / (pixels_a + pixels_b - common) * 1000000.0 + 0.5) / 1000000.0 AS iou FROM j""",
    "mask_union": f"""WITH {RASTER_SQL}, u AS (SELECT frame_idx, geom_id, y, x FROM x UNION SELECT frame_idx - 1, geom_id, y, x FROM x)
        SELECT frame_idx, geom_id, {_BOX} FROM u GROUP BY ALL""",
    "tiled_components": VIEWS["components"],
}
