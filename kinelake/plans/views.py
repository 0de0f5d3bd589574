"""Queries on cameras, rasters and look-ups, over embeddings, events and the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinelake.functions import geometry, vec
from kinelake.operators import camera, overlay, vision
from kinelake.plans.motion import DAY_US, trajectory, vectors
from kinelake.sources.tables import spread, table

SCALE = 8.0


def positions(spark, sf_dir):
    return vectors(spark, sf_dir).select("label", *(((vec.at(F.col("e"), i)) * SCALE).alias(c) for i, c in enumerate("xyz")))


def camera_centroid(spark, sf_dir):
    df = camera.centroid(positions(spark, sf_dir), ["label"])
    return df.select("label", *(vec.steady(F.col(c)).alias(c) for c in ("cx", "cy", "cz")))


def camera_spread(spark, sf_dir):
    df = camera.spread(positions(spark, sf_dir), ["label"])
    return df.select("label", *(vec.steady(F.col(c)).alias(c) for c in ("spread", "distance")))


def camera_ema(spark, sf_dir):
    found = camera.ema(trajectory(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value")
    return found.select("user_id", "n", vec.steady(F.col("ema")).alias("ema"))


def camera_azimuth(spark, sf_dir):
    df = camera.azimuth(trajectory(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return df.select("user_id", "event_id", "azimuth")


def camera_track(spark, sf_dir):
    """Camera of each frame (day): bodies are users modulo 20 at (value, user, value / 9)."""
    day = F.floor(F.col("us") / DAY_US).cast("long").alias("frame_idx")
    df = trajectory(spark, sf_dir).select((F.col("user_id") % 3).alias("run_id"), day, F.col("value").alias("x"), (F.col("user_id") % 20).cast("double").alias("y"), (F.col("value") / 9.0).alias("z"))
    found = camera.track(camera.spread(df, ["run_id", "frame_idx"]), ["run_id"], "frame_idx")
    return found.select("run_id", "frame_idx", *(vec.steady(F.col(c), 4).alias(c) for c in ("lookat_x", "lookat_y", "lookat_z", "distance", "azimuth")), "elevation")


def bbox_minmax(spark, sf_dir):
    return vision.boxes(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", "l_suppkey")


def bbox_largest(spark, sf_dir):
    """Per customer the largest of the orders' boxes; customers without one have an empty box."""
    found = bbox_minmax(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    best = vision.largest_box(found, ["o_custkey"], "l_orderkey", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    everyone = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    zero = F.lit(0).cast("long")
    return everyone.join(best, "o_custkey", "left").select("o_custkey", *(F.coalesce(c, zero).alias(c) for c in ("x0", "y0", "x1", "y1")))


def shoelace_area(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", geometry.shoelace(F.col("e"), 8).alias("area"))


def raster(spark, sf_dir):
    """Pixels of discs, one for each part: 500 parts a frame, one above the other, their ids by key modulo 5."""
    discs = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", (F.col("p_size") % 9 + 3).cast("int").alias("r"))
    side = F.sequence(-F.col("r"), F.col("r"))
    cells = discs.withColumn("dy", F.explode(side)).withColumn("dx", F.explode(side)).where("dx * dx + dy * dy <= r * r")
    return cells.select(
        F.floor(F.col("p_partkey") / 500).cast("long").alias("frame_idx"), (F.col("p_partkey") % 5).cast("int").alias("geom_id"),
        (F.col("dy") + (F.col("p_partkey") % 500) * 40).cast("int").alias("y"), (F.col("dx") + 100).cast("int").alias("x"),
    )


def components(spark, sf_dir):
    """Contours over 50 in area, traced from pixels."""
    return vision.contours(raster(spark, sf_dir)).select("frame_idx", "geom_id", "x0", "y0", "x1", "y1", "area")


def raster_ids(spark, sf_dir):
    return vision.distinct_ids(raster(spark, sf_dir))


def mask_pixels(spark, sf_dir):
    """Pixels of each id."""
    return raster(spark, sf_dir).groupBy("geom_id").agg(F.count(F.lit(1)).alias("pixels"))


def color_mask_counts(spark, sf_dir):
    return mask_pixels(spark, sf_dir).select("geom_id", "pixels", *(vision.mask_color(F.col("geom_id"))[i].alias(c) for i, c in enumerate("rgb")))


def dim_lookup(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def left_default(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    everyone = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return everyone.join(urgent, "o_custkey", "left").select("o_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def annotation_full_outer(spark, sf_dir):
    left = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"), "c_name")
    right = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return left.join(right, "key", "full_outer").select("key", F.coalesce("c_name", F.lit("")).alias("name"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def positional_join(spark, sf_dir):
    """Each user's clicks with the view of the same position, if there is one."""
    def numbered(kind, name):
        w = Window.partitionBy("user_id").orderBy("event_id")
        df = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
        return df.select("user_id", (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), F.col("event_id").alias(name))

    return overlay.positional(numbered("click", "click_id"), numbered("view", "view_id"), ["user_id", "frame_idx"])


def explode_flatten(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.flatten(F.array(F.split("p_name", " "), F.split("p_type", " ")))).alias("pos", "token"))
    return tokens.select("p_partkey", F.col("pos").cast("long").alias("pos"), "token")


def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


QUERIES = {
    f.__name__: f
    for f in (
        camera_centroid, camera_spread, camera_ema, camera_azimuth, camera_track, bbox_minmax, bbox_largest, shoelace_area, components, raster_ids, mask_pixels, color_mask_counts,
        dim_lookup, left_default, annotation_full_outer, positional_join, explode_flatten, json_extract,
    )
}

_six = lambda x: f"floor(({x}) * 1000000.0 + 0.5) / 1000000.0"
_four = lambda x: f"floor(({x}) * 10000.0 + 0.5) / 10000.0"
_POSITIONS = f"""p AS (SELECT label, embedding[1]::DOUBLE * {SCALE} AS x, embedding[2]::DOUBLE * {SCALE} AS y, embedding[3]::DOUBLE * {SCALE} AS z FROM embeddings),
c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, greatest(avg(z), 0.5) AS cz FROM p GROUP BY label)"""
RASTER_SQL = """d AS (SELECT p_partkey, p_size % 9 + 3 AS r FROM part),
x AS (SELECT p_partkey // 500 AS frame_idx, (p_partkey % 5)::INT AS geom_id, (dy + (p_partkey % 500) * 40)::INT AS y, (dx + 100)::INT AS x, p_partkey
      FROM d, range(-11, 12) a(dx), range(-11, 12) b(dy) WHERE dx * dx + dy * dy <= r * r)"""
_BOX = "b AS (SELECT l_orderkey, min(l_partkey) AS x0, min(l_suppkey) AS y0, max(l_partkey) + 1 AS x1, max(l_suppkey) + 1 AS y1 FROM lineitem GROUP BY 1)"
_corner = lambda i: f"e[{2 * i + 1}] * e[{2 * ((i + 1) % 8) + 2}] - e[{2 * ((i + 1) % 8) + 1}] * e[{2 * i + 2}]"

ORACLE = {
    "camera_centroid": f"WITH {_POSITIONS} SELECT label, {_six('cx')} AS cx, {_six('cy')} AS cy, {_six('cz')} AS cz FROM c",
    "camera_spread": f"""WITH {_POSITIONS}, m AS (SELECT label, max(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz))) AS s FROM p JOIN c USING (label) GROUP BY label)
        SELECT label, {_six('s')} AS spread, {_six('greatest(3.0, least(6.0, s * 2.0))')} AS distance FROM m""",
    "camera_ema": f"""WITH r AS (SELECT user_id, count(*) AS n, list_reduce(list(value ORDER BY ts, event_id), lambda y, v: 0.1::DOUBLE * v + {1 - 0.1!r}::DOUBLE * y,
        first(value ORDER BY ts, event_id)) AS ema FROM events GROUP BY user_id) SELECT user_id, n, {_six('ema')} AS ema FROM r""",
    "camera_azimuth": "SELECT user_id, event_id, -90.0::DOUBLE + 0.05::DOUBLE * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS azimuth FROM events",
    "camera_track": f"""WITH RECURSIVE e AS (SELECT user_id % 3 AS run_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))::DOUBLE / {DAY_US})::BIGINT AS frame_idx,
          value AS x, (user_id % 20)::DOUBLE AS y, value / 9.0::DOUBLE AS z FROM events),
        c AS (SELECT run_id, frame_idx, avg(x) AS cx, avg(y) AS cy, greatest(avg(z), 0.5) AS cz FROM e GROUP BY ALL),
        d AS (SELECT run_id, frame_idx, cx, cy, cz, greatest(3.0, least(6.0, 2.0 * max(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))))) AS distance FROM e JOIN c USING (run_id, frame_idx) GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx) AS k FROM d),
        t AS (SELECT run_id, frame_idx, k, cx, cy, cz, 0.1::DOUBLE * distance + {1 - 0.1!r}::DOUBLE * 2.23606797749979::DOUBLE AS distance FROM n WHERE k = 1
          UNION ALL SELECT n.run_id, n.frame_idx, n.k, 0.1::DOUBLE * n.cx + {1 - 0.1!r}::DOUBLE * t.cx, 0.1::DOUBLE * n.cy + {1 - 0.1!r}::DOUBLE * t.cy, 0.1::DOUBLE * n.cz + {1 - 0.1!r}::DOUBLE * t.cz,
            0.1::DOUBLE * n.distance + {1 - 0.1!r}::DOUBLE * t.distance FROM n JOIN t ON n.run_id = t.run_id AND n.k = t.k + 1)
        SELECT run_id, frame_idx, {_four('cx')} AS lookat_x, {_four('cy')} AS lookat_y, {_four('cz')} AS lookat_z, {_four('distance')} AS distance, {_four('-90.0::DOUBLE + 0.05::DOUBLE * k')} AS azimuth, -15.0::DOUBLE AS elevation FROM t""",
    "bbox_minmax": f"WITH {_BOX} SELECT l_orderkey, x0, y0, x1, y1 FROM b",
    "bbox_largest": f"""WITH {_BOX}, r AS (SELECT o_custkey, b.*, row_number() OVER (PARTITION BY o_custkey ORDER BY (x1-x0)*(y1-y0) DESC, l_orderkey) AS k
          FROM b JOIN orders ON o_orderkey = l_orderkey WHERE (x1-x0)*(y1-y0) > 50)
        SELECT c_custkey AS o_custkey, coalesce(x0, 0) AS x0, coalesce(y0, 0) AS y0, coalesce(x1, 0) AS x1, coalesce(y1, 0) AS y1
        FROM customer LEFT JOIN (SELECT * FROM r WHERE k = 1) ON c_custkey = o_custkey""",
    "shoelace_area": f"SELECT vec_id, abs({' + '.join(f'({_corner(i)})' for i in range(8))}) / 2 AS area FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
    "mask_pixels": f"WITH {RASTER_SQL} SELECT geom_id, count(*) AS pixels FROM x GROUP BY geom_id",
    # A disc's border goes through its pixels with a neighbour outside; by Pick's theorem its area is pixels - border / 2 - 1.
    "components": f"""WITH {RASTER_SQL}, b AS (SELECT *, NOT ((dx - 1) * (dx - 1) + dy * dy <= r * r AND (dx + 1) * (dx + 1) + dy * dy <= r * r AND dx * dx + (dy - 1) * (dy - 1) <= r * r
          AND dx * dx + (dy + 1) * (dy + 1) <= r * r) AS edge FROM (SELECT x.*, r, x.x - 100 AS dx, x.y - (p_partkey % 500) * 40 AS dy FROM x JOIN d USING (p_partkey))),
        a AS (SELECT frame_idx, geom_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) - count(*) FILTER (edge) / 2.0::DOUBLE - 1 AS area FROM b GROUP BY p_partkey, frame_idx, geom_id)
        SELECT * FROM a WHERE area > 50 AND geom_id <> 0""",
    "color_mask_counts": f"""WITH {RASTER_SQL}, n AS (SELECT geom_id, count(*) AS pixels FROM x GROUP BY geom_id)
        SELECT geom_id, pixels, {', '.join(f"(CASE WHEN geom_id = 0 THEN 0 ELSE ('0x' || substr(md5(geom_id::VARCHAR), {8 * k + 1}, 8))::BIGINT % 255 END)::INT AS {c}" for k, c in enumerate('rgb'))} FROM n""",
    "raster_ids": f"WITH {RASTER_SQL} SELECT DISTINCT frame_idx, geom_id FROM x",
    "dim_lookup": "SELECT p_brand, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "left_default": """SELECT c_custkey AS o_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority LIKE '1%' GROUP BY 1""",
    "annotation_full_outer": """SELECT coalesce(c.key, o.key) AS key, coalesce(c_name, '') AS name, coalesce(n, 0) AS n
        FROM (SELECT c_custkey AS key, c_name FROM customer WHERE c_mktsegment = 'BUILDING') c
        FULL OUTER JOIN (SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON c.key = o.key""",
    "positional_join": """WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS frame_idx FROM events)
        SELECT a.user_id, a.frame_idx, a.event_id AS click_id, b.event_id AS view_id FROM (SELECT * FROM n WHERE event_type = 'click') a
        LEFT JOIN (SELECT * FROM n WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.frame_idx = b.frame_idx""",
    "explode_flatten": """SELECT p_partkey, i AS pos, t[i + 1] AS token FROM (SELECT p_partkey, string_split(p_name, ' ') || string_split(p_type, ' ') AS t FROM part), range(100) r(i) WHERE i < len(t)""",
    "json_extract": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
}
