"""Queries on contacts and run documents.

A day of `events` is a frame, user_id modulo 20 a body (0 is the floor), and each event
touches the next one of its day: one contact an event. A body's velocity in a frame is
its last value of the day.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinelake.functions import vec
from kinelake.operators import contacts, frames, kinematics, overlay, vision
from kinelake.plans.motion import DAY_US, trajectory, vectors
from kinelake.sources import document, run_files, scratch

BODIES = 20


def frame_events(spark, sf_dir):
    return trajectory(spark, sf_dir).select(
        F.floor(F.col("us") / DAY_US).cast("long").alias("frame_idx"), (F.col("user_id") % BODIES).cast("int").alias("geom_id"), "event_id", "ts", "value"
    )


def touching(spark, sf_dir):
    w = Window.partitionBy("frame_idx").orderBy("ts", "event_id")
    df = frame_events(spark, sf_dir).withColumn("geom2", F.lead("geom_id").over(w))
    return df.where("geom2 IS NOT NULL AND geom_id <> geom2").select("frame_idx", F.col("event_id").alias("contact_idx"), F.col("geom_id").alias("geom1"), "geom2")


def state(spark, sf_dir):
    """Of the bodies, without the floor: in each frame the last value, and that of the body's frame before."""
    last = frame_events(spark, sf_dir).where(F.col("geom_id") != vision.FLOOR).groupBy("frame_idx", "geom_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v_now"))
    return frames.lag_seeded(last, ["geom_id"], ["frame_idx"], "v_now", F.lit(0.0), "v_prev")


def motion(spark, sf_dir):
    label = kinematics.linear_motion([F.col("v_now")], [F.col("v_prev")], F.lit(1.0))
    return state(spark, sf_dir).withColumn("label", label).where("label IS NOT NULL")


def collisions(spark, sf_dir):
    """Per frame and pair without the floor: the last contact's label and the first contact's index."""
    free = contacts.without_floor(touching(spark, sf_dir))
    labelled = contacts.elasticity(free, state(spark, sf_dir))
    return contacts.keep_last(labelled, "frame_idx", "contact_idx", ["label"])


def interaction_pairs(spark, sf_dir):
    return contacts.distinct_pairs(touching(spark, sf_dir))


def pairs_no_floor(spark, sf_dir):
    return contacts.distinct_pairs(contacts.without_floor(touching(spark, sf_dir)))


def contact_keep_last(spark, sf_dir):
    df = touching(spark, sf_dir).withColumn("last_idx", F.col("contact_idx"))
    return contacts.keep_last(df, "frame_idx", "contact_idx", ["last_idx"])


def collision_elasticity(spark, sf_dir):
    return collisions(spark, sf_dir).select("frame_idx", "g1", "g2", "label")


def collision_elasticity_3d(spark, sf_dir):
    """Each vector is a body in frame vec_id div 10 and touches the frame's next two, each along its own normal (13-15 of the other body)."""
    e = vectors(spark, sf_dir).select(F.expr("vec_id div 10").alias("frame_idx"), (F.col("vec_id") % 10).cast("int").alias("geom_id"), "e")
    part = lambda i: F.array(*(vec.at(F.col("e"), i + k) for k in range(3)))
    states = e.select("frame_idx", "geom_id", part(10).alias("v_prev"), part(0).alias("v_now"))
    hits = e.select("frame_idx", F.explode(F.array(F.col("geom_id") - 1, F.col("geom_id") - 2)).alias("geom1"), F.col("geom_id").alias("geom2"), part(13).alias("normal"))
    return contacts.elasticity(hits, states, normal="normal").select("frame_idx", "geom1", "geom2", "label")


def collision_fanout(spark, sf_dir):
    return contacts.fan_out(collisions(spark, sf_dir)).groupBy("frame_idx", "geom_id").agg(F.count(F.lit(1)).alias("n"))


def _collected(spark, sf_dir):
    """(frame_idx, geom_id, events): labels in order, motion first, then pairs as first seen."""
    moves = motion(spark, sf_dir).select("frame_idx", "geom_id", F.lit(-1).cast("long").alias("ord"), "label")
    hits = contacts.fan_out(collisions(spark, sf_dir)).select("frame_idx", "geom_id", F.col("first_seen").alias("ord"), "label")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "label")))
    return moves.unionByName(hits).groupBy("frame_idx", "geom_id").agg(F.transform(ordered, lambda s: s["label"]).alias("events"))


def event_collect(spark, sf_dir):
    return _collected(spark, sf_dir).select("frame_idx", "geom_id", F.array_join("events", ",").alias("events"))


def annotation_outer(spark, sf_dir):
    """States of faster bodies, full outer with the events of elastic ones: defaults on both sides."""
    left = state(spark, sf_dir).where("v_now > v_prev").select("frame_idx", "geom_id", "v_now")
    right = event_collect(spark, sf_dir).where(F.col("events").contains(contacts.ELASTIC))
    joined = left.join(right, ["frame_idx", "geom_id"], "full_outer")
    return joined.select("frame_idx", "geom_id", F.coalesce("v_now", F.lit(0.0)).alias("v_now"), F.coalesce("events", F.lit("")).alias("events"))


def key_union(spark, sf_dir):
    left = state(spark, sf_dir).where("v_now > v_prev").select("frame_idx", "geom_id")
    return left.union(_collected(spark, sf_dir).where(F.array_contains("events", contacts.ELASTIC)).select("frame_idx", "geom_id")).distinct()


def _framed(spark, sf_dir):
    """Frames of one run a week: run_id is the week."""
    week = (F.col("frame_idx") / 7).cast("long").alias("run_id")
    joined = state(spark, sf_dir).join(_collected(spark, sf_dir), ["frame_idx", "geom_id"], "left")
    none = F.array().cast("array<string>")
    empty = F.array().cast("array<double>")
    event = F.struct(F.lit("Events").alias("category"), F.lit("All").alias("subcategory"), F.coalesce("events", none).alias("labels"))
    still = F.when(kinematics.is_stopped(F.abs("v_now"), F.lit(0.0)), F.array(F.lit(kinematics.STOPPED))).otherwise(none)
    box = F.array(F.array(F.col("geom_id"), F.lit(0)), F.array(F.col("geom_id") + 1, F.lit(1)))
    described = F.struct(
        F.array("v_now").alias("velocity"), empty.alias("angular_velocity"), still.alias("active_labels"), empty.alias("position"), box.alias("bbox"), F.array(event).alias("taxonomy")
    )
    states = joined.select(
        week, "frame_idx", F.col("frame_idx").cast("double").alias("time"), F.concat(F.lit("geom_obj"), (F.col("geom_id") - 1).cast("string")).alias("id"), described.alias("state")
    )
    pairs = interaction_pairs(spark, sf_dir).select(week, "frame_idx", "g1", "g2")
    return document.frames(states, pairs)


def doc_assemble(spark, sf_dir):
    return document.documents(_framed(spark, sf_dir))


def doc_roundtrip(spark, sf_dir):
    """Documents written as JSON text, parsed by schema and flattened again."""
    flat = document.flatten(document.parse(doc_assemble(spark, sf_dir)), ["run_id"])
    return flat.select(
        "run_id", F.col("time").cast("long").alias("frame_idx"), "id", F.col("velocity")[0].alias("velocity"), F.array_join("active_labels", ",").alias("active"), overlay.labels_of(F.col("taxonomy")).alias("labels")
    )


def doc_variants(spark, sf_dir):
    """The same rows as doc_roundtrip, of documents without a schema, each with a field more; every third text is cut short and gives none."""
    whole = F.concat(F.lit('{"note":"kept",'), F.expr("substring(json, 2)"))
    text = doc_assemble(spark, sf_dir).select("run_id", F.when(F.col("run_id") % 3 == 2, F.expr("substring(json, 1, length(json) - 9)")).otherwise(whole).alias("json"))
    again = document.variants(document.variant_text(document.variants(text)).select("run_id", "json"))
    flat = document.flatten_variants(again, ["run_id", "doc"])
    get = lambda at, kind: F.try_variant_get("state", at, kind)
    return flat.select(
        "run_id", F.col("time").cast("long").alias("frame_idx"), "id", get("$.velocity[0]", "double").alias("velocity"), F.array_join(get("$.active_labels", "array<string>"), ",").alias("active"),
        F.array_join(get("$.taxonomy[0].labels", "array<string>"), ",").alias("labels"), F.try_variant_get("doc", "$.note", "string").alias("note"),
    )


def doc_interactions(spark, sf_dir):
    """Pairs read back from the documents."""
    parsed = document.parse(doc_assemble(spark, sf_dir))
    pairs = parsed.select("run_id", F.explode("frames").alias("f")).select("run_id", F.col("f.time").cast("long").alias("frame_idx"), F.explode("f.interations").alias("p"))
    return pairs.select("run_id", "frame_idx", F.col("p")[0].alias("g1"), F.col("p")[1].alias("g2"))


def overlay_lines(spark, sf_dir):
    """Text lines drawn for every body and frame, with their places."""
    df = state(spark, sf_dir).join(_collected(spark, sf_dir), ["frame_idx", "geom_id"], "left")
    labels = F.coalesce(F.array_join("events", ","), F.lit(""))
    text = overlay.description((F.col("geom_id") + 1).cast("double"), overlay.vector(F.array("v_now", "v_prev")), F.lit("wood"), labels)
    placed = df.withColumns({"text": text, "x": F.col("geom_id") * 10, "y": F.lit(500)})
    return overlay.lines(placed, "text", "x", "y").select("frame_idx", "geom_id", "line_idx", "line", "line_x", "line_y")


def manifest(spark, sf_dir):
    """Documents written as files of their own, and what the manifest of that write says, with the frames read back from each file."""
    runs = frame_events(spark, sf_dir).where(F.col("geom_id") != vision.FLOOR).groupBy((F.col("frame_idx") / 7).cast("long").alias("run_id")).agg(F.countDistinct("geom_id").alias("num_objects"))
    path = f"{scratch.folder(spark)}/runs-{uuid.uuid4().hex}"
    written = run_files.write(doc_assemble(spark, sf_dir).join(runs, "run_id"), path)
    read = document.read(spark, f"{path}/*/*/*.json").select(F.substring_index("path", "/", -3).alias("annotations"), F.size("frames").cast("long").alias("frames"))
    return written.join(read, "annotations", "left").select(F.col("run_id").cast("long").alias("run_id"), "num_objects", "annotations", "video", "segmentation", "frames")


QUERIES = {
    f.__name__: f
    for f in (
        interaction_pairs, pairs_no_floor, contact_keep_last, collision_elasticity, collision_elasticity_3d, collision_fanout, event_collect, annotation_outer, key_union,
        doc_assemble, doc_roundtrip, doc_variants, doc_interactions, overlay_lines, manifest,
    )
}

_BASE = f"""e AS (SELECT floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))::DOUBLE / {DAY_US})::BIGINT AS frame_idx, (user_id % {BODIES})::INT AS geom_id, event_id, ts, value FROM events),
c AS (SELECT frame_idx, event_id AS contact_idx, geom_id AS geom1, g AS geom2, least(geom_id, g) AS g1, greatest(geom_id, g) AS g2
      FROM (SELECT *, lead(geom_id) OVER (PARTITION BY frame_idx ORDER BY ts, event_id) AS g FROM e) WHERE g IS NOT NULL AND geom_id <> g),
s0 AS (SELECT frame_idx, geom_id, arg_max(value, (ts, event_id)) AS v_now FROM e WHERE geom_id <> 0 GROUP BY ALL),
s AS (SELECT *, coalesce(lag(v_now) OVER (PARTITION BY geom_id ORDER BY frame_idx), 0.0) AS v_prev FROM s0)"""
_COLLISION = f"""{_BASE},
j AS (SELECT c.*, abs(b1.v_now - b2.v_now) AS post, abs(b1.v_prev - b2.v_prev) AS pre FROM c
      JOIN s b1 ON b1.frame_idx = c.frame_idx AND b1.geom_id = geom1 JOIN s b2 ON b2.frame_idx = c.frame_idx AND b2.geom_id = geom2 WHERE g1 <> 0),
l AS (SELECT *, CASE WHEN (CASE WHEN pre <> 0 THEN post / pre ELSE 0 END) > 0.5 THEN 'Elastic Collision' ELSE 'Inelastic Collision' END AS label FROM j),
p AS (SELECT frame_idx, g1, g2, arg_max(label, contact_idx) AS label, min(contact_idx) AS first_seen FROM l GROUP BY ALL),
f AS (SELECT frame_idx, unnest([g1, g2]) AS geom_id, first_seen AS ord, label FROM p),
m AS (SELECT frame_idx, geom_id, -1 AS ord, CASE WHEN round_even(abs(v_now - v_prev), 3) < 0.01 THEN 'Constant Velocity'
        WHEN abs(v_now * (v_now - v_prev)) < 1e-6 THEN NULL WHEN v_now * (v_now - v_prev) > 0 THEN 'Accelerating' ELSE 'Decelerating' END AS label FROM s),
v AS (SELECT frame_idx, geom_id, string_agg(label, ',' ORDER BY ord, label) AS events FROM (SELECT * FROM f UNION ALL SELECT * FROM m WHERE label IS NOT NULL) GROUP BY ALL)"""
_num = lambda x: f"(CASE WHEN {x} = trunc({x}) THEN printf('%.1f', {x}) ELSE {x}::VARCHAR END)"

ORACLE = {
    "interaction_pairs": f"WITH {_BASE} SELECT DISTINCT frame_idx, g1, g2 FROM c",
    "pairs_no_floor": f"WITH {_BASE} SELECT DISTINCT frame_idx, g1, g2 FROM c WHERE g1 <> 0",
    "contact_keep_last": f"WITH {_BASE} SELECT frame_idx, g1, g2, min(contact_idx) AS first_seen, max(contact_idx) AS last_idx FROM c GROUP BY ALL",
    "collision_elasticity": f"WITH {_COLLISION} SELECT frame_idx, g1, g2, label FROM p",
    "collision_elasticity_3d": """WITH b AS (SELECT vec_id // 10 AS frame_idx, (vec_id % 10)::INT AS geom_id, embedding::DOUBLE[] AS e FROM embeddings),
        j AS (SELECT x.frame_idx, x.geom_id AS geom1, y.geom_id AS geom2,
            abs((x.e[1]-y.e[1])*y.e[14] + (x.e[2]-y.e[2])*y.e[15] + (x.e[3]-y.e[3])*y.e[16]) AS post,
            abs((x.e[11]-y.e[11])*y.e[14] + (x.e[12]-y.e[12])*y.e[15] + (x.e[13]-y.e[13])*y.e[16]) AS pre
          FROM b x JOIN b y ON x.frame_idx = y.frame_idx AND y.geom_id - x.geom_id IN (1, 2))
        SELECT frame_idx, geom1, geom2, CASE WHEN pre <> 0 AND post / pre > 0.5 THEN 'Elastic Collision' ELSE 'Inelastic Collision' END AS label FROM j""",
    "collision_fanout": f"WITH {_COLLISION} SELECT frame_idx, geom_id, count(*) AS n FROM f GROUP BY ALL",
    "event_collect": f"WITH {_COLLISION} SELECT frame_idx, geom_id, events FROM v",
    "annotation_outer": f"""WITH {_COLLISION}, a AS (SELECT * FROM s WHERE v_now > v_prev), b AS (SELECT * FROM v WHERE contains(events, 'Elastic Collision'))
        SELECT coalesce(a.frame_idx, b.frame_idx) AS frame_idx, coalesce(a.geom_id, b.geom_id) AS geom_id, coalesce(v_now, 0.0) AS v_now, coalesce(events, '') AS events
        FROM a FULL OUTER JOIN b ON a.frame_idx = b.frame_idx AND a.geom_id = b.geom_id""",
    "key_union": f"WITH {_COLLISION} SELECT frame_idx, geom_id FROM s WHERE v_now > v_prev UNION SELECT frame_idx, geom_id FROM v WHERE contains(events, 'Elastic Collision')",
    "doc_roundtrip": f"""WITH {_COLLISION} SELECT frame_idx // 7 AS run_id, frame_idx, 'geom_obj' || (geom_id - 1) AS id, v_now AS velocity,
        CASE WHEN abs(v_now) < 0.05 THEN 'Stopped' ELSE '' END AS active, coalesce(events, '') AS labels FROM s LEFT JOIN v USING (frame_idx, geom_id)""",
    "doc_variants": f"""WITH {_COLLISION} SELECT frame_idx // 7 AS run_id, frame_idx, 'geom_obj' || (geom_id - 1) AS id, v_now AS velocity,
        CASE WHEN abs(v_now) < 0.05 THEN 'Stopped' ELSE '' END AS active, coalesce(events, '') AS labels, 'kept' AS note FROM s LEFT JOIN v USING (frame_idx, geom_id) WHERE (frame_idx // 7) % 3 <> 2""",
    "doc_interactions": f"WITH {_BASE} SELECT DISTINCT frame_idx // 7 AS run_id, frame_idx, g1, g2 FROM c",
    "overlay_lines": f"""WITH {_COLLISION}, t AS (SELECT frame_idx, geom_id, ['Mass: ' || printf('%.2f', geom_id + 1.0) || ' kg', 'Velocity: [' || {_num('v_now')} || ', ' || {_num('v_prev')} || ']',
          'Material: wood', 'Taxonomy: ' || coalesce(events, '')] AS lines FROM s LEFT JOIN v USING (frame_idx, geom_id))
        SELECT frame_idx, geom_id, i::INT AS line_idx, lines[i + 1] AS line, geom_id * 10 AS line_x, (500 - 20 * (i + 1))::INT AS line_y FROM t, range(4) r(i)""",
    "manifest": f"""WITH {_BASE}, r AS (SELECT frame_idx // 7 AS run_id, count(DISTINCT geom_id) AS n, count(DISTINCT frame_idx) AS frames FROM s GROUP BY 1)
        SELECT run_id, n AS num_objects, n || '/' || run_id || '/obj_' || n || '.json' AS annotations, n || '/' || run_id || '/simulation_' || n || '_objects.mp4' AS video,
          n || '/' || run_id || '/simulation_' || n || '_objects_segmentation.mp4' AS segmentation, frames FROM r""",
}
