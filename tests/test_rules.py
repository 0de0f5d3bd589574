"""Label rules at their boundaries, and operators on small literal tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinelake.functions import geometry, vec
from kinelake.operators import camera, contacts, frames, kinematics, overlay, scene, state, vision
from kinelake.sources import document, video


def value(spark, column, **columns):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())) if columns else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("norm", "change", "label"),
    [(0.0094, 5.0, "Constant Velocity"), (0.01, 1.0, "Accelerating"), (0.0095, -1.0, "Decelerating"), (3.0, 0.0, None), (3.0, 9e-7, None), (3.0, -1e-5, "Decelerating")],
)
def test_motion_label(spark, norm, change, label):
    assert value(spark, kinematics.motion_label(F.lit(norm), F.lit(change))) == label


def test_stopped_and_tipped_are_strict(spark):
    assert not value(spark, kinematics.is_stopped(F.lit(0.05), F.lit(0.0)))
    assert value(spark, kinematics.is_stopped(F.lit(0.0499), F.lit(0.0499)))
    assert not value(spark, kinematics.is_tipped(F.lit(45.0)))
    assert value(spark, kinematics.active_labels(F.lit(True), F.lit(True))) == ["Stopped", "Tipped"]
    assert value(spark, kinematics.active_labels(F.lit(False), F.lit(False))) == []


def test_tilt(spark):
    q = lambda *v: F.array(*map(F.lit, v))
    assert value(spark, vec.tilt_degrees(q(1.0, 0.0, 0.0, 0.0))) == 0.0
    assert value(spark, vec.tilt_degrees(q(math.sqrt(0.5), math.sqrt(0.5), 0.0, 0.0))) == pytest.approx(90.0)
    assert value(spark, vec.tilt_degrees(q(0.0, 0.0, 0.0, 0.0), normalise=True)) is None


def test_rounding_follows_the_scaled_value(spark):
    assert [value(spark, vec.round_even(F.lit(x), 2)) for x in (2.675, 0.125, 1.005)] == [2.68, 0.12, 1.0]


def recurrence(xs):
    n, out = 0, []
    for x in xs:
        if n < x:
            n += 1
            out.append(n - 1)
        else:
            out.append(None)
    return out


def test_gate_equals_recurrence(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for key in range(60):
        x, xs = 0.0, []
        for _ in range(rng.randrange(1, 40)):
            x += rng.choice([0, 0.2, 0.5, 1.0, 1.7, 4.0])
            xs.append(x)
        rows += [(key, i, x) for i, x in enumerate(xs)]
        want |= {(key, i): n for i, n in enumerate(recurrence(xs)) if n is not None}
    df = frames.frame_gate(spark.createDataFrame(rows, "k long, i long, x double"), ["k"], ["i"], F.col("x"))
    assert {(r["k"], r["i"]): r["frame_idx"] for r in df.collect()} == want


def test_gate_of_a_regular_run_has_151_frames(spark):
    t, rows = 0.0, []
    while t < 5.0:
        t += 0.0005
        rows.append((0, t))
    df = spark.createDataFrame(rows, "k long, t double")
    assert len(rows) == 10_001
    assert frames.frame_gate(df, ["k"], ["t"], F.col("t") * 30).count() == 151
    assert frames.bucket_first(df, ["k"], ["t"], F.col("t") * 30).count() == 151


def test_step_delta_and_seeded_lag(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 0.0, 6.0), (1, 0.5, 7.0)], "k long, t double, v double")
    assert [r["dt"] for r in frames.step_delta(df, ["k"], ["t", "v"], "t").orderBy("t", "v").collect()] == [1e-6, 1e-6, 0.5]
    assert [r["p"] for r in frames.lag_seeded(df, ["k"], ["t", "v"], "v", F.lit(-1.0), "p").orderBy("t", "v").collect()] == [-1.0, 5.0, 6.0]


def test_contacts(spark):
    df = spark.createDataFrame([(0, 1, 2, 1), (0, 2, 1, 2), (0, 3, 0, 2), (1, 4, 1, 2)], "frame_idx long, contact_idx long, geom1 int, geom2 int")
    assert contacts.distinct_pairs(df).count() == 3
    free = contacts.without_floor(df)
    assert free.count() == 3
    kept = contacts.keep_last(free.withColumn("c", F.col("contact_idx")), "frame_idx", "contact_idx", ["c"])
    assert {tuple(r) for r in kept.collect()} == {(0, 1, 2, 1, 2), (1, 1, 2, 4, 4)}
    assert contacts.fan_out(kept).count() == 4


@pytest.mark.parametrize(("before", "now", "label"), [(2.0, 1.0, "Inelastic Collision"), (2.0, 1.01, "Elastic Collision"), (0.0, 5.0, "Inelastic Collision"), (-2.0, 1.5, "Elastic Collision")])
def test_elastic_ratio(spark, before, now, label):
    state = spark.createDataFrame([(0, 1, before, now), (0, 2, 0.0, 0.0)], "frame_idx long, geom_id int, v_prev double, v_now double")
    df = spark.createDataFrame([(0, 1, 1, 2)], "frame_idx long, contact_idx long, geom1 int, geom2 int")
    assert contacts.elasticity(df, state).first()["label"] == label


def test_elastic_ratio_is_along_each_contacts_own_normal(spark):
    rows = [(0, 1, [2.0, 2.0, 0.0], [-2.0, 0.2, 0.0]), (0, 2, [0.0, 0.0, 0.0], [0.0, 0.0, 0.0])]
    state = spark.createDataFrame(rows, "frame_idx long, geom_id int, v_prev array<double>, v_now array<double>")
    hits = [(0, 1, 1, 2, [1.0, 0.0, 0.0]), (0, 2, 1, 2, [0.0, 1.0, 0.0]), (0, 3, 2, 1, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(hits, "frame_idx long, contact_idx long, geom1 int, geom2 int, normal array<double>")
    got = {r["contact_idx"]: r["label"] for r in contacts.elasticity(df, state, normal="normal").collect()}
    assert got == {1: "Elastic Collision", 2: "Inelastic Collision", 3: "Inelastic Collision"}


def test_largest_box_ties_and_limit(spark):
    df = spark.createDataFrame([(1, 0, 50), (1, 1, 60), (1, 2, 60), (2, 0, 50)], "k int, i int, a int")
    assert [tuple(r) for r in vision.largest_box(df, ["k"], "i", F.col("a")).collect()] == [(1, 1, 60)]


def test_contours_of_a_square_and_a_speck(spark):
    square = [(0, 1, y, x) for y in range(10, 20) for x in range(5, 15)]
    speck = [(0, 1, 50, 50), (0, 1, 51, 51)]
    floor = [(0, 0, y, 0) for y in range(100)]
    df = spark.createDataFrame(square + speck + floor, "frame_idx long, geom_id int, y int, x int")
    found = vision.contours(df).collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"], r["area"]) for r in found] == [(5, 10, 15, 20, 81.0)]
    assert {r["geom_id"] for r in vision.distinct_ids(df).collect()} == {0, 1}


def test_shoelace_of_a_unit_square(spark):
    assert value(spark, geometry.shoelace(F.array(*map(F.lit, [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0])), 4)) == 1.0


def test_camera(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0)], "k int, x double, y double, z double")
    r = camera.spread(df, ["k"]).first()
    assert (r["cx"], r["cz"], r["distance"]) == (1.0, 0.5, 3.0)
    e = camera.ema(spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0)], "k int, i int, v double"), ["k"], ["i"], "v").first()
    assert (e["n"], e["ema"]) == (2, pytest.approx(0.1 * 20 + 0.9 * 10))


def test_overlay_text(spark):
    text = value(spark, overlay.description(F.lit(1.239), overlay.vector(F.array(F.lit(1.0), F.lit(-0.5), F.lit(0.254))), F.lit("wood"), F.lit("Stopped")))
    assert text == "Mass: 1.24 kg\nVelocity: [1.0, -0.5, 0.25]\nMaterial: wood\nTaxonomy: Stopped"
    df = spark.createDataFrame([("a\nb", 5, 100)], "t string, x int, y int")
    assert [(r["line"], r["line_x"], r["line_y"]) for r in overlay.lines(df, "t", "x", "y").orderBy("line_idx").collect()] == [("a", 5, 80), ("b", 5, 60)]
    assert value(spark, overlay.color_parts(F.lit("0.5 0.3 1.0 1.0"))) == [127, 76, 255]


def test_placement_of_an_unknown_mode_is_null(spark):
    u = {k: F.lit(0.5) for k in "rasbcv"}
    assert value(spark, scene.placement(F.lit("flying"), u)["x"]) is None
    assert value(spark, scene.placement(F.lit("stationary"), u)["vx"]) == 0.0


def test_scene_distributions(spark):
    df = scene.bodies(spark, 400, seed=3).cache()
    per_run = df.groupBy("run_id").count().agg(F.min("count"), F.max("count")).first()
    assert (per_run[0], per_run[1]) == (2, 14)
    share = {r["mode"]: r["count"] / df.count() for r in df.groupBy("mode").count().collect()}
    assert share["collision"] == pytest.approx(0.4, abs=0.05)
    r = df.agg(F.min("radius"), F.max("radius"), F.min("mass"), F.max("wx"), F.min("wx")).first()
    assert 1.0 <= df.where("mode = 'collision'").select(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).agg(F.min("sqrt((POWER(x, 2) + POWER(y, 2)))")).first()[0]
    assert r[2] > 0 and -20 <= r[4] < r[3] <= 20
    metal = df.where("material = 'metal'").agg(F.avg("elasticity")).first()[0]
    assert metal == pytest.approx(0.4 * 0.85 + 0.6 * 0.92, abs=0.01)
    again = scene.bodies(spark, 400, seed=3)
    assert df.select("run_id", "obj_idx", "mass").exceptAll(again.select("run_id", "obj_idx", "mass")).count() == 0
    assert {r["shape"] for r in scene.bodies(spark, 5, 1, shape="ball", material="ice").select("shape").collect()} == {"ball"}


def test_document_defaults_and_missing_taxonomy(spark):
    text = '{"camera": {"distance": 3.5}, "objects": [], "frames": [{"time": 0.5, "objects": {"geom_obj0": {"velocity": [1.0], "taxonomy": {}}}, "interations": [[0, 1]]}]}'
    docs = document.parse(spark.createDataFrame([(text,)], "json string"))
    row = document.flatten(docs, []).first()
    assert (row["id"], row["taxonomy"], row["velocity"]) == ("geom_obj0", [], [1.0])
    camera_row = docs.select(document.with_defaults().alias("c")).first()["c"]
    assert (camera_row["distance"], camera_row["lookat"], camera_row["azimuth"]) == (3.5, [0.0, 0.0, 0.0], -90.0)


def test_documents_read_back_from_files(spark, tmp_path):
    rows = [(7, 0, 0.5, "geom_obj0", [1.0])]
    state = F.struct(F.col("v").alias("velocity"))
    states = spark.createDataFrame(rows, "run_id long, frame_idx long, time double, id string, v array<double>").withColumn("state", state)
    pairs = spark.createDataFrame([(7, 0, 0, 1), (7, 0, 0, 1)], "run_id long, frame_idx long, g1 int, g2 int")
    docs = document.documents(document.frames(states, pairs))
    (tmp_path / "run.json").write_text(docs.first()["json"])
    back = document.read(spark, str(tmp_path))
    flat = document.flatten(back, ["path"]).first()
    assert (flat["id"], flat["velocity"], flat["time"]) == ("geom_obj0", [1.0], 0.5)
    assert back.select(F.explode("frames").alias("f")).first()["f"]["interations"] == [[0, 1]]


def test_operators_on_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, i long, x double")
    assert frames.frame_gate(empty, ["k"], ["i"], F.col("x")).count() == 0
    assert camera.ema(empty, ["k"], ["i"], "x").count() == 0


def test_states_in_both_readings(spark):
    sample = spark.createDataFrame([([float(i) for i in range(12)], [float(100 + i) for i in range(14)])], "qvel array<double>, qpos array<double>")
    rows = {c: state.states(sample, F.lit(2), c).orderBy("obj_idx").collect() for c in state.COMPAT}
    assert rows["fixed"][1]["velocity"] == rows["exact"][1]["velocity"] == [6.0, 7.0, 8.0]
    assert (rows["fixed"][1]["position"], rows["exact"][1]["position"]) == ([107.0, 108.0, 109.0], [106.0, 107.0, 108.0])
    assert rows["fixed"][1]["quaternion"] == [110.0, 111.0, 112.0, 113.0]
    assert rows["fixed"][0]["position"] == rows["exact"][0]["position"]
    assert [value(spark, state.later_body(F.lit(g), F.lit(3), "exact")) for g in (1, 2, 3)] == [1, 2, 2]
    with pytest.raises(ValueError):
        state.later_body(F.lit(1), F.lit(3), "other")


def test_camera_track(spark):
    df = spark.createDataFrame([(1, i, float(i), 0.0, 0.5, 4.0) for i in range(3)], "k int, f long, cx double, cy double, cz double, distance double")
    rows = camera.track(df, ["k"], "f").orderBy("f").collect()
    assert [r["lookat_x"] for r in rows] == pytest.approx([0.0, 0.1, 0.29])
    assert rows[0]["distance"] == pytest.approx(0.1 * 4 + 0.9 * 2.23606797749979)
    assert [r["azimuth"] for r in rows] == pytest.approx([-89.95, -89.9, -89.85])
    assert camera.track(df, ["k"], "f", follow=False).count() == 0


def test_given_bodies_replace_the_draw(spark):
    given = spark.createDataFrame([(1, "mine")], "run_id long, id string")
    assert scene.bodies(spark, 3, 1, given=given).collect() == given.collect()
    assert scene.bodies(spark, 3, 1, given=given.limit(0)).count() > 3


def test_replay_of_a_document(spark):
    text = (
        '{"objects": [{"id": "geom_obj0", "mass": 2.0, "material": "wood", "visual": {"rgba": "0.5 0.3 0.1 1.0", "specular": 0.2}}],'
        ' "frames": [{"time": 0.1, "objects": {"geom_obj0": {"velocity": [1.0, 0.256, 0.0], "bbox": [[5, 90], [9, 99]],'
        ' "taxonomy": [{"category": "c", "subcategory": "s", "labels": ["A", "B"]}]}, "unknown": {"velocity": [0.0]}}}]}'
    )
    docs = document.parse(spark.createDataFrame([(1, text)], "run_id long, json string"))
    shown = video.frames(spark.createDataFrame([(1, 29.97, 2), (2, 0.5, 9)], "run_id long, fps double, n_frames int"), ["run_id"])
    assert [(r["frame_idx"], r["time"]) for r in shown.orderBy("frame_idx").collect()] == [(0, 0.0), (1, 1 / 29)]
    rows = overlay.replay(docs, shown, ["run_id"]).orderBy("frame_idx", "line_idx").collect()
    assert [(r["frame_idx"], r["line"], r["line_x"], r["line_y"]) for r in rows] == [
        (0, "Mass: 2.00 kg", 5, 70), (0, "Velocity: [1.0, 0.26, 0.0]", 5, 50), (0, "Material: wood", 5, 30), (0, "Taxonomy: A,B", 5, 10), (1, None, None, None),
    ]
    assert (rows[0]["color"], rows[0]["x2"], rows[0]["y2"]) == ([127, 76, 25], 9, 99)


def test_whole_documents_are_written_by_run(spark, tmp_path):
    bodies = scene.bodies(spark, 3, seed=5)
    first = bodies.where("obj_idx = 0").select("run_id", F.lit(0).cast("long").alias("frame_idx"), F.lit(0.5).alias("time"), "id", F.struct(F.array("vx").alias("velocity")).alias("state"))
    pairs = spark.createDataFrame([], "run_id long, frame_idx long, g1 int, g2 int")
    cameras = spark.createDataFrame([(i, (3.5,)) for i in range(3)], "run_id long, camera struct<distance:double>")
    docs = document.documents(document.frames(first, pairs), document.described(bodies), cameras)
    document.write(docs, f"{tmp_path}/out")
    document.write(docs.where("run_id = 1"), f"{tmp_path}/out")  # other runs stay
    back = document.read(spark, f"{tmp_path}/out/*/*")
    rows = {len(r["objects"]): r for r in back.collect()}
    counts = {r["run_id"]: r["count"] for r in bodies.groupBy("run_id").count().collect()}
    assert back.count() == 3 and set(rows) == set(counts.values())
    one = next(iter(rows.values()))
    assert one["camera"]["distance"] == 3.5 and [o["id"] for o in one["objects"]] == [f"geom_obj{i}" for i in range(len(one["objects"]))]
    ball = bodies.where("shape = 'ball'").select("radius", "size_str", "base_z").first()
    assert ball["size_str"] == f"{ball['radius']:.4f}" and ball["base_z"] == ball["radius"]
    assert all(o["dimensions"] and o["vel_prev"] == [round(v, 2) for v in o["velocity"]] for o in one["objects"])


def test_annotators_guards_and_first_matches(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "k int, i int, v string")
    assert {tuple(r) for r in overlay.first_match(df, ["k"], ["i"]).collect()} == {(1, 1, "a"), (2, 1, "c")}
    more = document.annotated(df, lambda d: d.withColumn("x", F.lit(1)), lambda d: d.withColumn("y", F.col("x") + 1))
    assert more.first()["y"] == 2 and document.annotated(df) is df
    assert overlay.annotate(spark, "", df, "out") is None and overlay.annotate(spark, "in", None, "out") is None
    assert value(spark, overlay.swapped(F.array(F.lit(1), F.lit(2), F.lit(3)))) == [3, 2, 1]
    assert [value(spark, state.camera_address(F.lit(2), c)) for c in state.COMPAT] == [14, 2]


def test_previous_velocity_is_rounded_first(spark):
    df = spark.createDataFrame([(1, 1, [0.124, 1.0]), (1, 2, [0.126, 2.0])], "k int, i int, v array<double>")
    rows = frames.previous_velocity(df, ["k"], ["i"], "v", F.array(F.lit(0.555), F.lit(0.0))).orderBy("i").collect()
    assert [(r["v"], r["vel_prev"]) for r in rows] == [([0.12, 1.0], [0.56, 0.0]), ([0.13, 2.0], [0.12, 1.0])]


def test_camera_without_objects_and_long_runs(spark):
    found = spark.createDataFrame([(1, 0, 5.0, 5.0, 5.0, 4.0)], "k int, f int, cx double, cy double, cz double, distance double")
    every = spark.createDataFrame([(1, 0), (1, 1)], "k int, f int")
    assert [tuple(r) for r in camera.with_empty(found, every, ["k", "f"]).orderBy("f").collect()] == [(1, 0, 5.0, 5.0, 5.0, 4.0), (1, 1, 0.0, 0.0, 2.0, 3.0)]
    rng = random.Random(1)
    rows = [(1, i, rng.random(), rng.random(), rng.random(), rng.random()) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, f int, cx double, cy double, cz double, distance double")
    x, far, want = rows[0][2], 2.23606797749979, []
    for i, r in enumerate(rows):
        x, far = r[2] if i == 0 else 0.1 * r[2] + 0.9 * x, 0.1 * r[5] + 0.9 * far
        want.append((x, far))
    got = camera.Settings(mode=1).track(df, ["k"], "f").orderBy("f").collect()
    assert [v for r in got for v in (r["lookat_x"], r["distance"])] == pytest.approx([v for w in want for v in w], abs=1e-14)
    assert camera.ema(df, ["k"], ["f"], "cx").first()["ema"] == pytest.approx(want[-1][0], abs=1e-14)
    assert camera.Settings().track(df, ["k"], "f").count() == 0


def test_contours_with_holes_and_corners(spark):
    ring = [(0, 1, y, x) for y in range(30) for x in range(40) if not (10 <= y < 20 and 10 <= x < 30)]
    touching = [(0, 1, 30 + i, 40 + i) for i in range(5)]  # joined by a corner
    df = spark.createDataFrame(ring + touching, "frame_idx long, geom_id int, y int, x int")
    outer = vision.contours(df).collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"], r["hole"]) for r in outer] == [(0, 0, 45, 35, False)]
    both = vision.contours(df, holes=True).collect()
    hole = next(r for r in both if r["hole"])
    assert len(both) == 2 and (hole["x0"], hole["y0"], hole["x1"], hole["y1"]) == (9, 9, 31, 21)
    square = spark.createDataFrame([(0, 1, y, x) for y in range(10) for x in range(10)], "frame_idx long, geom_id int, y int, x int")
    assert sorted(vision.contours(square).first()["points"]) == [[0, 0], [0, 9], [9, 0], [9, 9]]


def test_scenes_are_drawn_once_over_all_cores(spark):
    # A small file of runs was one task for all their bodies; documents drew the bodies three times and were parsed twice.
    from kinelake.plans import scenes

    for query in (scenes.scene_random, scenes.scene_xml, scenes.doc_whole):
        df = query(spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan.replace("BroadcastHashJoin", "")
        assert plan.count("from_json(") == (query is scenes.doc_whole)
        assert df.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
