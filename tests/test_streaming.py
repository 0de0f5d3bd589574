"""The stream gate gives the frames of the batch operators."""

from pyspark.sql import functions as F

from kinelake.operators import frames
from kinelake.plans.motion import FRAME_US, trajectory
from kinelake.streaming import gate

SF_DIR = "/root/testdata/sf0.001"


def test_gate_on_a_stream(spark, tmp_path):
    events = trajectory(spark, SF_DIR).select("user_id", "event_id", "us", "value")
    for k, (low, high) in enumerate([(0, 1e12), (1e12, 1e18)]):
        events.where((F.col("us") >= low) & (F.col("us") < high)).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = gate.gated(stream, FRAME_US).writeStream.format("memory").queryName("gated").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["user_id"], r["event_id"]): (r["frame_idx"], r["value_prev"]) for r in spark.table("gated").collect()}
    gated = frames.frame_gate(events, ["user_id"], ["us", "event_id"], F.col("us") / F.lit(float(FRAME_US)))
    want = frames.lag_seeded(gated, ["user_id"], ["us", "event_id"], "value", F.lit(0.0), "p")
    assert got == {(r["user_id"], r["event_id"]): (r["frame_idx"], r["p"]) for r in want.collect()}


def test_camera_and_colours_on_a_stream(spark, tmp_path):
    from kinelake.operators import camera, vision

    rows = [(k, i, float(i), 0.5 * i, 1.0, 4.0) for k in (1, 2) for i in range(6)]
    df = spark.createDataFrame(rows, "run_id long, frame_idx long, cx double, cy double, cz double, distance double")
    for part in (df.where("frame_idx < 3"), df.where("frame_idx >= 3")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = gate.tracked(stream).writeStream.format("memory").queryName("tracked").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    names = ["run_id", "frame_idx", "lookat_x", "lookat_y", "distance", "azimuth"]
    want = camera.track(df, ["run_id"], "frame_idx").select(names)
    flat = lambda d: [round(float(v), 9) for r in sorted(map(tuple, d.select(names).collect())) for v in r]
    assert flat(spark.table("tracked")) == flat(want)
    ids = spark.createDataFrame([(0,), (1,), (2,)], "geom_id int")
    known = spark.createDataFrame([(1, [9, 9, 9])], "geom_id int, color array<int>")
    got = {r["geom_id"]: r["color"] for r in gate.colored(ids, known).collect()}
    own = {r["geom_id"]: r["c"] for r in ids.select("geom_id", vision.mask_color(F.col("geom_id")).alias("c")).collect()}
    assert got == {0: [0, 0, 0], 1: [9, 9, 9], 2: own[2]}
