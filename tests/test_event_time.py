"""Streams out of order give what the batch operators give; colours outlive a run."""

import random

import pytest
from pyspark.sql import functions as F

from kinelake.operators import frames, vision
from kinelake.streaming import colors, events

FRAME_US = 2_000_000


@pytest.fixture(scope="module")
def store(spark):
    before = {k: spark.conf.get(k, None) for k in events.STORE}
    for k, v in events.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(spark, n=240):
    rng = random.Random(8)
    at, rows = {}, []
    for i in range(n):
        user = rng.choice([1, 1, 1, 2, 3])
        at[user] = at.get(user, 1000.0) + rng.choice([0.0, 0.5, 1.0, 4.0])
        rows.append((user, i, at[user], [float(i), rng.uniform(-1, 1), 0.25]))
    return rows


def played(spark, tmp_path, batches, name, **options):
    """What the stream has given after these batches of rows (user, event, seconds, vector)."""
    schema = "user_id long, event_id long, ts timestamp, value array<double>"
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "user_id long, event_id long, s double, value array<double>")
        df.select("user_id", "event_id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    query = events.gated(stream, FRAME_US, "10 minutes", [0.0, 0.0, 0.0], **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    progress = query.lastProgress
    query.stop()
    return {(r["user_id"], r["event_id"]): (r["frame_idx"], list(r["value"]), list(r["value_prev"])) for r in spark.table(name).collect()}, progress


def test_rows_out_of_order(spark, store, tmp_path):
    rows = rows_of(spark)
    shuffled = random.Random(2).sample(rows, len(rows))
    end = (99, 10_000, 90_000.0, [0.0, 0.0, 0.0])
    got, _ = played(spark, tmp_path, [shuffled[:80], shuffled[80:160], shuffled[160:], [end]], "shuffled")
    df = spark.createDataFrame(rows, "user_id long, event_id long, s double, value array<double>")
    gated = frames.frame_gate(df, ["user_id"], ["s", "event_id"], F.col("s") * 1e6 / FRAME_US)
    want = frames.lag_seeded(gated, ["user_id"], ["s", "event_id"], "value", F.array(*[F.lit(0.0)] * 3), "p")
    assert got == {(r["user_id"], r["event_id"]): (r["frame_idx"], list(r["value"]), list(r["p"])) for r in want.collect()}
    assert len(got) > 50


def test_silent_keys_are_forgotten(spark, store, tmp_path):
    """The first users fall silent; after an hour of event time nothing of them is left, and one that comes back begins anew."""
    rows = rows_of(spark, 60)
    late = [(1, 500, 20_000.0, [1.0, 1.0, 1.0]), (98, 501, 20_000.0, [0.0] * 3)]
    batches = [rows, [(98, 400, 9_000.0, [0.0] * 3)], late, [(97, 502, 90_000.0, [0.0] * 3)]]
    got, progress = played(spark, tmp_path, batches, "silent", idle_ms=3_600_000)
    assert got[1, 500] == (0, [1.0, 1.0, 1.0], [0.0, 0.0, 0.0])  # forgotten in between
    kept, _ = played(spark, tmp_path / "b", batches, "kept")
    assert kept[1, 500][0] > 0 and kept[1, 500][2] != [0.0, 0.0, 0.0]
    assert progress["stateOperators"][0]["numRowsTotal"] < 8  # the last rows held and their timers


def test_colours_outlive_a_run(spark, tmp_path):
    path = f"{tmp_path}/colors"
    batch = lambda rows: spark.createDataFrame(rows, "geom_id int, at int, color array<int>")
    first, second = batch([(1, 5, [9, 9, 9]), (1, 2, [7, 7, 7]), (2, 1, None), (0, 1, None), (None, 1, [1, 1, 1])]), batch([(1, 0, [3, 3, 3]), (3, 0, [4, 4, 4]), (2, 0, [5, 5, 5])])
    table = lambda: {r["geom_id"]: r["color"] for r in colors.known(spark, path).collect()}
    assert table() == {}
    colors.remember(first, 0, path, ["at"])
    colors.remember(second, 1, path, ["at"])
    own = {r["id"]: r["c"] for r in spark.range(3).select("id", vision.mask_color(F.col("id")).alias("c")).collect()}
    want = {0: [0, 0, 0], 1: [7, 7, 7], 2: own[2], 3: [4, 4, 4]}
    assert table() == want
    colors.remember(first, 0, path, ["at"])  # both again, as after a failure
    colors.remember(second, 1, path, ["at"])
    assert table() == want and colors.known(spark, path).count() == 4
    ids = spark.createDataFrame([(1,), (2,), (8,)], "geom_id int")
    for _ in range(2):
        assert {r["geom_id"]: r["color"] for r in colors.colored(ids, path).collect()} == {1: [7, 7, 7], 2: own[2], 8: spark.range(1).select(vision.mask_color(F.lit(8))).first()[0]}


def test_colours_by_a_stream(spark, tmp_path):
    for k, ids in enumerate([[1, 2], [2, 3], [1, 4]]):
        spark.createDataFrame([(i, [k, i, 0]) for i in ids], "geom_id int, color array<int>").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    path = f"{tmp_path}/colors"
    for run in range(2):  # the second run sees the same rows and must change nothing
        stream = spark.readStream.schema("geom_id int, color array<int>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = stream.writeStream.foreachBatch(lambda rows, k, run=run: colors.remember(rows, 100 * run + k, path)).option("checkpointLocation", f"{tmp_path}/ck{run}").start()
        query.processAllAvailable()
        query.stop()
        found = {r["geom_id"]: r["color"] for r in colors.known(spark, path).collect()}
        assert set(found) == {1, 2, 3, 4} and all(c[1] == i for i, c in found.items())
        before = found if run == 0 else before  # noqa: F821
    assert before == found
