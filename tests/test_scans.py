"""Scans by pieces against window functions over whole runs."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinelake.operators import camera, frames, scans

KEYS, ORDER = ["run"], ["t", "i"]


@pytest.fixture(scope="module")
def rows(spark):
    """One long run, short ones, one row, a NULL run; ties, NULL values and NULL times."""
    rng = random.Random(3)
    out, at = [], {}
    for i in range(900):
        run = rng.choice([1, 1, 1, 1, 2, 3, None])
        at[run] = at.get(run, 0.0) + rng.choice([0.0, 0.0, 0.1, 0.4, 3.0])
        out.append((run, at[run], i, rng.choice([None, 1.5, -2.0, 7.0])))
    out += [(9, 5.0, 1000, 1.0), (1, None, 1001, 4.0)]
    return spark.createDataFrame(out, "run int, t double, i int, v double").repartition(5).cache()


def same(got, want):
    columns = want.columns
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("n", [1, 3, 7, 64])
def test_windows_by_pieces(rows, n):
    piece = scans.pieces(rows, F.col("t"), n)
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    same(scans.numbered(rows, KEYS, ORDER, piece), rows.withColumn("n", F.row_number().over(w).cast("long")))
    same(scans.lagged(rows, KEYS, ORDER, "v", "was", piece), rows.withColumn("was", F.lag("v").over(w)))
    same(frames.lag_seeded(rows, KEYS, ORDER, "v", F.col("t"), "was", piece), frames.lag_seeded(rows, KEYS, ORDER, "v", F.col("t"), "was"))
    timed = rows.where("t IS NOT NULL")
    same(frames.step_delta(timed, KEYS, ORDER, "t", "dt", piece), frames.step_delta(timed, KEYS, ORDER, "t"))
    for rate in (0.5, 2.0, 30.0):
        same(frames.frame_gate(timed, KEYS, ORDER, F.col("t") * rate, piece), frames.frame_gate(timed, KEYS, ORDER, F.col("t") * rate))


def test_a_run_is_cut_into_many_tasks(spark):
    long = spark.range(10_000).select(F.lit(1).alias("run"), F.col("id").alias("t"), F.col("id").alias("i"))
    cut = long.withColumn("p", scans.pieces(long, F.col("t"), 8))
    sizes = [r["count"] for r in cut.groupBy("run", "p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2000


def test_pieces_of_nothing(spark):
    none = spark.createDataFrame([], "run int, t double, i int, v double")
    piece = scans.pieces(none, F.col("t"))
    assert scans.numbered(none, KEYS, ORDER, piece).count() == 0
    assert camera.ema(none, KEYS, ORDER, "v", piece=piece).count() == 0


def fold(values, y, alpha):
    out = []
    for v in values:
        y = alpha * v + (1 - alpha) * y
        out.append(y)
    return out


@pytest.mark.parametrize("alpha", [0.001, 0.01, 0.1, 1.0])
@pytest.mark.parametrize("n", [1, 7])
def test_smoothing_forgets_nothing(spark, alpha, n):
    """2,000 rows a run, the largest value first."""
    rng = random.Random(5)
    runs = {k: [2000.0, *(rng.uniform(0, 6) for _ in range(1999))] for k in (1, None)}
    df = spark.createDataFrame([(k, t, v) for k, own in runs.items() for t, v in enumerate(own)], "run int, t int, v double")
    piece = scans.pieces(df, F.col("t"), n)
    for seed in (None, 50.0):
        got = {r["run"]: (r["n"], r["ema"]) for r in camera.ema(df, KEYS, ["t"], "v", None if seed is None else F.lit(seed), alpha, piece).collect()}
        assert got == {k: (2000, pytest.approx(fold(own, own[0] if seed is None else seed, alpha)[-1], rel=1e-12)) for k, own in runs.items()}
    framed = df.select("run", "t", F.col("v").alias("cx"), (-F.col("v")).alias("cy"), F.col("t").cast("double").alias("cz"), F.col("v").alias("distance"))
    each = camera.track(framed, KEYS, "t", alpha=alpha, piece=piece).orderBy("t")
    for k, own in runs.items():
        at = [r for r in each.where(F.col("run").eqNullSafe(F.lit(k))).collect()]
        assert [r["lookat_x"] for r in at] == pytest.approx([own[0], *fold(own[1:], own[0], alpha)], rel=1e-12)
        assert [r["distance"] for r in at] == pytest.approx(fold(own, 2.23606797749979, alpha), rel=1e-12)
        assert [r["azimuth"] for r in at] == [-90.0 + 0.05 * (i + 1) for i in range(2000)]


def test_smoothing_keeps_a_null(spark):
    df = spark.createDataFrame([(1, t, None if t == 3 else float(t)) for t in range(50)], "run int, t int, v double")
    row = camera.ema(df, KEYS, ["t"], "v", piece=scans.pieces(df, F.col("t"), 5)).first()
    assert row["n"] == 50 and row["ema"] is None


def test_smoothing_by_no_key(spark):
    df = spark.createDataFrame([(t, float(t)) for t in range(50)], "t int, v double")
    found = scans.smoothed(df, [], ["t"], {"v": ("s", None)}, 0.5, scans.pieces(df, F.col("t"), 4)).orderBy("t").collect()
    assert [r["s"] for r in found] == pytest.approx([0.0, *fold(range(1, 50), 0.0, 0.5)]) and not math.isnan(found[-1]["s"])


@pytest.mark.parametrize("alpha", [0.5, 0.9, 1.0])
def test_blocks_chain(spark, alpha):
    """Runs of many blocks (331 rows at 0.5, 99 at 0.9, 1 at 1), huge and tiny values, starts given by a column."""
    rng = random.Random(6)
    own = [rng.choice([1e150, -1e150, 1e-9, 3.0]) for _ in range(1500)]
    df = spark.createDataFrame([(1, t, v, 42.0) for t, v in enumerate(own)], "run int, t int, v double, begin double")
    got = scans.smoothed(df, ["run"], ["t"], {"v": ("s", "begin")}, alpha, scans.pieces(df, F.col("t"), 5)).orderBy("t").collect()
    want = fold(own, 42.0, alpha)
    assert [r["n"] for r in got] == list(range(1, 1501))
    scale = max(map(abs, own))
    assert all(abs(r["s"] - y) <= 1e-12 * scale for r, y in zip(got, want, strict=True))
    calm = [i for i in range(1, 1500) if alpha == 1.0]
    assert all(got[i]["s"] == own[i] for i in calm)


def test_nothing_known_after_a_gap(spark):
    df = spark.createDataFrame([(t, None if t == 700 else float("nan") if t == 100 else 1.0) for t in range(1000)], "t int, v double")
    got = [r["s"] for r in scans.smoothed(df, [], ["t"], {"v": ("s", None)}, 0.5, F.lit(0)).orderBy("t").collect()]
    assert got[:100] == pytest.approx([1.0] * 100) and all(math.isnan(x) for x in got[100:700]) and got[700:] == [None] * 300
