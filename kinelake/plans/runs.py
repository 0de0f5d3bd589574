"""Queries on long runs: `lineitem` in the order of its keys, four runs of which one holds seven tenths of all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions import vec
from kinelake.operators import camera, frames, overlay, scans
from kinelake.sources.tables import table

KEYS, ORDER = ["run_id"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
#: Steps a frame, and a smoothing that remembers thousands of rows.
STEPS, ALPHA = 3.7, 0.001


def steps(spark, sf_dir):
    """run_id, the order, t (growing along the run) and a value."""
    return table(spark, sf_dir, "lineitem").select(
        F.least(F.col("l_suppkey") % 10, F.lit(3)).cast("int").alias("run_id"), *ORDER, (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("t"), F.col("l_quantity").cast("double").alias("value")
    )


def pieces(df):
    return scans.pieces(df, F.col("l_orderkey"))


def long_gate(spark, sf_dir):
    """Steps at which a frame is due."""
    df = steps(spark, sf_dir)
    return frames.frame_gate(df, KEYS, ORDER, F.col("t") / F.lit(STEPS), pieces(df)).select("run_id", *ORDER, "frame_idx")


def long_lag(spark, sf_dir):
    """Each row with its number, the value before and the time since."""
    df = steps(spark, sf_dir)
    cut = pieces(df)
    lagged = frames.lag_seeded(df.withColumn("x", F.col("t") / 10), KEYS, ORDER, "value", F.lit(-1.0), "value_prev", cut)
    return scans.numbered(frames.step_delta(lagged, KEYS, ORDER, "x", "dt", cut), KEYS, ORDER, cut).select("run_id", *ORDER, "n", "value_prev", "dt")


def long_ema(spark, sf_dir):
    """What smoothing over a whole run ends with."""
    df = steps(spark, sf_dir)
    return camera.ema(df, KEYS, ORDER, "value", None, ALPHA, pieces(df)).select("run_id", "n", vec.steady(F.col("ema")).alias("ema"))


def long_track(spark, sf_dir):
    """The camera of each order of a run, taken as a frame."""
    df = steps(spark, sf_dir)
    df = df.groupBy("run_id", "l_orderkey").agg(F.avg("value").alias("cx"), F.max("value").alias("cy"), F.min("value").alias("cz"), F.max("l_linenumber").cast("double").alias("distance"))
    found = camera.track(df, KEYS, "l_orderkey", alpha=ALPHA, piece=pieces(df))
    return found.select("run_id", "l_orderkey", *(vec.steady(F.col(c), 4).alias(c) for c in ("lookat_x", "lookat_y", "lookat_z", "distance", "azimuth")))


def long_positional(spark, sf_dir):
    """Returned rows of a run with the other one of the same place, if there is one."""
    def places(flag, name):
        df = table(spark, sf_dir, "lineitem").where(flag).select(F.least(F.col("l_suppkey") % 10, F.lit(3)).cast("int").alias("run_id"), *ORDER)
        found = scans.numbered(df, KEYS, ORDER, pieces(df), "frame_idx")
        return found.select("run_id", "frame_idx", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(name))

    return overlay.positional(places("l_returnflag = 'R'", "returned"), places("l_returnflag <> 'R'", "other"), ["run_id", "frame_idx"])


QUERIES = {f.__name__: f for f in (long_gate, long_lag, long_ema, long_track, long_positional)}

_RUNS = """s AS (SELECT least(l_suppkey % 10, 3)::INT AS run_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_orderkey * 8 + l_linenumber AS t, l_quantity::DOUBLE AS value, l_returnflag FROM lineitem)"""
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_OVER = f"(PARTITION BY run_id ORDER BY {_ORDER})"
_ROUND = lambda x, k: f"floor(({x}) * {10.0**k!r}::DOUBLE + 0.5) / {10.0**k!r}::DOUBLE"
_STEP = lambda c: f"{ALPHA}::DOUBLE * n.{c} + {1 - ALPHA!r}::DOUBLE * t.{c}"

ORACLE = {
    "long_gate": f"""WITH {_RUNS}, k AS (SELECT *, row_number() OVER {_OVER} AS k FROM s),
        n AS (SELECT *, k + least(0, min(ceil(t / {STEPS}::DOUBLE)::BIGINT - k) OVER (PARTITION BY run_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)) AS n FROM k),
        p AS (SELECT *, coalesce(lag(n) OVER {_OVER}, 0) AS was FROM n)
        SELECT run_id, {_ORDER}, (n - 1)::BIGINT AS frame_idx FROM p WHERE n > was""",
    "long_lag": f"""WITH {_RUNS}, x AS (SELECT *, t / 10.0::DOUBLE AS x FROM s)
        SELECT run_id, {_ORDER}, row_number() OVER {_OVER} AS n, coalesce(lag(value) OVER {_OVER}, -1.0::DOUBLE) AS value_prev,
               greatest(x - coalesce(lag(x) OVER {_OVER}, x), 1e-6::DOUBLE) AS dt FROM x""",
    "long_ema": f"""WITH {_RUNS}, r AS (SELECT run_id, count(*) AS n, list_reduce(list(value ORDER BY {_ORDER}), lambda y, v: {ALPHA}::DOUBLE * v + {1 - ALPHA!r}::DOUBLE * y,
        first(value ORDER BY {_ORDER})) AS ema FROM s GROUP BY run_id) SELECT run_id, n, {_ROUND('ema', 6)} AS ema FROM r""",
    "long_positional": f"""WITH {_RUNS}, n AS (SELECT run_id, l_returnflag = 'R' AS back, t, row_number() OVER (PARTITION BY run_id, l_returnflag = 'R' ORDER BY {_ORDER}) AS frame_idx FROM s)
        SELECT a.run_id, a.frame_idx, a.t AS returned, b.t AS other FROM (SELECT * FROM n WHERE back) a LEFT JOIN (SELECT * FROM n WHERE NOT back) b ON a.run_id = b.run_id AND a.frame_idx = b.frame_idx""",
    "long_track": f"""WITH RECURSIVE {_RUNS}, f AS (SELECT run_id, l_orderkey, avg(value) AS cx, max(value) AS cy, min(value) AS cz, max(l_linenumber)::DOUBLE AS distance FROM s GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY l_orderkey) AS k FROM f),
        t AS (SELECT run_id, l_orderkey, k, cx, cy, cz, {ALPHA}::DOUBLE * distance + {1 - ALPHA!r}::DOUBLE * 2.23606797749979::DOUBLE AS distance FROM n WHERE k = 1
          UNION ALL SELECT n.run_id, n.l_orderkey, n.k, {_STEP('cx')}, {_STEP('cy')}, {_STEP('cz')}, {_STEP('distance')} FROM n JOIN t ON n.run_id = t.run_id AND n.k = t.k + 1)
        SELECT run_id, l_orderkey, {_ROUND('cx', 4)} AS lookat_x, {_ROUND('cy', 4)} AS lookat_y, {_ROUND('cz', 4)} AS lookat_z, {_ROUND('distance', 4)} AS distance, {_ROUND('-90.0::DOUBLE + 0.05::DOUBLE * k', 4)} AS azimuth FROM t""",
}
