"""Labels and cameras of whole runs in both readings: `embeddings` as samples of eight bodies, five runs by vec_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions import vec
from kinelake.operators import camera, frames, kinematics, state
from kinelake.plans.motion import _sampled
from kinelake.sources import document
from kinelake.sources.tables import table

RUNS, BODIES = 5, 8
STEP_DT, FRAME_DT = 0.0005, 1 / 30


def samples(spark, sf_dir):
    return _sampled(spark, sf_dir).withColumn("run_id", (F.col("vec_id") % RUNS).cast("int"))


def labelled_run(spark, sf_dir):
    """Motion of each body in each frame from velocities of two decimals, over the time between frames and ("exact") over that of a step."""
    states = state.states(samples(spark, sf_dir), F.lit(BODIES))
    moved = frames.previous_velocity(states, ["run_id", "obj_idx"], ["vec_id"], "velocity", F.transform("velocity", lambda _: F.lit(0.0)))
    now, before = ([F.col(c)[i] for i in range(3)] for c in ("velocity", "vel_prev"))
    label = {c: kinematics.linear_motion(now, before, state.motion_dt(F.lit(STEP_DT), F.lit(FRAME_DT), c)) for c in state.COMPAT}
    return moved.select("run_id", "vec_id", "obj_idx", now[0].alias("vx"), before[0].alias("vx_prev"), *(x.alias(f"label_{c}") for c, x in label.items()))


def camera_readings(spark, sf_dir):
    """Where the camera would look in each frame, with positions read at both addresses; every seventh frame has no bodies."""
    all_frames = samples(spark, sf_dir)
    found = []
    for compat in state.COMPAT:
        at = state.camera_address(F.col("i"), compat)
        bodies = all_frames.where("vec_id % 7 <> 0").select("vec_id", "qpos", F.explode(F.sequence(F.lit(0), F.lit(BODIES - 1))).alias("i"))
        spread = camera.spread(bodies.select("vec_id", *(F.get("qpos", at + k).alias(c) for k, c in enumerate("xyz"))), ["vec_id"])
        found.append(camera.with_empty(spread, all_frames.select("vec_id"), ["vec_id"]).select("vec_id", F.lit(compat).alias("reading"), *(vec.steady(F.col(c)).alias(c) for c in ("cx", "cy", "cz", "distance"))))
    return found[0].unionByName(found[1])


def settings(spark, sf_dir):
    """A camera for each run: what is not given has its default."""
    run = F.col("run_id")
    given = F.struct(
        F.when(run % 2 == 0, F.array(run.cast("double"), F.lit(1.0), F.lit(2.0))).alias("lookat"), F.when(run != 1, run + 2.5).alias("distance"),
        F.when(run > 1, run * -10.0).alias("azimuth"), F.when(run == 3, F.lit(-30.0)).alias("elevation"),
    )
    runs = samples(spark, sf_dir).select("run_id").distinct().withColumn("camera", given)
    return runs.withColumn("init", document.with_defaults()).select("run_id", F.when(run < 3, 1).otherwise(0).alias("mode"), "init.*")


def camera_runs(spark, sf_dir):
    """The camera of each frame of runs with settings of their own, of which the last two stay where they are set."""
    bodies = state.states(samples(spark, sf_dir), F.lit(BODIES)).select("run_id", "vec_id", *(F.col("position")[k].alias(c) for k, c in enumerate("xyz")))
    found = camera.tracks(camera.spread(bodies, ["run_id", "vec_id"]), settings(spark, sf_dir), ["run_id"], "vec_id")
    return found.select("run_id", "vec_id", *(vec.steady(F.col(c), 4).alias(c) for c in ("lookat_x", "lookat_y", "lookat_z", "distance", "azimuth")), "elevation")


QUERIES = {f.__name__: f for f in (labelled_run, camera_readings, camera_runs)}

_E = f"e AS (SELECT vec_id, (vec_id % {RUNS})::INT AS run_id, embedding::DOUBLE[] AS e FROM embeddings)"
_B = f"b AS (SELECT vec_id, run_id, i::INT AS i, e FROM e, range({BODIES}) r(i))"
_round = lambda x, k: f"floor(({x}) * {10.0**k!r}::DOUBLE + 0.5) / {10.0**k!r}::DOUBLE"


def _label(dt: float) -> str:
    a = [f"((v{k} - p{k}) / {dt!r}::DOUBLE)" for k in range(3)]
    dot = " + ".join(f"v{k} * {x}" for k, x in enumerate(a))
    return f"""CASE WHEN round_even(sqrt({' + '.join(f'{x} * {x}' for x in a)}), 3) < 0.01 THEN 'Constant Velocity' WHEN abs({dot}) < 1e-6 THEN NULL
        WHEN {dot} > 0 THEN 'Accelerating' WHEN {dot} < 0 THEN 'Decelerating' END"""


def _spread(keys: str, source: str) -> str:
    return f"""c AS (SELECT {keys}, avg(x) AS cx, avg(y) AS cy, greatest(avg(z), 0.5) AS cz FROM {source} GROUP BY ALL),
        d AS (SELECT {keys}, cx, cy, cz, greatest(3.0, least(6.0, 2.0 * max(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))))) AS distance FROM {source} JOIN c USING ({keys}) GROUP BY ALL)"""


_step = lambda c: f"{camera.ALPHA}::DOUBLE * n.{c} + {1 - camera.ALPHA!r}::DOUBLE * t.{c}"
_four = ", ".join(f"{_round(c, 4)} AS {name}" for c, name in (("cx", "lookat_x"), ("cy", "lookat_y"), ("cz", "lookat_z"), ("distance", "distance"), ("azimuth", "azimuth")))

ORACLE = {
    "labelled_run": f"""WITH {_E}, {_B}, v AS (SELECT vec_id, run_id, i, {', '.join(f'round_even(e[6 * i + {k + 1}], 2) AS v{k}' for k in range(3))} FROM b),
        p AS (SELECT *, {', '.join(f'coalesce(lag(v{k}) OVER w, 0.0::DOUBLE) AS p{k}' for k in range(3))} FROM v WINDOW w AS (PARTITION BY run_id, i ORDER BY vec_id))
        SELECT run_id, vec_id, i AS obj_idx, v0 AS vx, p0 AS vx_prev, {_label(FRAME_DT)} AS label_fixed, {_label(STEP_DT)} AS label_exact FROM p""",
    "camera_readings": f"""WITH {_E}, {_B}, x AS (SELECT vec_id, reading, e[a * i + 1] AS x, e[a * i + 2] AS y, e[a * i + 3] AS z FROM b, (VALUES ('fixed', 7), ('exact', 1)) q(reading, a) WHERE vec_id % 7 <> 0),
        {_spread('vec_id, reading', 'x')}
        SELECT e.vec_id, q.reading, {_round('coalesce(cx, 0.0)', 6)} AS cx, {_round('coalesce(cy, 0.0)', 6)} AS cy, {_round('coalesce(cz, 2.0)', 6)} AS cz, {_round('coalesce(distance, 3.0)', 6)} AS distance
        FROM e CROSS JOIN (VALUES ('fixed'), ('exact')) q(reading) LEFT JOIN d ON d.vec_id = e.vec_id AND d.reading = q.reading""",
    "camera_runs": f"""WITH RECURSIVE {_E}, {_B}, x AS (SELECT vec_id, run_id, e[7 * i + 1] AS x, e[7 * i + 2] AS y, e[7 * i + 3] AS z FROM b),
        {_spread('run_id, vec_id', 'x')},
        s AS (SELECT DISTINCT run_id, CASE WHEN run_id % 2 = 0 THEN [run_id::DOUBLE, 1.0, 2.0] ELSE [0.0, 0.0, 0.0] END AS lookat, CASE WHEN run_id <> 1 THEN run_id + 2.5::DOUBLE ELSE 2.23606797749979::DOUBLE END AS far,
          CASE WHEN run_id > 1 THEN run_id * -10.0::DOUBLE ELSE -90.0::DOUBLE END AS turn, CASE WHEN run_id = 3 THEN -30.0::DOUBLE ELSE -26.56505117707799::DOUBLE END AS up FROM e),
        n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY vec_id) AS k FROM d),
        t AS (SELECT n.run_id, vec_id, k, cx, cy, cz, {camera.ALPHA}::DOUBLE * distance + {1 - camera.ALPHA!r}::DOUBLE * far AS distance FROM n JOIN s USING (run_id) WHERE k = 1 AND n.run_id < 3
          UNION ALL SELECT n.run_id, n.vec_id, n.k, {_step('cx')}, {_step('cy')}, {_step('cz')}, {_step('distance')} FROM n JOIN t ON n.run_id = t.run_id AND n.k = t.k + 1),
        u AS (SELECT t.run_id, vec_id, cx, cy, cz, distance, turn + 0.05::DOUBLE * k AS azimuth, -15.0::DOUBLE AS elevation FROM t JOIN s USING (run_id)
          UNION ALL SELECT n.run_id, vec_id, lookat[1], lookat[2], lookat[3], far, turn, up FROM n JOIN s USING (run_id) WHERE n.run_id >= 3)
        SELECT run_id, vec_id, {_four}, elevation FROM u""",
}
